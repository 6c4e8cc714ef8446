"""Split, preprocessing, baseline and evaluation queries (ML-1 .. ML-27)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ratelens.functions.quantiles import hand_over
from ratelens.models.baseline import MeanRegressor
from ratelens.models.evaluation import (
    cached,
    compare_models,
    default_models,
    extra_trees,
    final_fit,
    load_model,
    prepared,
    score_batch,
    tune,
    walk_forward,
)
from ratelens.models.imputers import column_medians, column_modes
from ratelens.models.preparation import (
    SparseAssembler,
    column_roles,
    imputation_stages,
    labelled,
    model_inputs,
    rate_model,
)
from ratelens.operators import metrics as m
from ratelens.operators import splits as sp
from ratelens.plans.common import CUT, FOLDS, PUBLISHED, Query, clean, features, rounded, rounded_mean, rounded_mean_sql
from ratelens.plans.sql import over, union
from ratelens.sources.files import scratch_path
from ratelens.sources.schemas import PREDICTION, TARGET

_NUMERIC = [
    "pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon", "distance", "weight", "market_index",
    "quote_signal", "year", "month", "day", "day_of_week", "week_of_year", "day_of_year", "is_weekend",
    "is_month_start", "is_month_end", "lat_diff", "lon_diff", "abs_lat_diff", "abs_lon_diff", "geo_distance",
    "log_distance", "log_weight", "weight_per_distance", "market_index_deviation", "quote_signal_deviation",
    "quote_signal_squared", "distance_x_weight", "distance_x_market", "distance_x_quote",
]
_CATEGORICAL = ["pickup", "delivery", "equipment", "route", "distance_bucket", "weight_bucket"]
_TRAIN = f"date < DATE '{CUT}'"
_VALID = f"date >= DATE '{CUT}'"
_FOLD_ROWS = ", ".join(f"('{f.name}', DATE '{f.start}', DATE '{f.end}')" for f in FOLDS)
_ASSIGNED = (
    "assigned",
    f"""SELECT c.*, f.fold, CASE WHEN c.date < f.s THEN 'train' ELSE 'valid' END AS role
    FROM clean c JOIN (VALUES {_FOLD_ROWS}) f(fold, s, e) ON c.date < f.e""",
)
_SCORED = (
    "scored",
    """SELECT a.*, t.p FROM assigned a JOIN
    (SELECT fold, avg(posted_rate) AS p FROM assigned WHERE role = 'train' GROUP BY 1) t ON t.fold = a.fold""",
)
_METRIC_SQL = """round(avg(abs({y} - {p})), 6) AS MAE, round(sqrt(avg(pow({y} - {p}, 2))), 6) AS RMSE,
 round(1 - sum(pow({y} - {p}, 2)) / nullif(var_pop({y}) * count({y}), 0), 8) AS R2"""


def _split(spark, folder):
    return sp.holdout(sp.drop_undated(features(spark, folder)), CUT)


def baseline_scores(spark, folder):
    """Validation rows with the training mean as prediction."""
    train, valid = sp.holdout(clean(spark, folder), CUT)
    mean = train.agg(F.avg(TARGET).alias("m")).scalar()
    return m.floor_predictions(valid.withColumn(PREDICTION, mean))


def fold_baseline_scores(spark, folder):
    """Rows of every fold; validation rows get the training mean of their fold.

    One row per fold is broadcast: the fold list is a parameter, not data.
    """
    assigned = sp.assign_folds(clean(spark, folder), FOLDS)
    means = assigned.where(F.col("role") == "train").groupBy("fold").agg(F.avg(TARGET).alias(PREDICTION))
    return assigned.join(F.broadcast(means), "fold")


def _rounded_metrics(df):
    return df.withColumns({"MAE": F.round("MAE", 6), "RMSE": F.round("RMSE", 6), "R2": F.round("R2", 8)})


def _roles(spark, folder):
    """Model inputs with their role, found by type, and how many rows fill them."""
    inputs = model_inputs(sp.drop_undated(features(spark, folder)))
    roles = column_roles(inputs.schema)
    counted = inputs.agg(*[F.count(c).alias(c) for c in roles.numeric + roles.categorical])
    return counted.unpivot([], counted.columns, "column", "present").withColumn(
        "role", F.when(F.col("column").isin(roles.categorical), "categorical").otherwise("numeric")
    )


def _roles_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", count({c}) AS present, '{role}' AS role FROM features WHERE date IS NOT NULL"""
        for role, names in (("numeric", _NUMERIC), ("categorical", _CATEGORICAL))
        for c in names
    ]
    return over("features", union(rows))


def _medians(spark, folder):
    train, _ = _split(spark, folder)
    return rounded(column_medians(train, column_roles(train.schema).numeric), 6)


def _medians_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", round(median({c}), 6) AS median FROM features WHERE {_TRAIN}""" for c in _NUMERIC
    ]
    return over("features", union(rows))


def _modes(spark, folder):
    train, _ = _split(spark, folder)
    return column_modes(train, column_roles(train.schema).categorical)


def _modes_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", (SELECT {c} FROM features WHERE {_TRAIN} AND {c} IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode"""
        for c in _CATEGORICAL
    ]
    return over("features", union(rows))


def _imputed(spark, folder):
    """Validation rows filled with statistics of the training rows."""
    train, valid = _split(spark, folder)
    model = Pipeline(stages=imputation_stages(column_roles(train.schema))).fit(train)
    return rounded(model.transform(valid).select("load_id", "equipment", "weight", "market_index", "distance"), 6)


_IMPUTED_SQL = over(
    "features",
    f"""SELECT load_id, coalesce(equipment, (SELECT equipment FROM features WHERE {_TRAIN}
      AND equipment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS equipment,
    round(coalesce(weight, (SELECT median(weight) FROM features WHERE {_TRAIN})), 6) AS weight,
    round(coalesce(market_index, (SELECT median(market_index) FROM features WHERE {_TRAIN})), 6) AS market_index,
    round(coalesce(distance, (SELECT median(distance) FROM features WHERE {_TRAIN})), 6) AS distance
    FROM features WHERE {_VALID}""",
)


def _sparse_rows(spark, folder):
    """Validation rows, imputed and encoded with what the training rows gave."""
    train, valid = _split(spark, folder)
    roles = column_roles(train.schema)
    stages = [*imputation_stages(roles), SparseAssembler(numericCols=roles.numeric, categoricalCols=roles.categorical)]
    return roles, Pipeline(stages=stages).fit(train).transform(valid)


def _between(indices: str, first: int, end: int):
    return F.filter(indices, lambda i: (i >= first) & (i < end))


def _one_hot_hits(spark, folder):
    """One-hot indices set on imputed validation rows: fitted on training rows, unseen values set none."""
    names = ["pickup", "delivery", "equipment", "distance_bucket", "weight_bucket", "route"]
    train, valid = sp.holdout(hand_over(sp.drop_undated(features(spark, folder)).select("date", *names)), CUT)
    roles = column_roles(train.select(*names).schema)
    fitted = Pipeline(stages=[*imputation_stages(roles), SparseAssembler(numericCols=[], categoricalCols=names)]).fit(train)
    hits, first = [], 0
    for c, size in zip(names, fitted.stages[-1].getOrDefault("widths"), strict=True):
        hits.append((c, _between("features.indices", first, first + size), first))
        first += size
    each = [F.struct(F.lit(c).alias("column"), F.coalesce(F.get(own, F.lit(0)) - at, F.lit(-1)).alias("index")) for c, own, at in hits]
    return fitted.transform(valid).select(F.inline(F.array(*each))).groupBy("column", "index").agg(F.count(F.lit(1)).alias("rows"))


def _one_hot_sql() -> str:
    names = ["pickup", "delivery", "equipment", "distance_bucket", "weight_bucket", "route"]
    rows = [
        f"""SELECT '{c}' AS "column", coalesce(t.i, -1) AS "index", count(*) AS rows
        FROM (SELECT coalesce({c}, (SELECT {c} FROM features WHERE {_TRAIN} AND {c} IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS filled FROM features WHERE {_VALID}) v
        LEFT JOIN (SELECT {c} AS known, row_number() OVER (ORDER BY {c}) - 1 AS i
          FROM (SELECT DISTINCT {c} FROM features WHERE {_TRAIN} AND {c} IS NOT NULL) d) t ON t.known = v.filled
        GROUP BY 1, 2"""
        for c in names
    ]
    return over("features", union(rows))


def _assembled(spark, folder):
    """Width and filled indicators of the sparse model row."""
    roles, rows = _sparse_rows(spark, folder)
    numbers = len(roles.numeric)
    indicators = F.size(F.filter("features.indices", lambda i: i >= numbers))
    return rows.select("load_id", F.col("features.size").cast("int").alias("width"), indicators.alias("categories"))


def _assembled_sql() -> str:
    widths = " + ".join(f"(SELECT count(DISTINCT {c}) FROM features WHERE {_TRAIN})" for c in _CATEGORICAL)
    modes = {
        c: f"""(SELECT {c} FROM features WHERE {_TRAIN} AND {c} IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
        for c in _CATEGORICAL
    }
    known = " + ".join(
        f"cast(coalesce({c}, {modes[c]}) IN (SELECT {c} FROM features WHERE {_TRAIN} AND {c} IS NOT NULL) AS INTEGER)"
        for c in _CATEGORICAL
    )
    return over(
        "features",
        f"""SELECT load_id, cast({len(_NUMERIC)} + {widths} AS INTEGER) AS width, {known} AS categories
        FROM features WHERE {_VALID}""",
    )


def _pipeline_round_trip(spark, folder):
    """Fit, save to shared storage, load again and score the validation rows."""
    train, valid = _split(spark, folder)
    path = scratch_path(spark, "baseline-model")
    fitted = rate_model(train, MeanRegressor()).fit(labelled(train))
    fitted.write().overwrite().save(path)
    scored = m.floor_predictions(PipelineModel.load(path).transform(valid))
    return rounded(scored.select("load_id", "weight", PREDICTION), 6)


_ROUND_TRIP_SQL = over(
    "features",
    f"""SELECT load_id, round(coalesce(weight, (SELECT median(weight) FROM features WHERE {_TRAIN})), 6) AS weight,
    round((SELECT avg(posted_rate) FROM features WHERE {_TRAIN}), 6) AS predicted_rate
    FROM features WHERE {_VALID}""",
)


def _comparison(spark, folder):
    scored = baseline_scores(spark, folder)
    return _rounded_metrics(m.regression_metrics(scored).select(F.lit("dummy_mean").alias("model"), "*"))


def _baseline_metrics_sql(extra: str = "") -> str:
    return over(
        "clean",
        f"SELECT {extra}{_METRIC_SQL.format(y='posted_rate', p='p')} FROM v",
        (
            "v",
            f"""SELECT posted_rate, (SELECT avg(posted_rate) FROM clean WHERE {_TRAIN}) AS p
            FROM clean WHERE {_VALID}""",
        ),
    )


def _floored(spark, folder):
    """A straight line that goes below the floor for short loads."""
    line = clean(spark, folder).withColumn(PREDICTION, F.col("distance") * 2.5 - 500.0)
    return rounded(m.floor_predictions(line).select("load_id", PREDICTION), 6)


def _fold_report(spark, folder):
    return _rounded_metrics(m.fold_report(fold_baseline_scores(spark, folder)))


_FOLD_REPORT_BODY = f"""SELECT fold, min(date) FILTER (WHERE role = 'train') AS train_start,
 max(date) FILTER (WHERE role = 'train') AS train_end,
 min(date) FILTER (WHERE role = 'valid') AS validation_start,
 max(date) FILTER (WHERE role = 'valid') AS validation_end,
 count(*) FILTER (WHERE role = 'train') AS train_rows, count(*) FILTER (WHERE role = 'valid') AS validation_rows,
 {_METRIC_SQL.format(y="(CASE WHEN role = 'valid' THEN posted_rate END)", p='p')}
 FROM scored GROUP BY fold"""


def _equipment_trials(spark, folder):
    """Baseline metrics per equipment and fold: a results table shaped like a tuning run."""
    scored = fold_baseline_scores(spark, folder).where((F.col("role") == "valid") & F.col("equipment").isNotNull())
    return m.regression_metrics(scored, ["equipment", "fold"]).withColumnRenamed("equipment", "configuration")


_TRIALS = (
    "trials",
    """SELECT equipment AS configuration, fold, avg(abs(posted_rate - p)) AS MAE,
    sqrt(avg(pow(posted_rate - p, 2))) AS RMSE,
    1 - sum(pow(posted_rate - p, 2)) / (var_pop(posted_rate) * count(*)) AS R2
    FROM scored WHERE role = 'valid' AND equipment IS NOT NULL GROUP BY 1, 2""",
)
_SUMMARY_SQL = """round(avg(MAE), 6) AS mean_MAE, round(avg(RMSE), 6) AS mean_RMSE, round(avg(R2), 6) AS mean_R2,
 round(stddev_samp(MAE), 6) AS std_MAE, round(stddev_samp(RMSE), 6) AS std_RMSE"""


def _tree_scores(spark, folder):
    """Randomised trees fitted on the training rows, applied to the validation rows."""
    train, valid = _split(spark, folder)
    with prepared(train, valid) as (roles, fit_rows, score_on):
        model = extra_trees(roles, **PUBLISHED).fit(fit_rows)
        scored = m.floor_predictions(model.transform(score_on))
    return rounded(scored.select("load_id", TARGET, PREDICTION), 6)


def _final_scores(spark, folder):
    """Final fit on every labelled load but the latest, saved, loaded again and applied to the latest, which it has not seen.

    Undated loads are among those fitted on, as in the published final fit.
    """
    path = scratch_path(spark, "final-model")
    table = features(spark, folder)
    final_fit(table.where(F.col("date").isNull() | (F.col("date") < F.lit(CUT))), path, **PUBLISHED)
    latest = sp.holdout(clean(spark, folder), CUT)[1].drop(TARGET)
    return rounded(score_batch(latest, load_model(spark, path)), 6)


_PLAIN_INPUTS = ["distance", "weight", "market_index", "equipment"]


def _plain_fit(spark, folder, **params):
    """A forest on rows that are complete in four inputs, and these rows."""
    rows = sp.holdout(features(spark, folder), CUT)[0].select("load_id", *_PLAIN_INPUTS, TARGET).dropna()
    with cached(rows) as (train,):
        return extra_trees(column_roles(train.schema), **params).fit(train), rows


_PLAIN = (
    "plain",
    f"""SELECT load_id, distance, weight, market_index, equipment, posted_rate FROM features WHERE {_TRAIN} AND distance IS NOT NULL
    AND weight IS NOT NULL AND market_index IS NOT NULL AND equipment IS NOT NULL""",
)


def _leaf_totals(spark, folder):
    """Rows and mean label over the leaves of each tree: those of the training rows."""
    model, _ = _plain_fit(spark, folder, **{**PUBLISHED, "numTrees": 16})
    leaves = model.nodes.where("feature < 0")
    return rounded(
        leaves.groupBy("tree").agg(F.sum("rows").alias("rows"), (F.sum(F.col("rows") * F.col("value")) / F.sum("rows")).alias("mean")), 5
    )


def _full_tree(spark, folder):
    """A tree without limits gives each training row the mean label of the rows with its inputs."""
    model, rows = _plain_fit(spark, folder, numTrees=1, minSamplesLeaf=1, maxFeatures=0.8, maxDepth=0)
    return rounded_mean(model.transform(rows).select("load_id", PREDICTION), PREDICTION)


def _tree_walk(spark, folder):
    return _rounded_metrics(walk_forward(features(spark, folder), FOLDS, lambda roles: extra_trees(roles, **PUBLISHED)))


QUERIES = {
    "ml1_drop_undated": Query(
        lambda s, d: sp.drop_undated(clean(s, d)).select("load_id", "date"),
        over("clean", "SELECT load_id, date FROM clean WHERE date IS NOT NULL"),
    ),
    "ml2_holdout": Query(
        lambda s, d: sp.holdout(clean(s, d), CUT)[1].select("load_id", "date"),
        over("clean", f"SELECT load_id, date FROM clean WHERE {_VALID}"),
    ),
    "ml3_split_report": Query(
        lambda s, d: sp.split_report(clean(s, d), CUT),
        over(
            "clean",
            f"""SELECT CASE WHEN {_TRAIN} THEN 'train' ELSE 'valid' END AS role, count(*) AS rows,
            min(date) AS min_date, max(date) AS max_date FROM clean WHERE date IS NOT NULL GROUP BY 1""",
        ),
    ),
    "ml4_5_column_roles": Query(_roles, _roles_sql()),
    "ml6_column_medians": Query(_medians, _medians_sql()),
    "ml7_column_modes": Query(_modes, _modes_sql()),
    "ml6_7_imputed_rows": Query(_imputed, _IMPUTED_SQL),
    "ml8_one_hot": Query(_one_hot_hits, _one_hot_sql()),
    "ml9_assembled_vector": Query(_assembled, _assembled_sql()),
    "ml10_io5_model_round_trip": Query(_pipeline_round_trip, _ROUND_TRIP_SQL),
    "ml11_mean_baseline": Query(
        lambda s, d: rounded(baseline_scores(s, d).select("load_id", PREDICTION), 6),
        over(
            "clean",
            f"""SELECT load_id, round((SELECT avg(posted_rate) FROM clean WHERE {_TRAIN}), 6) AS predicted_rate
            FROM clean WHERE {_VALID}""",
        ),
    ),
    "ml12_extra_trees": Query(_tree_scores),
    "ml12_leaf_totals": Query(
        _leaf_totals,
        over(
            "features",
            """SELECT cast(t.tree AS INTEGER) AS tree, count(*) AS rows, round(avg(posted_rate), 5) AS mean
            FROM plain, (SELECT unnest(range(0, 16)) AS tree) t GROUP BY 1""",
            _PLAIN,
        ),
    ),
    "ml12_full_tree": Query(
        _full_tree,
        over(
            "features",
            f"""SELECT load_id, {rounded_mean_sql('avg(posted_rate) OVER (PARTITION BY distance, weight, market_index, equipment)')}
            AS predicted_rate FROM plain""",
            _PLAIN,
        ),
    ),
    "ml13_floor_predictions": Query(
        _floored,
        over(
            "clean",
            """SELECT load_id, round(CASE WHEN distance * 2.5 - 500 < 0.01 THEN 0.01 ELSE distance * 2.5 - 500 END, 6)
            AS predicted_rate FROM clean""",
        ),
    ),
    "ml14_16_regression_metrics": Query(
        lambda s, d: _rounded_metrics(m.regression_metrics(baseline_scores(s, d))), _baseline_metrics_sql()
    ),
    "ml18_model_comparison": Query(_comparison, _baseline_metrics_sql("'dummy_mean' AS model, ")),
    "ml17_18_compare_models": Query(
        lambda s, d: _rounded_metrics(compare_models(features(s, d), CUT, default_models(**PUBLISHED)))
    ),
    "ml19_fold_membership": Query(
        lambda s, d: sp.assign_folds(clean(s, d), FOLDS)
        .groupBy("fold", "role")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date")),
        over(
            "clean",
            """SELECT fold, role, count(*) AS rows, min(date) AS min_date, max(date) AS max_date
            FROM assigned GROUP BY 1, 2""",
            _ASSIGNED,
        ),
    ),
    "ml20_fold_report": Query(_fold_report, over("clean", _FOLD_REPORT_BODY, _ASSIGNED, _SCORED)),
    "ml21_fold_summary": Query(
        lambda s, d: rounded(m.fold_summary(m.fold_report(fold_baseline_scores(s, d))), 6),
        over("clean", f"SELECT {_SUMMARY_SQL} FROM results", _ASSIGNED, _SCORED, (
            "results",
            """SELECT fold, avg(abs(posted_rate - p)) AS MAE, sqrt(avg(pow(posted_rate - p, 2))) AS RMSE,
            1 - sum(pow(posted_rate - p, 2)) / (var_pop(posted_rate) * count(*)) AS R2
            FROM scored WHERE role = 'valid' GROUP BY 1""",
        )),
    ),
    "ml19_20_walk_forward_trees": Query(_tree_walk),
    "ml22_tuning_grid": Query(
        lambda s, d: _rounded_metrics(tune(features(s, d), FOLDS))
    ),
    "ml23_tuning_summary": Query(
        lambda s, d: rounded(m.tuning_summary(_equipment_trials(s, d)), 6),
        over("clean", f"SELECT configuration, {_SUMMARY_SQL} FROM trials GROUP BY 1", _ASSIGNED, _SCORED, _TRIALS),
    ),
    "ml24_25_final_scores": Query(_final_scores),
    "ml26_prediction_summary": Query(
        lambda s, d: rounded(
            m.prediction_summary(
                clean(s, d).select("load_id", (F.col("distance") * 2.5).alias(PREDICTION))
            ),
            6,
        ),
        over(
            "clean",
            """SELECT count(*) AS rows, count(*) - count(distance) AS missing,
            count(*) - count(DISTINCT load_id) AS duplicate_ids, min(distance * 2.5) AS min,
            max(distance * 2.5) AS max, round(avg(distance * 2.5), 6) AS mean FROM clean""",
        ),
    ),
    "ml27_in_date_order": Query(
        lambda s, d: sp.in_date_order(clean(s, d)).select("load_id", "date"),
        over("clean", "SELECT load_id, date FROM clean ORDER BY date NULLS LAST, load_id"),
    ),
}
