"""Imputers, encoding, randomised trees and the evaluation flows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ratelens.models import evaluation as ev
from ratelens.models import tree_growth as tg
from ratelens.models.baseline import MeanRegressor
from ratelens.models.extra_trees import ExtraTreesRegressor
from ratelens.models.imputers import MedianImputer, ModeImputer
from ratelens.models.preparation import Roles, SparseAssembler, SparseAssemblerModel, column_roles, encoding_stages, rate_model
from ratelens.operators.splits import holdout
from ratelens.plans.common import CUT, FOLDS, clean, features
from ratelens.sources.files import scratch_path
from ratelens.streaming import scoring


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x, z = rng.uniform(0, 10), rng.uniform(-1, 1)
        c = rng.choice(["red", "green", "blue"])
        rows.append((i, x, z, 4.0, c, 3 * x + (20 if c == "red" else 0) + rng.uniform(-0.5, 0.5)))
    df = spark.createDataFrame(rows, "id int, x double, z double, flat double, c string, posted_rate double")
    return df.cache()


def trees(**params):
    return ExtraTreesRegressor(
        numericCols=["x", "z", "flat"], categoricalCols=["c"], **{"numTrees": 4, "seed": 7, **params}
    )


def shape(model):
    rows = model.nodes.select("tree", "depth", "feature", "rows", F.round("value", 6)).collect()
    return sorted(tuple(r) for r in rows)


def scores(model, df):
    return {r["id"]: r["predicted_rate"] for r in model.transform(df).select("id", "predicted_rate").collect()}


def test_imputers_use_training_rows_only_and_break_ties_low(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, None), (10.0, "b"), (None, "a")], "v double, t string")
    poisoned = spark.createDataFrame([(None, None), (1e9, "zzz")], "v double, t string")
    model = Pipeline(stages=[MedianImputer(inputCols=["v"]), ModeImputer(inputCols=["t"])]).fit(train)
    assert [tuple(r) for r in model.transform(poisoned).collect()] == [(2.5, "a"), (1e9, "zzz")]


def test_one_hot_width_is_constant_and_unseen_values_are_all_zero(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "c")], "v double, t string")
    model = Pipeline(stages=encoding_stages(Roles(["v"], ["t"]))).fit(train)
    new = spark.createDataFrame([(9.0, "a"), (8.0, "unseen")], "v double, t string")
    got = [r[0] for r in model.transform(new).select(vector_to_array("features")).collect()]
    assert got == [[9.0, 1.0, 0.0, 0.0], [8.0, 0.0, 0.0, 0.0]]


def test_sparse_rows_hold_sorted_categories_and_survive_saving(spark):
    train = spark.createDataFrame([(i, f"k{i % 700:03d}", "x" if i % 2 else None) for i in range(2000)], "v int, t string, u string").repartition(7)
    model = SparseAssembler(numericCols=["v"], categoricalCols=["t", "u"]).fit(train)
    path = scratch_path(spark, "sparse")
    model.write().save(path)
    new = spark.createDataFrame([(5, "k699", "x"), (6, "new", None), (7, "k000", "y"), (8, None, "x")], "v int, t string, u string")
    for m in (model, SparseAssemblerModel.load(path)):
        got = {r["v"]: r["features"] for r in m.transform(new).collect()}
        assert m.transform(new).columns == ["v", "t", "u", "features"]
        assert [tuple(got[v]) for v in (5, 6, 7, 8)] == [
            (702, [0, 700, 701], [5.0, 1.0, 1.0]), (702, [0], [6.0]), (702, [0, 1], [7.0, 1.0]), (702, [0, 701], [8.0, 1.0])
        ]
    empty = SparseAssembler(numericCols=["v"], categoricalCols=["t"]).fit(train.where("false"))
    assert [tuple(r["features"]) for r in empty.transform(new.limit(1)).collect()] == [(1, [0], [5.0])]


def test_roles_follow_types(spark, folder):
    roles = column_roles(features(spark, folder).schema)
    assert len(roles.numeric) == 31
    assert roles.categorical == ["pickup", "delivery", "equipment", "route", "distance_bucket", "weight_bucket"]


def test_trees_do_not_depend_on_partitions_or_on_the_phase_that_grows_them(table):
    base = trees().fit(table.repartition(1))
    assert shape(trees().fit(table.repartition(16).orderBy("z"))) == shape(base)
    assert shape(trees(localRows=40).fit(table)) == shape(base)
    assert shape(trees(treesPerPass=1).fit(table)) == shape(base)


def test_leaf_and_depth_limits_hold(table):
    model = trees(minSamplesLeaf=9, maxDepth=5).fit(table)
    low = model.nodes.where("feature < 0").agg(F.min("rows"), F.max("depth")).first()
    assert low[0] >= 9 and low[1] <= 5
    assert model.nodes.where("feature = 2").count() == 0  # a constant column is never split on
    sums = model.nodes.where("feature < 0").groupBy("tree").agg(F.sum("rows").alias("n")).collect()
    assert [r["n"] for r in sums] == [600] * 4


def test_full_tree_reproduces_distinct_labels(table):
    model = trees(numTrees=1, minSamplesLeaf=1).fit(table)
    wrong = model.transform(table).where(F.abs(F.col("predicted_rate") - F.col("posted_rate")) > 1e-9)
    assert wrong.count() == 0


def test_scoring_does_not_depend_on_groups_blocks_or_levels(table):
    whole, cut = trees().fit(table), trees(localRows=40).fit(table)
    assert cut.packs.where("part > 0").count() > 4 and whole.packs.where("part > 0").count() == 0
    want = scores(whole, table)
    assert scores(cut, table) == pytest.approx(want)
    for model in (whole, cut):
        model.group_nodes, model.group_rows = 100, 90
        assert scores(model, table) == pytest.approx(want)
    assert whole.transform(table.where("false")).count() == 0


@pytest.mark.parametrize("local_rows", [1 << 20, 40])
def test_members_equal_fits_of_their_own(table, local_rows):
    forest = trees(numTrees=5, localRows=local_rows).fit(table)
    both = forest.transform_members(table, {"few": (2, None), "low": (5, 3), "all": (5, None)})
    got = {r["id"]: (r["few"], r["low"], r["all"]) for r in both.collect()}
    own = [scores(trees(**p).fit(table), table) for p in ({"numTrees": 2}, {"numTrees": 5, "maxDepth": 3}, {"numTrees": 5})]
    for i in got:
        assert got[i] == pytest.approx(tuple(s[i] for s in own))


def test_waiting_nodes_grow_the_same_trees(table, monkeypatch):
    from ratelens.models import extra_trees

    base = shape(trees(localRows=30).fit(table))
    monkeypatch.setattr(extra_trees, "OPEN_NODES", 3)
    assert shape(trees(localRows=30).fit(table)) == base


@pytest.mark.parametrize("features", [1, 2, 3, 7, 64, 700])
def test_random_orders_are_permutations(features):
    keys = np.repeat(np.array([11, -5, 2**40]), features)
    places = tg.place_of(keys, np.tile(np.arange(features), 3), features).reshape(3, features)
    assert (np.sort(places, axis=1) == np.arange(features)).all()
    if features > 60:
        assert (places[0] != places[1]).mean() > 0.9


@pytest.mark.parametrize("share", [0.01, 0.4, 1.0])
def test_splits_choose_among_a_fixed_number_of_features(table, share):
    """A node's split is the best valid one of the features drawn for it, by direct search."""
    rows = table.orderBy("posted_rate").collect()
    model = trees(numTrees=1, maxFeatures=share, minSamplesLeaf=5).fit(table)
    top = model.nodes.where("depth = 0").first()
    codes = {"blue": 0, "green": 1, "red": 2}
    x = np.array([[r["x"], r["z"], r["flat"]] for r in rows]).T
    c = np.array([[codes[r["c"]] for r in rows]])
    y = np.array([r["posted_rate"] for r in rows])
    seeds = tg.node_key(np.array([7], np.int64), 0)
    key = tg.mix(seeds.view(np.uint64)).view(np.int64)
    cuts = tg.random_cuts(key, x.min(axis=1)[:, None], x.max(axis=1)[:, None])[:, 0]
    sides = [x[j] <= cuts[j] for j in range(3)] + [c[0] == v for v in range(3)]
    place = tg.place_of(np.repeat(key, 6), np.arange(6), 6)
    drawn = place < max(1, int(share * 6))
    rank = [tg.gain_rank(np.float64(s.sum()), (y[s] - y.mean()).sum(), float(len(y)), 5) for s in sides]
    usable = [i for i in range(6) if rank[i] >= 0 and drawn[i]]
    best = max(usable, key=lambda i: (rank[i], -i)) if usable else min((i for i in range(6) if rank[i] >= 0), key=lambda i: place[i])
    assert top["feature"] == min(best, 3)
    if best < 3:
        assert top["threshold"] == pytest.approx(cuts[best])


def test_tallied_nodes_split_like_read_ones_and_only_smaller_children_are_counted(monkeypatch):
    """Sums by value, kept from parent to child, choose the splits that reading every row of every node chooses."""
    rng = np.random.default_rng(3)
    n = 4000
    x = np.stack([rng.integers(0, 40, n), rng.integers(0, 3, n), rng.normal(size=n), rng.integers(0, 500, n), np.full(n, 2)]).astype(float)
    x = np.concatenate([x, -x[:1] * 0.1])  # the same partitions as another column
    c = np.stack([rng.integers(0, 30, n), rng.integers(0, 300, n)])
    y = np.sort(rng.normal(size=n) * 1e3 + 50 * (c[0] == 4) + 90 * x[0])
    rules = tg.Rules(len(x), (30, 300), 200, 2, None)
    rows, seen = tg.Tally._count, []

    def counted(self, nodes, perm, starts, size):
        seen.append((size[nodes].sum(), size.sum()))
        return rows(self, nodes, perm, starts, size)

    monkeypatch.setattr(tg.Tally, "_count", counted)

    def grown():
        return tg.grow(x, c, y, np.tile(np.arange(n), 2), np.array([0, n]), np.array([5, 6]), np.zeros(2, np.int64), 7.0, rules)

    packs = []
    for tallied in ((), ((64, 20), (1024, 50))):
        monkeypatch.setattr(tg, "TALLIED", tallied)
        packs.append(grown())
    for name, one, other in zip(tg.Pack._fields, *packs, strict=True):
        assert np.array_equal(one, other), name
    assert seen and sum(a for a, _ in seen[2:]) <= sum(b for _, b in seen[2:]) / 2


def test_nodes_without_a_usable_drawn_feature_are_settled_together(monkeypatch):
    """They take the valid candidate that comes first in their order, which is made for all of them at once, not node by node."""
    rng = np.random.default_rng(5)
    n = 3000
    x, c = np.stack([rng.integers(0, 12, n), rng.integers(0, 2, n)]).astype(float), rng.integers(0, 5, (1, n))
    y = np.sort(rng.normal(size=n))
    rules = tg.Rules(2, (5,), 1, 2, None)
    calls, place_of = [], tg.place_of
    monkeypatch.setattr(tg, "place_of", lambda keys, feature, features: calls.append(len(keys)) or place_of(keys, feature, features))
    pack = tg.grow(x, c, y, np.arange(n), np.array([0]), np.array([9]), np.zeros(1, np.int64), 0.0, rules)
    assert len(calls) < (pack.feature >= 0).sum() / 2
    # Followed from the root by hand: where the drawn feature is of no use, the first usable one of the node's order.
    todo, followed = [(0, 9, np.arange(n))], 0
    while todo:
        at, key, rows = todo.pop()
        if pack.feature[at] < 0:
            continue
        keys = np.full(7, key)
        place = place_of(keys, np.arange(7), 7)
        cuts = tg.random_cuts(keys[:1], x[:, rows].min(axis=1)[:, None], x[:, rows].max(axis=1)[:, None])[:, 0]
        rights = [x[f, rows] > cuts[f] if not np.isnan(cuts[f]) else np.zeros(len(rows), bool) for f in (0, 1)] + [c[0, rows] == v for v in range(5)]
        best = min((f for f in range(7) if 2 <= rights[f].sum() <= len(rows) - 2), key=lambda f: place[f])
        assert (pack.feature[at], pack.category[at]) == ((best, 0) if best < 2 else (2, best - 2))
        followed += best != place.argmin()
        for side in (0, 1):
            todo.append((pack.left[at] + side, int(tg.node_key(np.array([key]), side + 1)[0]), rows[rights[best] == side]))
    assert followed > 20


def test_scans_route_rows_only_where_an_open_node_is():
    #        0
    #      1   2        of which 5 is split next; 6 is small, 3, 4, 7 and 8 lie in parts that are done
    #     3 4 5 6
    #    7 8
    feature = np.array([1, 0, 2, 0, tg.LEAF, tg.OPEN, tg.SMALL, tg.LEAF, tg.SMALL])
    left = np.array([1, 3, 5, 7, -1, -1, -1, -1, -1])
    nodes = {"feature": feature, "left": left}
    depth = np.array([0, 1, 1, 2, 2, 2, 2, 3, 3])
    found = tg.leading(nodes, depth, np.arange(9) == 5)
    assert (found >= 0).tolist() == [True, False, True] + 6 * [False] and found[[0, 2, 5, 6]].tolist() == [1, 2, tg.OPEN, tg.SMALL]
    assert (tg.leading(nodes, depth, np.zeros(9, bool)) < 0).all()


def test_a_group_of_packs_is_copied_for_the_rows_that_ask_for_it_only(table, monkeypatch):
    """Copies of lower packs grow with the rows in them, not with the table's rows times the trees' size."""
    model = trees(numTrees=2, localRows=40).fit(table)
    expected = scores(model, table)
    sides, meet = [], type(model)._meet
    monkeypatch.setattr(type(model), "_meet", lambda self, rows, packs, members: sides.append((rows, packs)) or meet(self, rows, packs, members))
    model.group_nodes, model.group_rows = 60, 50
    assert scores(model, table) == pytest.approx(expected)
    rows, packs = sides[1]
    asked = {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    copies = {(r["grp"], r["blocks"]) for r in packs.select("grp", "blocks").collect()}
    assert len(asked) > 3 and copies == {(g, -(-n // 50)) for g, n in asked.items()}


def test_unseen_category_matches_no_split(spark, table):
    model = trees().fit(table)
    new = spark.createDataFrame([(0, 5.0, 0.0, 4.0, "violet")], "id int, x double, z double, flat double, c string")
    got = scores(model, new)[0]
    assert 10 < got < 25  # the rate of the categories that are not "red"


def test_model_survives_saving(spark, table):
    path = scratch_path(spark, "saved")
    fitted = Pipeline(stages=[MedianImputer(inputCols=["x", "z", "flat"]), ModeImputer(inputCols=["c"]), trees()]).fit(table)
    fitted.write().overwrite().save(path)
    assert scores(PipelineModel.load(path), table) == scores(fitted, table)


def test_trees_learn_the_rates_and_beat_the_mean(spark, folder):
    result = ev.compare_models(features(spark, folder), CUT, ev.default_models(numTrees=3, maxDepth=6))
    mae = {r["model"]: r["MAE"] for r in result.collect()}
    assert mae["extra_trees"] < 0.4 * mae["dummy_mean"]


def test_walk_forward_and_tuning_tables(spark, folder):
    table = features(spark, folder)
    report = ev.walk_forward(table, FOLDS[:2], lambda roles: MeanRegressor()).collect()
    assert [r["fold"] for r in report] == [f.name for f in FOLDS[:2]]
    assert all(r["train_end"] < r["validation_start"] for r in report)
    small = {name: {**p, "numTrees": p["numTrees"] // 100, "maxDepth": p["maxDepth"] // 10 or 4} for name, p in ev.CONFIGURATIONS.items()}
    small["lone"] = {"numTrees": 2, "maxFeatures": 0.8}
    results = ev.tune(table, FOLDS[:1], small, minSamplesLeaf=2, numTrees=99, maxDepth=2).collect()
    assert [r["configuration"] for r in results] == list(small)
    assert len(ev._families(ev.CONFIGURATIONS, {})) == 5
    with ev.prepared(*ev.fold_frames(ev.drop_undated(table), FOLDS[0])) as (roles, fit_rows, score_on):
        for r in results:
            if r["configuration"] in ("baseline", "more_trees", "depth_30"):
                scored = ev.floor_predictions(ev.extra_trees(roles, **small[r["configuration"]]).fit(fit_rows).transform(score_on))
                assert r["MAE"] == pytest.approx(ev.regression_metrics(scored).first()["MAE"])


def test_final_fit_scores_new_loads_in_batch_and_as_a_stream(spark, folder):
    path = scratch_path(spark, "final")
    model = ev.final_fit(features(spark, folder), path, numTrees=2, maxDepth=4)
    new = clean(spark, folder).drop("posted_rate")
    batch = ev.score_batch(new, ev.load_model(spark, path))
    assert batch.columns == ["load_id", "predicted_rate"] and batch.count() == new.count()
    inbox, target, state = (scratch_path(spark, n) for n in ("inbox", "scored", "state"))
    new.write.parquet(inbox)
    for _ in range(2):  # the second run finds nothing new
        stream = scoring.load_stream(spark, inbox, new.schema)
        scoring.score_stream(stream, model, target, state).awaitTermination()
    streamed = spark.read.parquet(target).drop("batch")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_unreadable_model_is_a_contract_error(spark, tmp_path):
    with pytest.raises(ev.ContractError):
        ev.load_model(spark, str(tmp_path / "absent"))


def test_unlabelled_rows_are_not_trained_on_and_holdout_is_chronological(spark):
    rows = [(f"L{i}", float(i), None if i == 3 else 10.0 * i, dt.date(2025, 1, 1) + dt.timedelta(days=i)) for i in range(8)]
    df = spark.createDataFrame(rows, "load_id string, v double, posted_rate double, date date")
    train, valid = holdout(df, dt.date(2025, 1, 6))
    model, scored = ev.evaluate_model(MeanRegressor(), train, valid)
    assert {r["predicted_rate"] for r in scored.collect()} == {(0 + 10 + 20 + 40) / 4}
    assert rate_model(df, MeanRegressor()).getStages()[-1].getLabelCol() == "posted_rate"


def test_queries_fit_the_published_forests_on_every_fold(spark, folder, monkeypatch):
    from ratelens.plans import modeling

    fitted = []

    def stop(self, rows):
        fitted.append((self.getOrDefault("numTrees"), self.getOrDefault("maxFeatures"), self.getOrDefault("minSamplesLeaf"), self.getOrDefault("maxDepth")))
        raise StopIteration

    monkeypatch.setattr(ExtraTreesRegressor, "_fit", stop)
    for name in ("ml12_extra_trees", "ml17_18_compare_models", "ml24_25_final_scores"):
        with pytest.raises(StopIteration):
            modeling.QUERIES[name].run(spark, folder)
    assert fitted == [(300, 0.8, 2, 0)] * 3
    grid = []
    monkeypatch.setattr(modeling, "tune", lambda table, folds, *args, **common: grid.append((list(folds), args, common)) or spark.createDataFrame([], ev.RESULT_SCHEMA))
    modeling.QUERIES["ml22_tuning_grid"].run(spark, folder)
    assert grid == [(list(FOLDS), (), {})] and len(FOLDS) == 4
