"""Exact quantiles by repeated narrowing, without ever holding a group's values in one task.

The built-in exact ``percentile`` merges a value -> count map of the complete group in one reducer. Here every requested rank
lies in a bracket, at first the group's least and greatest value. A pass counts the rows of each bracket in even
sub-ranges, with the least and greatest value of each; the sub-range that holds a rank becomes its bracket. Brackets do
not overlap, so a row counts once, and they shrink with every pass, whatever the distribution. As soon as all of them
hold few rows, one more pass ranks their values. Reducers get at most one row per task and sub-range, and no window
sees more than the sub-ranges or the few values of a bracket.

Without ``exact`` two-level merged KLL sketches answer: a sketch per group and block of map tasks, then one per group.

Each pass reads the input again. Callers whose input is more than a scan pass it through ``hand_over`` first.

``column_quantile`` answers for the columns of a table at once. A sample of fixed size gives each column a bracket that is
likely to hold the rank; one scan counts all rows below, on and in the brackets, exactly, and only the few rows inside are
listed and narrowed as above. A column whose rank lies elsewhere is narrowed from its least and greatest value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.session import ensure_checkpoint_folder
from ratelens.sources.files import scratch_path

#: Sub-ranges of a bracket, and rows of a bracket whose values are ranked at last.
CELLS, FEW = 4096, 10_000
#: Sketches answer within n / ACCURACY ranks; blocks of map tasks whose sketches are merged first.
ACCURACY, BLOCKS = 10_000, 64
#: Rows of the sample that proposes brackets, and by how many standard errors of a rank they are wide.
SAMPLE, ERRORS = 1 << 18, 4
#: Rows of a few hundred bytes: about 30 MB at most.
BROADCAST_GROUPS = 100_000

_VALUE, _ALL = "__value", "__all"


def hand_over(df: DataFrame) -> DataFrame:
    """Write a column-pruned table to the shared folder once, for several passes to read."""
    path = scratch_path(df.sparkSession, "hand-over")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_table(per_group: DataFrame) -> DataFrame:
    """Checkpoint a table with one row per group and broadcast it if it is small enough.

    Spark cannot know the size of an aggregate beforehand and would shuffle the large side of a join before finding out.
    """
    ensure_checkpoint_folder(per_group.sparkSession)
    table = per_group.checkpoint()
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def quantiles(
    df: DataFrame,
    value: str | Column,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    aggregates: Sequence[Column] = (),
    exact: bool = True,
    accuracy: int | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """One row per group: ``by`` columns, ``aggregates``, then one column per probability.

    Linear interpolation between neighbouring order statistics; NULL values are ignored; rows with a NULL group key are left
    out. ``aggregates`` ride along in the first pass. ``exact=False`` stops after the sketches (rank error about
    ``n / accuracy``). With ``exact``, ``accuracy`` sets the sub-ranges of a bracket and the rows that are few.
    ``few_groups=True`` (groups are columns, not data) affords a finer sketch.
    """
    by = list(by)
    names = sorted(probabilities, key=probabilities.get)
    probs = [float(probabilities[n]) for n in names]
    rows = df.withColumn(_VALUE, (F.col(value) if isinstance(value, str) else value).cast("double"))
    for key in by:
        rows = rows.where(F.col(key).isNotNull())
    if not exact:
        return _approximate(rows, by, aggregates, names, probs, accuracy or ACCURACY * (10 if few_groups or not by else 1))

    cells, few = (max(2, accuracy), accuracy) if accuracy else (CELLS, FEW)
    keys = by or [_ALL]
    rows = rows if by else rows.withColumn(_ALL, F.lit(0))
    present = F.col(_VALUE)
    facts = [F.count(present).alias("__n"), F.min(present).alias("__lo"), F.max(present).alias("__hi")]
    # Without groups there is a row even if there are no rows.
    first = rows.groupBy(*by).agg(*aggregates, *facts) if by else rows.agg(*aggregates, *facts).withColumn(_ALL, F.lit(0))
    ensure_checkpoint_folder(df.sparkSession)
    first = first.checkpoint()
    values = rows.where(present.isNotNull()).select(*keys, _VALUE)
    found = _order_statistics(values, first, keys, probs, cells, few)
    at = F.map_from_entries("__found")
    picked = []
    for name, p in zip(names, probs, strict=True):
        position = (F.col("__n") - 1) * F.lit(p)
        low, high = F.floor(position) + 1, F.ceil(position) + 1
        v = F.element_at(at, low)
        picked.append((v + (F.element_at(at, high) - v) * (position - F.floor(position))).alias(name))
    out = first.join(group_table(found), keys, "left")
    kept = [c for c in first.columns if c not in ("__n", "__lo", "__hi", _ALL)]
    return out.select(*kept, *picked)


def column_quantile(df: DataFrame, columns: Sequence[str], p: float, sample: int = SAMPLE) -> DataFrame:
    """``column, value``: the exact quantile of each double column, NULL for one without values; no rows for an empty table.

    Linear interpolation between neighbouring order statistics; NULL values are ignored, others must be finite. A row per
    column reaches the driver. ``sample`` only says how many rows propose the brackets.
    """
    spark, schema = df.sparkSession, "column string, value double"
    n = df.count()
    if not n:
        return spark.createDataFrame([], schema)
    ensure_checkpoint_folder(spark)
    wide = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    everywhere = (-math.inf, math.inf)
    brackets = _proposed(wide if n <= sample else wide.sample(False, sample / n, 0), p)
    facts = []
    for c in wide.columns:
        lo, hi = (F.lit(x) for x in brackets.get(c, everywhere))
        v = F.col(c)
        within = F.when((v > lo) & (v < hi), v)
        facts.append(F.array(F.count(v), F.count_if(v < lo), F.count_if(v == lo), F.count(within), F.count_if((v == hi) & (v > lo))).alias(f"n{c}"))
        facts.append(F.array(F.min(v), F.max(v), F.min(within), F.max(within)).alias(f"e{c}"))
    counted = wide.agg(*facts).first()
    known: dict[str, dict[int, float]] = {c: {} for c in wide.columns}
    positions, open_ = {}, []
    for c in wide.columns:
        present, below, least, within, most = counted[f"n{c}"]
        if not present:
            continue
        lo, hi = brackets.get(c, everywhere)
        positions[c] = (present - 1) * p
        ranks = sorted({math.floor(positions[c]) + 1, math.ceil(positions[c]) + 1})
        if below < ranks[0] and ranks[-1] <= below + least + within + most:
            known[c] = {r: lo if r <= below + least else hi for r in ranks if not below + least < r <= below + least + within}
            left = [r for r in ranks if r not in known[c]]
            if left:
                open_.append((c, *counted[f"e{c}"][2:], below + least, within, left, lo, hi))
        else:
            open_.append((c, *counted[f"e{c}"][:2], 0, present, ranks, *everywhere))
    if open_:
        inside = [F.when((F.col(c) > lo) & (F.col(c) < hi), F.col(c)).alias(c) for c, *_, lo, hi in open_]
        long = wide.select(*inside).unpivot([], [b[0] for b in open_], "column", _VALUE).where(F.col(_VALUE).isNotNull())
        start = spark.createDataFrame([b[:6] for b in open_], "column string, lo double, hi double, skip bigint, inside bigint, ranks array<bigint>")
        for row in _settled(hand_over(long), start, ["column"], CELLS, FEW).collect():
            known[row["column"]].update({f["r"]: f["lo"] for f in row["__found"]})
    rows = []
    for c, name in zip(wide.columns, columns, strict=True):
        value = None
        if c in positions:
            at = math.floor(positions[c])
            low, high = known[c][at + 1], known[c][math.ceil(positions[c]) + 1]
            value = low + (high - low) * (positions[c] - at)
        rows.append((name, value))
    return spark.createDataFrame(rows, schema)


def _proposed(sampled: DataFrame, p: float) -> dict[str, tuple[float, float]]:
    """Bounds of each column that are likely to enclose its quantile, from the values of a sample."""
    long = sampled.unpivot([], sampled.columns, "column", "value").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("column").orderBy("value"))
    placed = counts.withColumns({"upto": upto, "n": F.sum("k").over(Window.partitionBy("column"))})
    off = F.ceil(F.sqrt("n") * ERRORS / 2) + 1
    low, high = F.floor((F.col("n") - 1) * p) + 1 - off, F.ceil((F.col("n") - 1) * p) + 1 + off
    first = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("value")))
    found = placed.groupBy("column").agg(first(low).alias("lo"), first(high).alias("hi"), F.min(low).alias("low"))
    # A bound beyond the sample's ends is none at all.
    return {r["column"]: (r["lo"] if r["low"] >= 1 else -math.inf, math.inf if r["hi"] is None else r["hi"]) for r in found.collect()}


def _order_statistics(values: DataFrame, first: DataFrame, keys: list[str], probs: list[float], cells: int, few: int) -> DataFrame:
    """Per group ``__found``: (rank, value) of every rank that the probabilities need."""
    positions = [(F.col("__n") - 1) * F.lit(p) for p in probs]
    ranks = F.array_sort(F.array_distinct(F.array(*[f(x) + 1 for x in positions for f in (F.floor, F.ceil)])))
    brackets = first.where("__n > 0").select(
        *keys, F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.lit(0).cast("long").alias("skip"), F.col("__n").alias("inside"), ranks.alias("ranks")
    )
    return _settled(values, brackets, keys, cells, few)


def _settled(values: DataFrame, brackets: DataFrame, keys: list[str], cells: int, few: int) -> DataFrame:
    """Per group ``__found``: (rank, value) of every rank of its ``brackets``."""
    brackets = brackets.checkpoint()
    done = brackets.where("lo = hi")
    while True:
        open_ = brackets.where("lo < hi")
        most = open_.agg(F.max("inside")).first()[0]
        if most is None:
            break
        if most <= few:
            done = done.unionByName(_ranked(values, open_, keys))
            break
        brackets = _narrowed(values, open_, keys, cells).checkpoint()
        done = done.unionByName(brackets.where("lo = hi"))
    each = done.select(*keys, F.explode("ranks").alias("r"), "lo")
    return each.groupBy(*keys).agg(F.collect_list(F.struct("r", "lo")).alias("__found"))


def _inside(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the bracket ``b`` they lie in; brackets of a group do not overlap."""
    parts = brackets.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "skip", "ranks")).alias("__brackets"))
    joined = values.join(group_table(parts), keys)
    mine = F.filter("__brackets", lambda b: (b["lo"] <= F.col(_VALUE)) & (F.col(_VALUE) <= b["hi"]))
    return joined.select(*keys, _VALUE, F.get(mine, F.lit(0)).alias("b")).where("b is not null")


def _hit(counted: DataFrame, keys: list[str], order: str, extra: list[Column]) -> DataFrame:
    """Counted sub-ranges or values that hold a rank, with what lies before them."""
    running = Window.partitionBy(*keys, "b.lo").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto", F.sum("inside").over(running) + F.col("b.skip"))
    before = F.col("upto") - F.col("inside")
    ranks = F.filter("b.ranks", lambda r: (before < r) & (r <= F.col("upto")))
    return placed.select(*keys, *extra, before.alias("skip"), "inside", ranks.alias("ranks")).where(F.size("ranks") > 0)


def _narrowed(values: DataFrame, brackets: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """The sub-ranges that hold ranks, as new brackets."""
    inside = _inside(values, brackets, keys)
    # Halved, no difference overflows; every step is monotonic, so sub-ranges keep the order of the values.
    v, lo, hi = F.col(_VALUE) * 0.5, F.col("b.lo") * 0.5, F.col("b.hi") * 0.5
    cell = F.least(F.lit(cells - 1), F.floor((v - lo) / (hi - lo) * cells)).cast("int")
    cell = F.when(F.col(_VALUE) == F.col("b.hi"), cells - 1).otherwise(cell)
    counted = inside.groupBy(*keys, "b", cell.alias("cell")).agg(F.count(F.lit(1)).alias("inside"), F.min(_VALUE).alias("lo"), F.max(_VALUE).alias("hi"))
    return _hit(counted, keys, "cell", [F.col("lo"), F.col("hi")])


def _ranked(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The values that hold ranks, of brackets with few rows."""
    counted = _inside(values, brackets, keys).groupBy(*keys, "b", _VALUE).agg(F.count(F.lit(1)).alias("inside"))
    return _hit(counted, keys, _VALUE, [F.col(_VALUE).alias("lo"), F.col(_VALUE).alias("hi")])


def _approximate(rows: DataFrame, by: list[str], aggregates: Sequence[Column], names: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """Quantiles from sketches that are merged twice, so that no task gets one of every map task."""
    size = F.lit(min(65_535, max(64, 6 * accuracy)))
    keys = by or [_ALL]
    keyed = rows if by else rows.withColumn(_ALL, F.lit(0))
    block = F.pmod(F.spark_partition_id(), F.lit(BLOCKS)).alias("__block")
    sketches = keyed.where(F.col(_VALUE).isNotNull()).groupBy(*keys, block).agg(F.kll_sketch_agg_double(_VALUE, size).alias("__sketch"))
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("__sketch", size).alias("__sketch"))
    picked = [F.kll_sketch_get_quantile_double("__sketch", F.lit(p)).alias(n) for n, p in zip(names, probs, strict=True)]
    facts = [*aggregates, F.count(_VALUE).alias("__n")]
    first = rows.groupBy(*by).agg(*facts) if by else rows.agg(*facts).withColumn(_ALL, F.lit(0))
    out = first.join(merged.select(*keys, *picked), keys, "left")
    return out.drop("__n", *([] if by else [_ALL]))
