"""SimHash near-duplicates: a self-join of fingerprints in a binary trie."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import map_text, named, scratch_table, set_aside
from ratelens.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints on either side of a pair of trie nodes that one task joins; larger pairs are split further down.
NODE_ROWS = 16_384
#: Rows are spread by fingerprint except those of fingerprints with a larger share; there are at most 1 / HOT of them.
HOT = 0.001
_LEAF = 64
_CHUNK = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: each is set if over half the shingle hashes have it; zero without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [
        digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    ]
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` without the text, with the fingerprint as signed 64-bit integer ``_fp``."""

    def work(texts: list[bytes], _: pa.RecordBatch) -> list[pa.Array]:
        found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return [pa.array(found.view(np.int64), type=pa.int64())]

    return map_text(docs, text_col, [T.StructField("_fp", T.LongType())], work, (text_col,))


# --- pairs of trie nodes -----------------------------------------------------------------------------------------


def _descend(rows: DataFrame, bits: int, max_bits: int) -> DataFrame:
    """Hand each fingerprint from its pair of nodes on to the pairs ``bits`` further down that can hold partners.

    A row is a fingerprint under the pair (a, b) of prefixes of ``depth`` bits, on the side of a (0), of b (1) or, where
    both are the same node, of both (2). The bits in which a and b differ are spent; pairs over the budget are pruned.
    """
    masks = sorted(range(1 << bits), key=int.bit_count)
    masks = [m for m in masks if m.bit_count() <= max_bits]
    table = F.array(*[F.lit(m).cast("long") for m in masks])
    within = [sum(m.bit_count() <= left for m in masks) for left in range(max_bits + 1)]
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    allowed = F.element_at(F.array(*[F.lit(n) for n in within]), F.lit(max_bits + 1) - spent)
    rows = rows.withColumn("mask", F.explode(F.slice(table, 1, allowed)))
    below = F.expr(f"shiftrightunsigned(fp, 64 - depth - {bits}) & {(1 << bits) - 1}L")
    rows = rows.withColumn("own", below).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))

    def node(parent: str, child: Column) -> Column:
        return F.shiftleft(parent, bits).bitwiseOR(child)

    both, first = F.col("side") == 2, F.col("side") == 0
    own, other = F.col("own"), F.col("other")
    return rows.select(
        "fp",
        (F.col("depth") + bits).alias("depth"),
        node("a", F.when(both, F.least(own, other)).when(first, own).otherwise(other)).alias("a"),
        node("b", F.when(both, F.greatest(own, other)).when(first, other).otherwise(own)).alias("b"),
        F.when(~both, F.col("side")).when(F.col("mask") == 0, 2).when(own < other, 0).otherwise(1).alias("side"),
    )


def _placed(prints: DataFrame, max_bits: int, node_rows: int) -> DataFrame:
    """Fingerprints under pairs of nodes that hold at most ``node_rows`` each, or a single value."""
    count = prints.count()
    bits = min(20, max(0, math.ceil(math.log2(max(1, count) / node_rows))))
    zero = F.lit(0).cast("long")
    rows = prints.select("fp", F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(2).alias("side"))
    if not bits:
        return rows
    rows = _descend(rows, bits, max_bits)
    done = None
    while True:
        rows = scratch_table(rows, "nodes")
        key = ["depth", "a", "b"]
        large = rows.groupBy(*key).count().where((F.col("count") > 4 * node_rows) & (F.col("depth") <= 60)).select(*key)
        large = scratch_table(large, "large")
        fit = rows.join(large, key, "left_anti")
        done = fit if done is None else done.union(fit)
        if large.isEmpty():
            return done
        rows = _descend(rows.join(large, key), 4, max_bits)


def _close_pairs(a: np.ndarray, b: np.ndarray, same: bool, depth: int, spent: int, max_bits: int):
    """Index pairs of sorted fingerprints within the budget, in chunks, from a traversal of both tries together.

    A node is an interval of the sorted values. Level by level every pair of nodes gives pairs of their children; a
    differing bit is added to its count, and pairs over the budget or with an empty node are dropped. Small pairs are
    compared value by value.
    """
    if not len(a) or not len(b):
        return
    alo, ahi = np.array([0]), np.array([len(a)])
    blo, bhi, used, one = np.array([0]), np.array([len(b)]), np.array([spent]), np.array([same])
    while len(alo):
        size = (ahi - alo) * (bhi - blo)
        leaf = (size <= _LEAF) | (depth == 64)
        yield from _compare(a, b, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], one[leaf], max_bits)
        alo, ahi, blo, bhi, used, one = (x[~leaf] for x in (alo, ahi, blo, bhi, used, one))
        if not len(alo):
            return
        amid, bmid = _middle(a, alo, ahi, depth), _middle(b, blo, bhi, depth)
        parts = [
            (alo, amid, blo, bmid, used, one), (amid, ahi, bmid, bhi, used, one),
            (alo, amid, bmid, bhi, used + 1, np.zeros_like(one)),
        ]
        two = ~one  # the fourth pair of a node with itself mirrors the third
        parts.append((amid[two], ahi[two], blo[two], bmid[two], used[two] + 1, one[two]))
        alo, ahi, blo, bhi, used, one = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (used <= max_bits) & (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, used, one = (x[keep] for x in (alo, ahi, blo, bhi, used, one))
        depth += 1


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at ``depth`` turns to one in each interval."""
    ones = np.concatenate([[0], np.cumsum(values >> np.uint64(63 - depth) & np.uint64(1), dtype=np.int64)])
    return hi - (ones[hi] - ones[lo])


def _compare(a, b, alo, ahi, blo, bhi, one, max_bits):
    width = bhi - blo
    size = (ahi - alo) * width
    # Whole leaves per chunk; a leaf is small, or one value against itself.
    bounds = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // _CHUNK)) + 1).tolist(), len(size)]
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        n, w = size[first:last], width[first:last]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(w, n)
        i, j = np.repeat(alo[first:last], n) + at // w, np.repeat(blo[first:last], n) + at % w
        near = (np.bitwise_count(a[i] ^ b[j]) <= max_bits) & (~np.repeat(one[first:last], n) | (i < j))
        yield i[near], j[near]


def _join_nodes(key: tuple, rows: pa.Table, max_bits: int) -> pa.Table:
    """Edges that connect what one pair of nodes connects: each linked value to the least value of its group."""
    fp = rows["fp"].to_numpy().view(np.uint64)
    side, depth = rows["side"].to_numpy(), key[0].as_py()
    same = bool((side == 2).all())
    a = np.unique(fp[side != 1])
    b = a if same else np.unique(fp[side == 1])
    spent = (key[1].as_py() ^ key[2].as_py()).bit_count()
    values = a if same else np.concatenate([a, b])
    label = np.arange(len(values))
    shift = 0 if same else len(a)
    for i, j in _close_pairs(a, b, same, depth, spent, max_bits):
        _unite(label, i, j + shift)
    linked = label != np.arange(len(label))
    out = [values[linked].view(np.int64), values[label[linked]].view(np.int64)]
    return pa.table([pa.array(x) for x in out], names=["u", "v"])


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked values the least label of their group, in place."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def linked_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``node``, ``root`` for distinct fingerprints ``fp`` that are linked, directly or over others."""
    placed = _placed(prints, max_bits, node_rows)
    edges = placed.groupBy("depth", "a", "b").applyInArrow(
        lambda key, rows: _join_nodes(key, rows, max_bits), "u bigint, v bigint"
    )
    return connected_components(edges)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """Every row's id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id reachable.

    Texts whose fingerprints differ in at most ``max_bits`` bits are linked. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. Copies meet in their common fingerprint: only distinct fingerprints
    are joined, and a node of the trie hands on a spanning star, not its pairs. Repeated rows are all returned; null ids
    are never the least id of a group that has another; other columns are ignored, an empty table gives no rows.
    """
    rows = set_aside(docs.select(named(id_col), named(text_col).cast("string")))
    prints = scratch_table(fingerprints(rows, "_c1", shingle), "prints")
    each = prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("_c0").alias("least"), F.count("*").alias("n"))
    each = scratch_table(each, "distinct")
    links = linked_fingerprints(each.select("fp"), max_bits, node_rows)
    group = each.join(links, each.fp == links.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    group = scratch_table(group, "groups")
    total = group.groupBy("root").agg(F.min("least").alias("component_id"))
    found = group.join(total, "root").select(F.col("fp").alias("_fp"), "n", "component_id")
    # Each fingerprint of over HOT of all rows is one of at most 1 / HOT, so their table can go to every task.
    hot_rows = F.lit(max(1.0, HOT * prints.count()))
    hot = found.where(F.col("n") > hot_rows).select("_fp", F.col("component_id").alias("_hot"), F.lit(True).alias("_is"))
    rows = prints.join(F.broadcast(hot), "_fp", "left")
    few = rows.where("_is is null").drop("_hot", "_is").join(found.where(F.col("n") <= hot_rows).drop("n"), "_fp")
    out = rows.where("_is").select("_fp", "_c0", F.col("_hot").alias("component_id")).unionByName(few)
    digits = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return out.select(F.col("_c0").alias(id_col), digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one of the least id, of repeated rows one.

    The result has the columns of ``docs``; rows with a null id come after others of their group.
    """
    rows = set_aside(docs)
    key, text = (rows.columns[docs.columns.index(c)] for c in (id_col, text_col))
    rows = scratch_table(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), F.col("_row").alias("row"))
    found = near_duplicates(rows.select(order.alias("_key"), text), id_col="_key", text_col=text, **options)
    kept = found.where(F.col("_key") == F.col("component_id")).select(F.col("_key.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").drop("_row").toDF(*docs.columns)
