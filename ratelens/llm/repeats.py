"""Exact repeats of long byte strings, found over content-defined anchors and removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import named, scratch_table, text_of

LENGTH = 400
_GRAM = 8
#: Characters scanned at once; bounds the arrays of a very long text.
_SCAN = 1 << 20


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor's position with the least and the greatest distance to the starts of strings it stands for.

    The anchor of a string of ``length`` bytes is the leftmost least 8-byte hash of its first half, so equal strings have
    anchors at equal distances. Consecutive starts share anchors.
    """
    width = length // 2 - _GRAM
    starts = len(text) - length + 1
    found = [_scan(text[at : min(at + _SCAN, starts) + length - 1], at, width) for at in range(0, max(0, starts), _SCAN)]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scan(text: bytes, base: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = len(text) - 2 * (width + _GRAM) + 1
    data = np.frombuffer(text[: starts + width + 2 * _GRAM], dtype=np.uint8)
    size = starts + width - 1  # grams that any start looks at
    gram = np.zeros(size, dtype=np.uint64)
    for k in range(_GRAM):
        gram |= data[k : k + size].astype(np.uint64) << np.uint64(8 * k)
    gram *= np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    ranked = (gram >> np.uint64(22) << np.uint64(22)) | np.arange(size, dtype=np.uint64)
    # Least of each window: the running least up to a block's end, and from the next block's start on.
    padded = np.full(-(-size // width) * width, np.uint64(2**64 - 1))
    padded[:size] = ranked
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64((1 << 22) - 1)
    at = least.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    return at[first] + base, at[first] - last, at[first] - first


_ANCHORS = "array<struct<key:bigint,ctx:bigint,pos:int,lo:int,hi:int>>"
_ANCHORS_ARROW = pa.list_(pa.struct([("key", pa.int64()), ("ctx", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _anchored(length: int):
    """Anchors with two hashes: ``key`` of the bytes all their strings share, ``ctx`` of all bytes of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows, sizes, shas = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = []
                for pos, lo, hi in zip(*[x.tolist() for x in anchors(text, length)], strict=True):
                    own = digest(text[pos : pos + length // 2], 1)
                    context = digest(text[pos - hi : pos - lo + length], lo << 20 | hi)
                    found.append({"key": _signed(own), "ctx": _signed(context), "pos": pos, "lo": lo, "hi": hi})
                rows.append(found)
                sizes.append(len(text))
                shas.append(hashlib.sha256(text).hexdigest())
            columns = [pa.array(sizes, type=pa.int64()), pa.array(shas, type=pa.string()), pa.array(rows, type=_ANCHORS_ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["_id", "_tid", "n_bytes", "_sha", "_a"])

    return run


def _strings(length: int):
    """A 64-bit hash of each string of the anchors in question; with the key, 128 bits tell strings apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        names = ["digest", "key", "ctx", "delta"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            for text, found in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = [
                    (_signed(digest(text[a["pos"] - d : a["pos"] - d + length], 2)), a["key"], a["ctx"], d)
                    for a in found for d in range(a["lo"], a["hi"] + 1)
                ]
                for at in range(0, len(out), 100_000):
                    part = out[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], type=k) for i, k in enumerate(kinds)], names=names)

    return run


def _cut(length: int):
    """The text without what its marked anchors' strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, shas, kept = [], [], [], []
            for text, marks in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                edge = np.zeros(len(text) + 1, dtype=np.int32)
                for m in marks:
                    if m["deltas"] is None:
                        edge[m["pos"] - m["hi"]] += 1
                        edge[m["pos"] - m["lo"] + length] -= 1
                    else:
                        for d in m["deltas"]:
                            edge[m["pos"] - d] += 1
                            edge[m["pos"] - d + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            columns = [pa.array(x, type=k) for x, k in ((removed, pa.int64()), (spans, pa.int64()), (shas, pa.string()), (kept, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_tid", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row, with ``with_text`` also ``kept`` bytes.

    Bytes covered by a string of ``length`` bytes that also starts anywhere else are removed, judged on the input. Null
    texts are empty; ``kept`` is null where nothing is removed. Repeated rows are reported each, other columns are
    ignored, an empty table gives no rows.

    Equal texts are one text with a number of copies from the first shuffle on. An anchor whose strings all occur twice
    is known from the count of its context; only anchors that share half a string with another context have their
    strings hashed one by one. Texts move once for these and once for the texts that something is removed from.
    """
    rows = docs.select(named(id_col).alias("_id"), text_of(text_col).alias("_t"))
    rows = rows.select("_id", F.unhex(F.md5("_t")).alias("_tid"), "_t")
    kind = rows.schema["_id"].dataType.simpleString()
    every = rows.mapInArrow(_anchored(length), f"_id {kind}, _tid binary, n_bytes bigint, _sha string, _a {_ANCHORS}")
    every = scratch_table(every, "anchors")
    texts = every.groupBy("_tid").agg(F.count("*").alias("copies"), F.first("_a").alias("_a"))
    texts = scratch_table(texts, "texts")
    each = texts.select("_tid", "copies", F.explode("_a").alias("a")).select("_tid", "copies", "a.*")
    place = F.struct("_tid", "pos", "lo", "hi")
    contexts = scratch_table(each.groupBy("key", "ctx").agg(F.sum("copies").alias("n"), F.min(place).alias("at")), "contexts")
    shared = contexts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    asked = contexts.join(shared, "key").select("at._tid", F.struct("key", "ctx", "at.pos", "at.lo", "at.hi").alias("a"))
    asked = asked.groupBy("_tid").agg(F.collect_list("a").alias("_asked"))
    single = rows.select("_tid", "_t")
    texts_asked = single.join(asked.select("_tid"), "_tid", "left_semi").dropDuplicates(["_tid"]).join(asked, "_tid")
    strings = texts_asked.select("_t", "_asked").mapInArrow(_strings(length), "digest bigint, key bigint, ctx bigint, delta int")
    strings = scratch_table(strings, "strings")
    twice = strings.groupBy("key", "digest").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("a != b").select("key", "digest")
    deltas = strings.join(twice, ["key", "digest"], "left_semi").groupBy("key", "ctx").agg(F.collect_set("delta").alias("deltas"))
    marked = contexts.join(deltas, ["key", "ctx"], "left").where("n > 1 or deltas is not null")
    marked = marked.select("key", "ctx", F.when(F.col("n") == 1, F.col("deltas")).alias("deltas"))
    found = each.where("copies = 1").join(marked, ["key", "ctx"]).groupBy("_tid").agg(F.collect_list(F.struct("pos", "lo", "hi", "deltas")).alias("_marks"))
    cut = single.join(found, "_tid").select("_tid", "_t", "_marks")
    cut = cut.mapInArrow(_cut(length), "_tid binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    cut = cut if with_text else cut.drop("kept")
    out = every.drop("_a").join(texts.select("_tid", "copies"), "_tid").join(cut, "_tid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    columns = [
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(F.col("_id").alias(id_col), "n_bytes", *columns)
