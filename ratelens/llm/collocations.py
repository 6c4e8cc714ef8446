"""Phrases and their collocation scores by Toivonen's sampling method.

A sample of the rows proposes phrases at a lowered threshold. One pass over all rows counts, exactly, the proposed phrases and
their negative border: phrases that are not proposed while their parts without the first and the last word are (all words
belong to it). The border is never listed: a task tests the two parts of every phrase it meets. Where a phrase of the border
turns out to be frequent, its extensions have not been counted; an expansion pass counts those, and theirs at once, which
closes the set: the parts of a frequent phrase that is not counted yet are frequent, so proposed, missed or counted now.

Tasks get the proposals as a bitmap of fixed size. Two phrases may share a bit; that only makes a task count more.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import named, scratch_table, text_of

#: Least occurrences and most words of a phrase, phrases returned per language, name of a null language.
SUPPORT, LONGEST, TOP, NO_LANG = 100, 5, 2000, "und"
#: One row in SHARE is sampled; a phrase with SUPPORT occurrences falls below the lowered threshold at DEVIATIONS of its spread.
SHARE, DEVIATIONS = 8, 0.5
#: Bits of the bitmap (as a power of two), bytes of text that are counted at once, bytes up to which running sums hash a word.
BITS, SLICE, SHORT = 27, 1 << 21, 256

# Constants of the published splitmix64 bit mixer, and an odd number as base.
_GOLDEN, _MIX_1, _MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_BASE = 0xD6E8FEB86659FD93

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ENDS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.array([2 if b in _ENDS else b in b" \t" for b in range(256)], dtype=np.uint8)
_LAST_END = re.compile(b"[" + re.escape(_ENDS) + b"]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX_2)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))


class _Powers:
    """Powers of the base of the hashes and of its inverse, kept from slice to slice."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def upto(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < length:
            powers = np.ones((2, length + SLICE // 8), dtype=np.uint64)
            powers[0, 1:], powers[1, 1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.up, self.down = np.multiply.accumulate(powers, axis=1)
        return self.up[:length], self.down


def _word_hashes(data: bytes, starts: np.ndarray, stops: np.ndarray, powers: _Powers) -> list[np.ndarray]:
    """Two hashes of each word: one of all its bytes, from running sums, and one of its length and first and last eight.

    Sums modulo 2^64 are equal for some regular pairs of long words, whatever the base; a digest tells those apart.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    up, down = powers.upto(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.multiply(_BYTES[raw], up, out=sums[1:])
    np.cumsum(sums, out=sums)
    size = (stops - starts).astype(np.uint64)
    one = _mix((sums[stops] - sums[starts]) * down[starts] + size)
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=data + bytes(8), strides=(1,))
    beyond = np.uint64(64) - np.uint64(8) * np.minimum(size, np.uint64(8))
    two = _mix(eight[starts] << beyond ^ _mix(eight[np.maximum(stops - 8, starts)] << beyond ^ size))
    for i in np.flatnonzero(size > SHORT).tolist():
        one[i], two[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : stops[i]], digest_size=16).digest(), dtype="<u8")
    return [one, two]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int], list[str]]]:
    """Lower-cased texts of about SLICE bytes in all, each followed by a line end: data, end of each text, language of each.

    A text longer than that goes in parts, cut after a piece; only a piece without end is taken in one.
    """
    parts: list[bytes] = []
    ends: list[int] = []
    langs: list[str] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text, at = text.as_py(), 0
            while at < len(text):
                upto = len(text)
                if upto - at > SLICE:
                    found = _LAST_END.search(text, at + SLICE)
                    upto = found.end() if found else upto
                parts += [text[at:upto], b"\n"]
                size += upto - at + 1
                at = upto
                ends.append(size)
                langs.append(lang)
                if size >= SLICE:
                    yield b"".join(parts).translate(_LOWER), ends, langs
                    parts, ends, langs, size = [], [], [], 0
    if parts:
        yield b"".join(parts).translate(_LOWER), ends, langs


def _member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one phrase of each group of equal phrases, and the group's size; equal are those with both hashes equal."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    starts = np.flatnonzero(np.concatenate(([True], ~same))) if len(a) else np.zeros(0, dtype=np.int64)
    return order[starts], np.diff(np.append(starts, len(a)))


class _Slice:
    """The words of a slice with their pieces, languages and two hashes each."""

    def __init__(self, powers: _Powers, data: bytes, ends: list[int], langs: list[str]):
        self.data = data
        kind = _KIND[np.frombuffer(data, dtype=np.uint8)]
        edges = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.starts, self.stops = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        # As Python strings: numpy's own drop trailing zero characters, which would join two languages.
        self.names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.lang = code[np.searchsorted(np.array(ends), self.starts, side="right")]
        seeds = np.array([_seed(n) for n in self.names], dtype=np.uint64)
        self.words = [_mix(w ^ seeds[self.lang]) for w in _word_hashes(data, self.starts, self.stops, powers)]

    def _longer(self, grams: list[np.ndarray], n: int, fits: np.ndarray) -> np.ndarray:
        """Places of phrases of ``n`` words in one piece whose parts without the last and the first word both fit.

        ``grams`` holds the hashes of the shorter phrases and gets those of the longer ones, at their places.
        """
        at = np.flatnonzero(fits[: len(fits) - n + 1] & fits[1 : len(fits) - n + 2])
        at = at[self.piece[at] == self.piece[at + n - 1]]
        for g, w in zip(grams, self.words, strict=True):
            g[at] = _mix(g[at] * np.uint64(_GOLDEN) + w[at + n - 1])
        return at

    def counts(self, known: np.ndarray, sizes: range) -> Iterator[pa.RecordBatch]:
        """``hash, tag, f``: occurrences of the phrases of ``sizes`` words whose two parts are ``known``, and of all words."""
        grams, at = [w.copy() for w in self.words], np.arange(len(self.starts))
        for n in range(1, min(sizes.stop - 1, len(at)) + 1):
            if n > 1:
                at = self._longer(grams, n, fits)  # noqa: F821
            if n in sizes:
                hashes = [g[at] for g in grams]
                first, times = _grouped(*hashes)
                yield pa.RecordBatch.from_arrays([*_keys(n, [h[first] for h in hashes]), pa.array(times.astype(np.int64))], names=_COUNTED)
            fits = np.zeros(len(self.starts), dtype=bool)
            fits[at] = _member(known, grams[0][at])

    def expansions(self, known: np.ndarray, counted: np.ndarray, wanted: np.ndarray, longest: int, seen: set) -> Iterator[pa.RecordBatch]:
        """``hash, tag, f, lang, phrase`` of the phrases that ``counts`` leaves out, if it gets ``counted``, and should not.

        Their parts are ``known`` or such phrases themselves. What is ``wanted`` comes along with no occurrences and once
        per task, which ``seen`` remembers. Rows with a null hash hold the words of each language.
        """
        totals, none = np.bincount(self.lang, minlength=len(self.names)), pa.nulls(len(self.names), pa.int64())
        parts = [none, none.cast(pa.int32()), pa.array(totals.astype(np.int64)), pa.array(self.names.tolist(), pa.string())]
        yield pa.RecordBatch.from_arrays([*parts, pa.nulls(len(totals), pa.string())], names=_WORDED)
        grams, at = [w.copy() for w in self.words], np.arange(len(self.starts))
        for n in range(1, min(longest, len(at)) + 1):
            if n > 1:
                at = self._longer(grams, n, fits)  # noqa: F821
            new = ~(before[at] & before[at + 1]) if n > 1 else np.zeros(len(at), dtype=bool)  # noqa: F821
            look = np.flatnonzero(new | _member(wanted, grams[0][at]))
            if len(look):
                hashes = [g[at[look]] for g in grams]
                first, times = _grouped(*hashes)
                yield self._worded(n, [h[first] for h in hashes], at[look[first]], np.where(new[look[first]], times, 0), seen)
            fits, before = np.zeros(len(self.starts), dtype=bool), np.zeros(len(self.starts) + 1, dtype=bool)
            fits[at] = new | _member(known, grams[0][at])
            before[at] = ~new & _member(counted, grams[0][at])  # a new phrase may share the bit of a counted one

    def wordings(self, frequent: np.ndarray, longest: int, seen: set) -> Iterator[pa.RecordBatch]:
        """``hash, tag, f, lang, phrase`` of what ``frequent`` may hold, with no occurrences, once per task."""
        grams, at = [w.copy() for w in self.words], np.arange(len(self.starts))
        for n in range(1, min(longest, len(at)) + 1):
            if n > 1:
                at = self._longer(grams, n, fits)  # noqa: F821
            fits = np.zeros(len(self.starts), dtype=bool)
            fits[at] = _member(frequent, grams[0][at])
            at = at[fits[at]]
            hashes = [g[at] for g in grams]
            first, times = _grouped(*hashes)
            yield self._worded(n, [h[first] for h in hashes], at[first], np.zeros_like(times), seen)

    def _worded(self, n: int, hashes: list[np.ndarray], at: np.ndarray, times: np.ndarray, seen: set) -> pa.RecordBatch:
        keep = []
        for i, key in enumerate(zip(hashes[0].tolist(), hashes[1].tolist(), strict=True)):
            if times[i] or key not in seen:
                seen.add(key)
                keep.append(i)
        at, cut = at[keep], zip(self.starts[at[keep]].tolist(), self.stops[at[keep] + n - 1].tolist(), strict=True)
        phrases = [self.data[i:j] if n == 1 else b" ".join(self.data[i:j].split()) for i, j in cut]
        texts = [pa.array(self.names[self.lang[at]].tolist(), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*_keys(n, [h[keep] for h in hashes]), pa.array(times[keep].astype(np.int64)), *texts], names=_WORDED)


_COUNTED = ["hash", "tag", "f"]
_WORDED = [*_COUNTED, "lang", "phrase"]


def _keys(n: int, hashes: list[np.ndarray]) -> list[pa.Array]:
    """The identity of phrases of ``n`` words: a hash, and 28 bits of another above the number of words."""
    tag = (hashes[1] >> np.uint64(36)).astype(np.uint32) << np.uint32(3) | np.uint32(n)
    return [pa.array(hashes[0].view(np.int64)), pa.array(tag.view(np.int32))]


def _seed(name: str) -> int:
    """A fixed 64-bit number of a language's name."""
    out = 0
    for b in name.encode():
        out = (out * _BASE + b + 1) % (1 << 64)
    return out


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    powers = _Powers()
    for data, ends, langs in _slices(batches):
        yield _Slice(powers, data, ends, langs)


def _counts(texts: DataFrame, known: Broadcast, sizes: range) -> DataFrame:
    """``_Slice.counts`` over all ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _each_slice(batches):
            yield from part.counts(known.value, sizes)

    return texts.mapInArrow(run, "hash long, tag int, f long").groupBy("hash", "tag").agg(F.sum("f").alias("f"))


def _worded(texts: DataFrame, method: str, maps: list[Broadcast], longest: int) -> DataFrame:
    """``_Slice.expansions`` or ``_Slice.wordings`` over all ``texts``; languages have rows without hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of the task's own texts
        for part in _each_slice(batches):
            yield from getattr(part, method)(*[m.value for m in maps], longest, seen)

    found = texts.mapInArrow(run, "hash long, tag int, f long, lang string, phrase string")
    keys = ["hash", "tag", F.when(F.col("hash").isNull(), F.col("lang")).alias("of")]
    return found.groupBy(*keys).agg(F.sum("f").alias("f"), F.min("lang").alias("lang"), F.min("phrase").alias("phrase")).drop("of")


def _bitmap(hashes: DataFrame, onto: np.ndarray) -> np.ndarray:
    """``onto`` with the bits of ``hashes`` set: at most 2^BITS bits in blocks of 4 KB reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITS) + 1
    blocks = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    out = onto.copy()
    for b, m in blocks.collect():
        part = np.frombuffer(bytes(m), dtype=np.uint8)
        at = (b - 1) * 4096
        out[at : at + len(part)] |= part[: len(out) - at]
    return out


def _propose(sample: DataFrame, support: int, longest: int) -> np.ndarray:
    """Bitmap of the phrases, up to one word short of the longest, that reach the lowered threshold in the sample."""
    context = sample.sparkSession.sparkContext
    expected = support / SHARE
    lowered = max(2, math.floor(expected - DEVIATIONS * math.sqrt(expected)))
    bits = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for n in range(1, longest):
        shared = context.broadcast(bits)
        bits = _bitmap(_counts(sample, shared, range(n, n + 1)).where(F.col("f") >= lowered), bits)
        shared.destroy()
    return bits


def frequent_phrases(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST
) -> DataFrame:
    """``lang, phrase, words, f``: phrases of up to ``longest`` words with at least ``support`` occurrences in their language.

    Rows with 0 ``words`` and an empty phrase hold the number of all words of a language. Null texts are empty, a null
    language is NO_LANG, repeated rows count each, an empty table gives no rows.

    Counts go by 92 bits of two hashes; texts are read for the sample, for the counts, and for the expansions and the wording
    of what a part of the sample does not word. All tables lie in the shared folder.
    """
    context = docs.sparkSession.sparkContext
    plain = [F.coalesce(named(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), text_of(text_col).alias("text")]
    texts = docs.select(*plain).where("text != ''")
    draw = F.pmod(F.xxhash64(*[named(c) for c in docs.columns if c != lang_col and _hashable(docs, c)]), F.lit(4 * SHARE))
    sample = scratch_table(docs.where(draw < 4).select(*plain, draw.alias("draw")).where("text != ''"), "sample")
    known = _propose(sample.drop("draw"), support, longest)
    first = context.broadcast(known)
    found = scratch_table(_counts(texts, first, range(1, longest + 1)).where(F.col("f") >= support), "phrases")
    frequent = context.broadcast(_bitmap(found, np.zeros_like(known)))
    near = scratch_table(_worded(sample.where("draw = 0").drop("draw"), "wordings", [frequent], longest), "worded")
    frequent.destroy()
    wanted = _bitmap(found.join(near, ["hash", "tag"], "left_anti"), np.zeros_like(known))
    missed = _bitmap(found.where(F.col("tag").bitwiseAND(7) < longest), known)
    maps = [context.broadcast(missed), first, context.broadcast(wanted)]
    far = scratch_table(_worded(texts, "expansions", maps, longest), "expansions")
    for shared in maps:
        shared.destroy()
    words = F.col("tag").bitwiseAND(7).alias("words")
    wording = near.unionByName(far.where("hash is not null")).select("hash", "tag", "lang", "phrase")
    phrases = found.join(wording.dropDuplicates(["hash", "tag"]), ["hash", "tag"]).select("lang", "phrase", words, "f")
    more = far.where(F.col("hash").isNotNull() & (F.col("f") >= support)).select("lang", "phrase", words, "f")
    totals = far.where("hash is null").select("lang", F.lit("").alias("phrase"), F.lit(0).alias("words"), "f")
    return scratch_table(phrases.unionByName(more).unionByName(totals), "frequent")


def _hashable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant")


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of every language by score: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to ``longest`` words with a >= ``support`` occurrences has, for the cut that gives the least, the score
    floor(1000 a n / (l r)) of the occurrences of its parts, n being all words of the language. Phrases that lie in a longer
    one as frequent as themselves are left out. Ties go by occurrences, then by the phrase's bytes. For nulls, repeats and
    empty tables see ``frequent_phrases``.
    """
    return scored(frequent_phrases(docs, text_col=text_col, lang_col=lang_col, support=support, longest=longest), top)


def scored(found: DataFrame, top: int) -> DataFrame:
    """The result of ``collocations`` from that of ``frequent_phrases``.

    A phrase that lies in a longer one also lies in one with just a word more, whose number lies between theirs; so
    phrases are held against those only.
    """
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = found.where("words > 0")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    ends = F.array(F.array_join(F.expr("slice(w, 1, words - 1)"), " "), F.array_join(F.expr("slice(w, 2, words - 1)"), " "))
    longer = candidates.where("words > 2").select("lang", F.explode(ends).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where("above is null or 100 * above < 100 * a")
    cuts = kept.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    parts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("right")
    )
    of = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    parts = parts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    parts = parts.withColumn("score", F.expr(
        "cast((cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0))) as bigint)"
    ))
    least = parts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = least.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
