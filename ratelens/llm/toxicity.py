"""Toxicity: a factorisation machine over hashed terms."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import map_text, named, set_aside

#: Labelled rows a model is fitted on at most: those of the least hash of their id.
SAMPLE = 4096
#: Terms of fewer sampled documents have no weights.
LEAST_DOCUMENTS = 5
FACTORS = 4
EPOCHS = 12
THRESHOLD = 0.3
#: Words whose terms a worker keeps; a full cache is emptied.
CACHE = 400_000
HELD_OUT_PARTS, HELD_OUT_PART = 4, 2

# Bytes above 127 belong to words.
_BLANK = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


#: Beside whole words, their first bytes are terms, which catches what writers derive from an insult.
STEMS = (4, 5, 6, 7)


def parts(word: bytes) -> tuple[int, ...]:
    """The hashed terms of a word: its stems, each with its length, and the word itself."""
    return (*[zlib.crc32(word[:n], n) for n in STEMS if len(word) >= n], zlib.crc32(word))


Terms = tuple[np.ndarray, np.ndarray]


def terms(text: bytes) -> Terms:
    """The hashed terms of a text with the logarithm of one more than their number."""
    count: Counter[int] = Counter()
    for word, n in Counter(text.translate(_BLANK).split()).items():
        for part in parts(word):
            count[part] += n
    return np.fromiter(count, np.int64, len(count)), np.log1p(np.fromiter(count.values(), np.float64, len(count)))


@dataclass
class FactorizationMachine:
    """``bias + sum w[i] x[i] + sum <v[i], v[j]> x[i] x[j]`` over the terms i < j of a text; ``index`` places terms."""

    index: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: bytes) -> float:
        get, count = self.index.get, Counter()
        for word, n in Counter(text.translate(_BLANK).split()).items():
            known = self.known.get(word)
            if known is None:
                if len(self.known) > CACHE:
                    self.known.clear()
                known = self.known[word] = tuple(k for k in map(get, parts(word)) if k is not None)
            for k in known:
                count[k] += n
        margin = self.bias
        if count:
            at = sorted(count)
            x = np.log1p([count[k] for k in at])
            v = self.factors[at] * x[:, None]
            margin += self.weights[at] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(samples: list[Terms], labels: list[int], *, sparsity: float = 3e-3, decay: float = 1e-3, rate: float = 0.05) -> FactorizationMachine:
    """Fit by AdaGrad on the logistic loss; a group penalty zeroes a term's weight and factors together.

    A term whose weight is zero stays as long as its interactions count; terms are left out only where both are zero, so
    the machine scores just as it was fitted.
    Without samples, or with one class only, the machine scores its bias. Equal input gives an equal model.
    """
    y = np.array(labels, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    values, counts = np.unique(np.concatenate([t for t, _ in samples] or [np.zeros(0, np.int64)]), return_counts=True)
    kept = values[counts >= LEAST_DOCUMENTS]
    index = {int(v): i for i, v in enumerate(kept)}
    w, v = np.zeros(len(kept)), np.random.default_rng(7).normal(0, 0.01, (len(kept), FACTORS))
    if not len(kept) or y.min() == y.max():
        return FactorizationMachine(index, bias, w, 0 * v)
    rows = []
    for t, x in samples:
        at = np.minimum(np.searchsorted(kept, t), len(kept) - 1)
        known = kept[at] == t
        rows.append((at[known], x[known]))
    gw, gv, gb = np.full(len(w), 1e-3), np.full(v.shape, 1e-3), 1e-3  # no first step is much longer than others
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            own = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            at, x = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
            vx = v[at] * x[:, None]
            total = np.stack([np.bincount(own, vx[:, f], len(batch)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(own, (vx**2).sum(axis=1), len(batch))
            margin = bias + np.bincount(own, w[at] * x, len(batch)) + 0.5 * ((total**2).sum(axis=1) - squares)
            wrong = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]) / len(batch)
            gb += wrong.sum() ** 2
            bias -= rate * wrong.sum() / np.sqrt(gb)
            some, place = np.unique(at, return_inverse=True)
            error = wrong[own] * x
            step = np.bincount(place, error, len(some))
            gw[some] += step**2
            speed = rate / np.sqrt(gw[some])
            moved = w[some] - speed * step
            pull = error[:, None] * (total[own] - vx)
            step = np.stack([np.bincount(place, pull[:, f], len(some)) for f in range(FACTORS)], axis=1)
            step += decay * v[some]
            gv[some] += step**2
            turned = v[some] - rate * step / np.sqrt(gv[some])
            norm = np.sqrt(moved**2 + (turned**2).sum(axis=1))
            kept_share = np.maximum(0, 1 - speed * sparsity / np.maximum(norm, 1e-12))
            w[some], v[some] = moved * kept_share, turned * kept_share[:, None]
    used = np.flatnonzero((w != 0) | (v != 0).any(axis=1))
    return FactorizationMachine({int(kept[k]): i for i, k in enumerate(used)}, float(bias), w[used], v[used])


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id's text is ``part`` modulo ``parts``; null ids are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, parts: int, part: int, rows: int) -> DataFrame:
    """``_id``, ``_text`` and ``_label`` of at most ``rows`` labelled texts that are not held out: of the ids of the least hash.

    An id with several labels has the largest, an id with several texts has each different one once, as long as there are
    not more than ``rows`` in all; then those of the least hash of id and text count. So the bound holds for rows, too.
    """
    open_ids = labels.select(named(id_col).alias("_id"), named(label).cast("int").alias("_label")).where("_id is not null and _label is not null")
    few = open_ids.where(~held_out(F.col("_id"), parts, part)).groupBy("_id").agg(F.max("_label").alias("_label"))
    few = few.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # bounds the broadcast, too
    texts = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))
    found = texts.join(F.broadcast(few), "_id").select("_id", F.coalesce("_text", F.lit("")).alias("_text"), "_label")
    each = found.groupBy("_id", F.md5("_text").alias("_h")).agg(F.first("_text").alias("_text"), F.max("_label").alias("_label"))
    return each.orderBy(F.xxhash64("_id", "_h"), "_id", "_h").limit(rows).select("_id", "_text", "_label")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """A machine fitted on a sample of ``labels`` joined to the texts by id; held-out ids are not read."""
    found = labelled_sample(docs, labels, label, id_col, text_col, HELD_OUT_PARTS, HELD_OUT_PART, sample)

    def work(texts: list[bytes], _: pa.RecordBatch) -> list[pa.Array]:
        found = [terms(t) for t in texts]
        return [pa.array([f[k] for f in found], type=pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.float64()))]

    fields = [T.StructField("_terms", T.ArrayType(T.LongType())), T.StructField("_values", T.ArrayType(T.DoubleType()))]
    rows = map_text(found, "_text", fields, work, ("_text",))
    learnt = rows.orderBy("_id", "_terms").select("_terms", "_values", "_label").toArrow()  # at most ``sample`` rows
    samples = [(t.values.to_numpy(), x.values.to_numpy()) for t, x in zip(learnt["_terms"], learnt["_values"], strict=True)]
    return fit(samples, [int(x > 0) for x in learnt["_label"].to_pylist()])


_SCORE = T.StructField("score", T.DoubleType())


def score_toxicity(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with its ``score`` from 0 to 1; null and empty texts have the score of the bias.

    A column ``score`` of ``docs`` is replaced; columns in ``drop`` are not returned. Repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes], _: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(list(map(sent.value.score, texts)), type=pa.float64())]

    rows = docs.select(*[named(c) for c in docs.columns if c != "score" or c == text_col])
    return map_text(rows, text_col, [_SCORE], work, drop)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more; the columns are those of ``docs``."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    rows = set_aside(docs)
    text = rows.columns[docs.columns.index(text_col)]
    scored = score_toxicity(rows, model, text_col=text)
    return scored.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)
