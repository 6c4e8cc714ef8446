"""Quality: nearest-neighbour voting among latent-semantic vectors of labelled texts."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ratelens.llm.common import map_text, named
from ratelens.llm.toxicity import labelled_sample

#: Labelled rows whose vectors are broadcast at most: those of the least hash of their id.
SAMPLE = 4096
DIMENSIONS = 32
NEIGHBOURS = 15
#: Similarities are raised to this power before they weigh a label.
SHARPNESS = 8
THRESHOLD = 0.3
HELD_OUT_PARTS, HELD_OUT_PART = 5, 0
#: Texts whose products with all labelled vectors are held at once.
BLOCK = 256

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b";:", b"'\"", b"()[]{}<>", b"-_/\\", b"|", b"#$%&*@^~+=`"]
_CLASSES = 16  # the groups, bytes above 127, the rest
_CLASS = np.full(256, _CLASSES - 1, dtype=np.int64)
for _n, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _n
_CLASS[128:] = len(_GROUPS)
#: Slots of hashed words.
WORDS = 4096
_SHAPES = _CLASSES**3 + 4
#: Terms are hashed words and, as further ones, triples of character classes and the repetitions of words and word pairs.
TERMS = _SHAPES + WORDS


def term_vector(text: bytes) -> np.ndarray:
    """Roots of the shares of a text's terms; zero for an empty text.

    Words are what lies between blanks, in lower case, placed by their CRC-32. Repetition terms: pairs of words that occurred before and others, words equal to the one before and others.
    """
    out = np.zeros(TERMS, dtype=np.float32)
    if not text:
        return out
    c = _CLASS[np.frombuffer(b"\n" + text + b"\n", dtype=np.uint8)]
    triples = np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)
    out[: _CLASSES**3] = np.sqrt(triples / (len(c) - 2))
    words = text.lower().split()
    if len(words) > 1:
        pairs = len(words) - 1
        again = 1 - len(set(zip(words, words[1:], strict=False))) / pairs
        twice = sum(map(bytes.__eq__, words, words[1:])) / pairs
        out[_CLASSES**3 : _SHAPES] = np.sqrt([again, 1 - again, twice, 1 - twice])
    said = Counter(words)
    if said:
        slots = np.fromiter((zlib.crc32(w) % WORDS for w in said), np.int64, len(said))
        out[_SHAPES:] = np.sqrt(np.bincount(slots, np.fromiter(said.values(), np.float64, len(said)), WORDS) / said.total())
    return out


def _packed(vector: np.ndarray) -> bytes:
    """Places and values of what is not zero."""
    at = np.flatnonzero(vector)
    return at.astype("<u2").tobytes() + vector[at].astype("<f4").tobytes()


def _unpacked(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), TERMS), dtype=np.float32)
    for row, data in zip(out, packed, strict=True):
        n = len(data) // 6
        row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return out


@dataclass
class LabelledVectors:
    """Projection of terms to latent dimensions, and unit vectors and labels of the labelled texts."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def embed(self, rows: np.ndarray) -> np.ndarray:
        out = rows @ self.projection
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Mean label of the nearest neighbours by cosine, weighted by similarity; the share of ones has a small vote."""
        if not len(self.labels):
            return np.full(len(rows), self.share)
        near = self.embed(rows) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
        weight = np.where(near >= least, np.maximum(near, 0).astype(np.float64) ** SHARPNESS, 0)  # ties all vote
        return (weight @ self.labels + 0.01 * self.share) / (weight.sum(axis=1) + 0.01)


def fit(rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> LabelledVectors:
    """Latent dimensions are the leading right singular vectors of the terms weighted by rarity.

    Without rows every score is one half.
    """
    labels = np.asarray(labels, dtype=np.float64)
    share = float((labels.sum() + 0.5) / (len(labels) + 1))
    if not len(labels):
        return LabelledVectors(np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), labels, share)
    rarity = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    weighted = rows * rarity
    sketch = np.random.default_rng(5).normal(size=(weighted.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(4):
        base, _ = np.linalg.qr(weighted @ sketch)
        sketch = weighted.T @ base
    _, _, right = np.linalg.svd(sketch.T, full_matrices=False)
    model = LabelledVectors(rarity[:, None] * right[:dimensions].T, np.zeros((0, 0), np.float32), labels, share)
    model.vectors = model.embed(rows)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE) -> LabelledVectors:
    """Labelled vectors of a sample of ``labels`` joined to the texts by id; held-out ids are not read."""
    found = labelled_sample(docs, labels, label, id_col, text_col, HELD_OUT_PARTS, HELD_OUT_PART, sample)

    def work(texts: list[bytes], _: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([_packed(term_vector(t)) for t in texts], type=pa.binary())]

    rows = map_text(found, "_text", [T.StructField("_terms", T.BinaryType())], work, ("_text",))
    learnt = rows.orderBy("_id", "_terms").select("_terms", "_label").toArrow()  # ``sample`` rows, at most TERMS * 6 bytes a row
    seen = _unpacked(learnt["_terms"].to_pylist())
    return fit(seen, np.array(learnt["_label"].to_pylist(), dtype=np.int64) > 0)


def score_quality(docs: DataFrame, model: LabelledVectors, *, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with its ``score`` from 0 to 1.

    Null and empty texts have no similarity to any text and score the share of ones. A column ``score`` of ``docs`` is
    replaced; columns in ``drop`` are not returned. Repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes], _: pa.RecordBatch) -> list[pa.Array]:
        machine, parts = sent.value, []
        for at in range(0, len(texts), BLOCK):
            parts.append(machine.score(np.stack([term_vector(t) for t in texts[at : at + BLOCK]])))
        return [pa.array(np.concatenate(parts) if parts else [], type=pa.float64())]

    rows = docs.select(*[named(c) for c in docs.columns if c != "score" or c == text_col])
    return map_text(rows, text_col, [T.StructField("score", T.DoubleType())], work, drop)
