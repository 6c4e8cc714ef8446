"""Packing of documents into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ratelens.llm.common import named
from ratelens.llm.tokens import tokenizer

CAPACITY = 2048
END = 1
#: Windows' worth of tokens that are balanced together; bounds the work and memory of one differencing.
BLOCK_WINDOWS = 128
#: Entries that a worker's caches of chunks and of pre-tokens may have; a full one is emptied.
CACHE = 800_000

# Characters that normalisation and lower-casing keep one to one, and whose classes are settled.
_KEPT = "\x21-\x7e\xa1-įı-ɏ"
_SIMPLE = re.compile(f"[{_KEPT}]*")
_SIMPLE_TEXT = re.compile(f"[\n\x20{_KEPT}]*")
# Their letters and numbers, as classes of a pattern.
_LETTERS, _NUMBERS = (
    "".join(c for c in map(chr, range(0x21, 0x250)) if _SIMPLE.fullmatch(c) and unicodedata.category(c)[0] == kind)
    for kind in "LN"
)
# Fixed value: the pre-token pattern of the lower-case word vocabulary, for these characters.
_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Stands between pre-tokens that are encoded together.
_BETWEEN = "|"

def _bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


_caches: dict[str, tuple[dict, dict]] = {}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, equal to those of the tokenizer.

    The vocabulary drops white space and no token spans pre-tokens. A text of settled characters is cut into pre-tokens,
    each encoded once as long as it stays in the worker's cache; any other is cut at blanks first, and its chunks with
    further characters or special strings are left to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.model = tokenizer(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.chunks, self.words = _caches.setdefault(path, ({}, {}))
        found = self.model.encode(_BETWEEN, add_special_tokens=False)
        self.between = found.ids[0] if len(found) == 1 and _BETWEEN in found.tokens[0] else None
        # The byte-level alphabet maps printable ASCII to itself: such a pre-token is what the model is given.
        self.merge = self.model.model.tokenize

    def _encoded(self, strings: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(strings, add_special_tokens=False) if strings else []
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _learn_words(self, parts: list[str]) -> None:
        """Put pre-tokens into the cache: encoded as one text, which is cut where the mark between them stands."""
        words = self.words
        new = [w for w in set(parts) if w not in words]
        if len(words) + len(new) > CACHE:
            words.clear()
            new = list(set(parts))
        words.update((w, _bytes([t.id for t in self.merge(w)])) for w in new if w.isascii())
        new = [w for w in new if not w.isascii()]
        apart = [w for w in new if self.between is None or _BETWEEN in w]
        joined = [w for w in new if self.between is not None and _BETWEEN not in w]
        words.update(zip(apart, self._encoded(apart), strict=True))
        if joined:
            text = f" {_BETWEEN} ".join(joined)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [*(4 * np.flatnonzero(ids == self.between)).tolist(), 4 * len(ids)]
            data, at = ids.tobytes(), 0
            for word, stop in zip(joined, ends, strict=True):
                words[word] = data[at:stop]
                at = stop + 4

    def _ids(self, parts: list[str]) -> bytes:
        try:
            return b"".join(map(self.words.__getitem__, parts))
        except KeyError:
            self._learn_words(parts)
            return b"".join(map(self.words.__getitem__, parts))

    def _is_simple(self, text: str, pattern: re.Pattern) -> bool:
        return pattern.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _simple(self, text: str) -> bytes:
        return self._ids(_PRE_TOKEN.findall(text.lower()))

    def encode(self, text: str) -> bytes:
        if self._is_simple(text, _SIMPLE_TEXT):
            return self._simple(text)
        parts = text.replace("\n", " ").split(" ")
        missing = [p for p in set(parts) if p not in self.chunks]
        if missing:
            if len(self.chunks) + len(missing) > CACHE:
                self.chunks.clear()
                missing = list(set(parts))
            whole = [p for p in missing if not self._is_simple(p, _SIMPLE)]
            self.chunks.update(zip(whole, self._encoded(whole), strict=True))
            simple = set(missing).difference(whole)
            self.chunks.update((p, self._simple(p)) for p in simple)
        return b"".join(map(self.chunks.__getitem__, parts))


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: ``k`` groups of indices with near-equal sums.

    Every size starts as a partial partition with one filled group. The two partitions of the largest spread are
    merged with opposing order, fullest group to emptiest, until one is left. Only groups above the smallest sum of a
    partition are listed with their surplus; groups without members are left out.
    """
    heap: list[tuple] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        spare = k - len(one) - len(two)
        if spare >= 0:
            both = sorted(one + two, key=_surplus, reverse=True)
            least = both[-1][0] if spare == 0 else 0
        else:
            # one is in descending order: its last -spare groups meet the last ones of two, in opposing order.
            n = -spare
            mixed = [(a + b, x + y) for (a, x), (b, y) in zip(one[-n:], reversed(two[-n:]), strict=True)]
            both = sorted(one[:-n] + two[:-n] + mixed, key=_surplus, reverse=True)
            least = both[-1][0]
        if least:
            both = [(s - least, members) for s, members in both]
        heapq.heappush(heap, (-(both[0][0] - (both[-1][0] if len(both) == k else 0)), serial, both))
        serial += 1
    return [members for _, members in heap[0][2]] if heap else []


def _surplus(group: tuple[int, list]) -> int:
    return group[0]


#: document, first token in it, number of tokens
Piece = tuple[int, int, int]


def balance(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Near-equal windows of whole pieces; one more window whenever the fullest exceeds the capacity."""
    sizes = [n for _, _, n in pieces]
    k = -(-sum(sizes) // capacity)
    while True:
        groups = difference(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return [[pieces[i] for i in g] for g in groups]
        k += 1


_NAMES = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


class _Rows:
    """Pieces of finished sequences, column by column."""

    def __init__(self, first: int, checksum: bool):
        self.sequence, self.checksum = first, checksum
        self.columns: list[list] = [[] for _ in range(7)]

    def add(self, pieces: list[Piece], docs: dict[int, tuple]) -> None:
        """One more sequence."""
        key, start, length, ids, total, sequence, offset = self.columns
        at = 0
        for doc, first, n in pieces:
            name, tokens = docs[doc]
            part = memoryview(tokens)[4 * first : 4 * (first + n)]
            key.append(name)
            start.append(first)
            length.append(n)
            ids.append(zlib.crc32(part) if self.checksum else bytes(part))
            total.append(len(tokens) // 4)
            sequence.append(self.sequence)
            offset.append(at)
            at += n
        self.sequence += 1

    def flush(self, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.int64(), pa.int64() if self.checksum else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(self.columns, types, strict=True)], names=names)
        self.columns = [[] for _ in range(7)]
        return batch


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end: int = END, checksum: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens.

    One row per piece: the document's id, ``start`` (its tokens before the piece), ``length``, ``ids`` (little-endian
    unsigned 32-bit integers; with ``checksum`` instead ``ids_crc32``, their CRC-32), ``doc_tokens``, ``sequence_id`` and
    ``offset`` in the sequence. A document is its token ids and the id ``end``; null and empty texts are that id alone.
    Repeated rows are packed each, a null id stays null, an empty table gives no rows, other columns are ignored.

    Each task packs the documents of its partition as they come. A document is cut where it exceeds a window, and the
    rests of ``BLOCK_WINDOWS`` windows' worth of documents are balanced by differencing, one window more whenever the
    fullest would exceed the capacity. The windows stay as they are balanced, about a fiftieth of them is padding.
    Nothing is shuffled and memory is bounded by a block and a document. Sequence ids hold the partition and a running
    number.
    """
    rows = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))
    kinds = [T.LongType(), T.LongType(), T.LongType() if checksum else T.BinaryType(), T.LongType(), T.LongType(), T.LongType()]
    names = [id_col, *[("ids_crc32" if checksum else n) if n == "ids" else n for n in _NAMES]]
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *map(T.StructField, names[1:], kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        last = np.array([end], dtype="<u4").tobytes()
        out = _Rows(TaskContext.get().partitionId() << 40, checksum)
        held: dict[int, tuple] = {}  # documents with pieces that wait
        waiting: list[Piece] = []
        size = serial = 0
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[serial] = key, encoder.encode(text or "") + last
                n = len(held[serial][1]) // 4
                whole = n - n % capacity
                for at in range(0, whole, capacity):
                    out.add([(serial, at, capacity)], held)
                if n > whole:
                    waiting.append((serial, whole, n - whole))
                    size += n - whole
                else:
                    del held[serial]
                serial += 1
                if size >= BLOCK_WINDOWS * capacity:
                    for window in balance(waiting, capacity):
                        out.add(window, held)
                    held, waiting, size = {}, [], 0
                    yield out.flush(kind, names)
        if waiting:
            for window in balance(waiting, capacity):
                out.add(window, held)
        if kind is not None:
            yield out.flush(kind, names)

    return rows.mapInArrow(run, schema)
