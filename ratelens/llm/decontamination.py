"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training words are streamed through the automaton, which keeps the longest suffix of the words read so far that occurs
in any test item. Where that suffix is at least a window long, the window is marked. Documents with too large a marked
share are rejected, the marked words of the others are cut out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import map_text, named, set_aside, text_of

WINDOW = 10
#: Words of test items in one automaton; more items make more automata, read one after the other.
AUTOMATON_WORDS = 1_000_000
#: A document with a larger share of marked words is rejected as a whole.
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLANK = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_SLOTS = 1 << 22


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z in lower case, ASCII letters and digits and everything beyond ASCII."""
    return text.translate(_BLANK).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences, each read from the root.

    ``length`` and ``link`` are by state; ``windows`` has the items of each state that stands for a whole window,
    ``whole`` the items shorter than a window that end in a state.
    """

    window: int
    words: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    windows: dict[int, tuple] = field(default_factory=dict)
    whole: dict[int, tuple] = field(default_factory=dict)
    window_state: list[int] = field(default_factory=list)
    whole_state: list[int] = field(default_factory=list)
    pairs: np.ndarray | None = None
    shortest: int = 1

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, above: int, word: int, below: int) -> int:
        """The state for the strings of ``below`` that are no longer than what ``above`` and ``word`` make."""
        if self.length[below] == self.length[above] + 1:
            return below
        twin = self._state(self.length[above] + 1, dict(self.step[below]), self.link[below])
        self.link[below] = twin
        while above >= 0 and self.step[above].get(word) == below:
            self.step[above][word] = twin
            above = self.link[above]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word, self.step[last][word])
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.step[at][word])
        return new

    def build(self, items: Iterable[tuple[str, list[bytes]]]) -> Automaton:
        """Read all items, then mark the states of windows and of whole short items."""
        items = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, ids in items:
            last = 0
            for word in ids:
                last = self._extend(last, word)
        found: dict[int, set] = {}
        whole: dict[int, set] = {}
        for name, ids in items:
            at = 0
            for word in ids:
                at = self.step[at][word]
                if self.length[at] >= self.window:
                    found.setdefault(at, set()).add(name)
            if len(ids) < self.window:
                whole.setdefault(at, set()).add(name)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            above = self.link[state]
            if self.length[above] >= self.window and state in found:
                found.setdefault(above, set()).update(found[state])
        self.window_state, self.whole_state = [-1] * len(self.length), [-1] * len(self.length)
        for state in order:
            above = self.link[state]
            if self.length[state] >= self.window:
                self.window_state[state] = state if self.length[above] < self.window else self.window_state[above]
            self.whole_state[state] = state if state in whole else self.whole_state[above]
        self.windows = {s: tuple(found[s]) for s in found if self.window_state[s] == s}
        self.whole = {s: tuple(v) for s, v in whole.items()}
        self.shortest = min((min(len(ids), self.window) for _, ids in items), default=1)
        self.pairs = np.zeros(_SLOTS, dtype=bool)
        for _, ids in items:
            ids = np.array(ids, dtype=np.int64)
            self.pairs[_slot(ids[:-1], ids[1:])] = True
        return self

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words that can hold a window: each neighbouring pair must occur in an item.

        A window never crosses a pair that no item has, and the automaton is back to at most one word there, so the
        stretches can be read on their own. Pairs are looked up by a hash: one too many only costs a reading.
        """
        known = ids >= 0
        joined = known[:-1] & known[1:]
        joined[joined] = self.pairs[_slot(ids[:-1][joined], ids[1:][joined])]
        ends = np.flatnonzero(~joined) + 1
        starts = np.concatenate([[0], ends])
        ends = np.concatenate([ends, [len(ids)]])
        fit = (ends - starts >= self.shortest) & known[starts]
        yield from zip(starts[fit].tolist(), ends[fit].tolist(), strict=True)

    def read(self, ids: list[int], first: int, spans: list[tuple[int, int]], items: set) -> None:
        """Stream words; add the marked spans [start, end), from ``first`` on, and the items of the windows."""
        state = matched = 0
        step, link, length, window = self.step, self.link, self.length, self.window
        for i, word in enumerate(ids, first + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            if matched >= window:
                spans.append((i - window, i))
                items.update(self.windows[self.window_state[state]])
            at = self.whole_state[state if length[state] <= matched else link[state]] if state else -1
            while at > 0:
                spans.append((i - length[at], i))
                items.update(self.whole[at])
                at = self.whole_state[link[at]]


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 0x9E3779B1 + b) * 0x85EBCA6B >> 7) & (_SLOTS - 1)


def _automata(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Automaton]:
    """Automata of bounded size over all items; at most one is held on the driver."""
    shard, size = [], 0
    rows = benchmark.select(F.coalesce(named(item_col).cast("string"), F.lit("")), text_of(text_col)).distinct()
    for name, text in rows.toLocalIterator():
        words = words_of(text.encode())
        if size and size + len(words) > AUTOMATON_WORDS:
            yield Automaton(window).build(shard)
            shard, size = [], 0
        shard.append((name, words))
        size += len(words)
    yield Automaton(window).build(shard)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


REPORT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("clean_text", T.StringType()),
]
_REPORT_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
_FOUND = [
    T.StructField("_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("_items", T.ArrayType(T.StringType())),
]
_FOUND_ARROW = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(kinds)]


def _pass(docs: DataFrame, text_col: str, automaton, earlier: bool, last: bool, drop: tuple[str, ...]) -> DataFrame:
    """Add what one automaton finds to what earlier ones did; the last pass reports."""

    def work(texts: list[bytes], batch: pa.RecordBatch) -> list[pa.Array]:
        auto: Automaton = automaton.value
        get = auto.words.get
        before = [batch.column(batch.num_columns - 2 + i).to_pylist() for i in (0, 1)] if earlier else None
        rows = []
        for k, text in enumerate(texts):
            words = words_of(text)
            spans = [(a, b) for a, b in before[0][k]] if before else []
            items = set(before[1][k]) if before else set()
            if words and auto.words:
                ids = [get(w, -1) for w in words]
                for start, end in auto.stretches(np.array(ids, dtype=np.int64)):
                    auto.read(ids[start:end], start, spans, items)
            found = _merged(spans) if spans else spans
            rows.append(_report(text, len(words), found, items) if last else (found, sorted(items)))
        return _columns(rows, _REPORT_ARROW if last else _FOUND_ARROW)

    drop = (*drop, *[f.name for f in _FOUND]) if last else tuple(f.name for f in _FOUND)
    new = REPORT if last else [T.StructField(f"_{f.name}", f.dataType) for f in _FOUND]
    out = map_text(docs, text_col, new, work, drop)
    return out if last else out.withColumnsRenamed({f"_{f.name}": f.name for f in _FOUND})


def _report(text: bytes, n_words: int, spans: list[tuple[int, int]], items: set) -> tuple:
    clean = None
    if spans:
        # Cut from the first marked word up to the next kept one, so that no double blanks stay.
        at = [m.start() for m in _WORD.finditer(text.translate(_BLANK))] + [len(text)]
        parts, last = [], 0
        for start, end in spans:
            parts.append(text[last : at[start]])
            last = at[end]
        clean = b"".join([*parts, text[last:]]).decode()
    hit = sum(end - start for start, end in spans)
    return n_words, hit, len(items), _sha(",".join(sorted(items))), hit > 0, clean


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of ``docs`` with its marked words, the items they come from and the text without them.

    ``clean_text`` is null where nothing is marked. Null and empty texts have no words and are clean; a benchmark
    without words marks nothing. Items shorter than ``window`` words count as one window. Repeated document rows are
    reported each; repeated items count once by id, a null id is the empty string. Columns of ``docs`` that have the
    name of a report column are replaced; those in ``drop`` are not returned.

    No shuffle: every document is read where it lies, once for each automaton of up to ``AUTOMATON_WORDS`` item words.
    """
    taken = {f.name for f in (*REPORT, *_FOUND)} - {text_col}
    rows = docs.select(*[named(c) for c in docs.columns if c not in taken])
    context, earlier, waiting = docs.sparkSession.sparkContext, False, None
    for automaton in _automata(benchmark, item_col, item_text_col, window):
        if waiting is not None:
            rows, earlier = _pass(rows, text_col, waiting, earlier, False, ()), True
        waiting = context.broadcast(automaton)
    return _pass(rows, text_col, waiting, earlier, True, drop)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """``docs`` without marked spans, and without documents in which they cover over ``max_coverage`` of the words.

    Untouched rows keep their text as it is (null stays null). The columns are those of ``docs``.
    """
    rows = set_aside(docs)
    text = rows.columns[docs.columns.index(text_col)]
    found = find_contamination(rows, benchmark, text_col=text, window=window)
    kept = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage))
    out = kept.withColumn(text, F.coalesce("clean_text", text))
    return out.select(*rows.columns).toDF(*docs.columns)
