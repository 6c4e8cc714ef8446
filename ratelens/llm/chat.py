"""Chat formatting: layouts are told apart by the fingerprint of their field paths and mapped to canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import named

START, END = "<|im_start|>", "<|im_end|>\n"
#: Characters of a block after which a conversation goes on in another row.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    Either ``fixed``, (role, field) in order, of which empty fields of all but the first and last are left out; or
    ``each``, the list that holds the turns, with their ``role`` and ``text`` fields. Without a list the rows themselves
    are turns, numbered by ``turn``.
    """

    fixed: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        if self.fixed:
            return {f for _, f in self.fixed}
        inside = f"{self.each}[]." if self.each else ""
        return {inside + self.role, inside + self.text} | ({self.turn} if self.turn else set())


def fingerprint(paths: set[str]) -> str:
    """Digest of nested field paths, in any order; ``[]`` marks the elements of a list."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


# Field names of common layouts.
LAYOUTS = [
    Mapping(role="role", text="text", turn="turn"),
    Mapping(each="messages", role="role", text="content"),
    Mapping(each="messages", role="role", text="text"),
    Mapping(each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping(fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping(fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(fixed=(("user", "question"), ("assistant", "answer"))),
    Mapping(fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping(fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
]
REGISTRY = {fingerprint(m.paths()): m for m in LAYOUTS}


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Leaf paths of a Spark type."""
    if isinstance(kind, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return set().union(*[schema_paths(f.dataType, dot + f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def value_paths(value, prefix: str = "") -> set[str]:
    """Leaf paths of a parsed JSON value; an empty list has its own path."""
    if isinstance(value, dict):
        dot = f"{prefix}." if prefix else ""
        return set().union(*[value_paths(v, dot + k) for k, v in value.items()])
    if isinstance(value, list) and value:
        return set().union(*[value_paths(v, f"{prefix}[]") for v in value])
    return {prefix}


def _name(mapping: Mapping, role: Column) -> Column:
    out = role
    for old, new in mapping.roles.items():
        out = F.when(role == old, new).otherwise(out)
    return F.coalesce(out, F.lit(""))


def canonical_turns(df: DataFrame, id_col: str, *, extra: tuple[str, ...] = ()) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` of a frame whose columns, without the id and ``extra``, are a known layout.

    Null roles and texts are empty; a null list has no turns. An unknown layout raises ``ValueError``.
    """
    rest = [f for f in df.schema.fields if f.name != id_col and f.name not in extra]
    paths = schema_paths(T.StructType(rest))
    mapping = REGISTRY.get(fingerprint(paths))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    key, text = named(id_col).alias("conv"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if mapping.turn:
        return df.select(key, named(mapping.turn).cast("long").alias("turn"), _name(mapping, named(mapping.role)).alias("role"), text(named(mapping.text)).alias("text"))
    if mapping.each:
        rows = df.select(key, F.posexplode(named(mapping.each)).alias("at", "t"))
        return rows.select("conv", F.col("at").cast("long").alias("turn"), _name(mapping, F.col("t")[mapping.role]).alias("role"), text(F.col("t")[mapping.text]).alias("text"))
    inner = mapping.fixed[1:-1]
    turns = F.array(*[F.struct(F.lit(role).alias("role"), text(named(f)).alias("text")) for role, f in mapping.fixed])
    rows = df.select(key, F.posexplode(turns).alias("at", "t")).where(~F.col("at").between(1, len(inner)) | (F.col("t.text") != ""))
    return rows.select("conv", F.col("at").cast("long").alias("turn"), "t.role", "t.text")


def _record_turns(record) -> list[tuple[str, str]]:
    mapping = REGISTRY.get(fingerprint(value_paths(record))) if isinstance(record, dict) else None
    if mapping is None or mapping.turn:
        return []
    as_text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if mapping.each:
        roles = [as_text(t.get(mapping.role)) for t in record[mapping.each]]
        return [(mapping.roles.get(r, r), as_text(t.get(mapping.text))) for r, t in zip(roles, record[mapping.each], strict=True)]
    turns = [(role, as_text(record[f])) for role, f in mapping.fixed]
    return [t for i, t in enumerate(turns) if t[1] or i in (0, len(turns) - 1)]


def record_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Canonical turns of JSON records, each of which may have another layout.

    Records that are null, no JSON or of an unknown layout have no turns.
    """
    rows = df.select(named(id_col).alias("conv"), named(json_col).cast("string").alias("record"))
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    found = _record_turns(json.loads(text or "null"))
                except ValueError:
                    found = []
                out.append([{"role": r, "text": t} for r, t in found])
            arrow = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=arrow)], names=["conv", "turns"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["conv"], T.StructField("turns", kind)]))
    each = found.select("conv", F.posexplode("turns").alias("at", "t"))
    return each.select("conv", F.col("at").cast("long").alias("turn"), "t.role", "t.text")


def escape(text: str) -> str:
    """``<|`` gets a backslash inside, and one more where it has some, so that no text has a control string."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


_OUT = [T.StructField("block", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(T.IntegerType()))]


def format_chats(turns: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """Formatted conversations: ``conv``, ``block``, ``formatted`` and ``loss``, starts and ends of what is learnt.

    Turns are sorted over the whole cluster by conversation and number (ties by role and text), so that a conversation
    of any size is spread over tasks; a conversation's text is that of its blocks in order, of BLOCK characters or one
    turn each. Null conversations are one conversation, repeated rows are turns of their own, an empty table has no rows.
    """
    rows = turns.select("conv", "turn", "role", "text").withColumn("tie", F.xxhash64("text"))
    order = ["conv", "turn", "role", "tie", "text"]
    rows = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, kind = TaskContext.get().partitionId() << 40, None, None
        parts: list[str] = []
        loss: list[int] = []
        size = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal block, size
            if parts:
                done.append((now, block, "".join(parts), list(loss)))
                block += 1
            parts.clear()
            loss.clear()
            size = 0

        def out() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.list_(pa.int32())]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], type=t) for i, t in enumerate(types)], names=["conv", "block", "formatted", "loss"])
            done.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                if conv != now or size > BLOCK:
                    close()
                    now = conv
                head, body = f"{START}{_role(role)}\n", escape(text)
                if role == learn:
                    loss += [size + len(head), size + len(head) + len(body)]
                parts += [head, body, END]
                size += len(head) + len(body) + len(END)
            if done:
                yield out()
        if parts:
            close()
            yield out()

    return rows.mapInArrow(run, T.StructType([rows.schema["conv"], *_OUT]))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn[: -len(END)].partition("\n")
        out.append((_role_back(role), unescape(text)))
    return out


_DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Figures of every conversation, read back from the formatted blocks one after the other."""
    rows = chats.repartition("conv").sortWithinPartitions("conv", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind, done = None, None, None, []

        def out() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[i] for r in done], type=t) for i, t in enumerate(types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[id_col, *[f.split()[0] for f in _DIGEST.split(", ")]])

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, text, loss in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(loss[::2], loss[1::2], strict=True):
                    learnt = unescape(text[a:b])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            if done:
                yield out()
        if state:
            close()
            yield out()

    kind = chats.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, {_DIGEST}")
