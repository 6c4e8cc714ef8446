"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import named, scratch_table

#: Pre-tokens whose piece counts every task gets; the rest is joined by shuffle.
FREQUENT = 200_000
#: Longer pre-tokens are never among them, so the broadcast stays under FREQUENT * (LONGEST + 8) bytes.
LONGEST = 64

# Fixed value: the pre-token pattern of the byte-level vocabulary.
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters, marks and blanks of these blocks have had the same classes in every version of Unicode.
_SETTLED = re.compile(r"[\x00-\x1b\x20-ɏ‐-‧]*")
_FAST = regex.compile(_PRE_TOKEN, regex.V1)

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class PreTokens:
    """Cut texts into the tokenizer's pre-tokens; special strings are pieces of their own."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.strings = set(special)

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.strings else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if _SETTLED.fullmatch(text):
            return _FAST.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            found = model.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            count = pa.array([len(x) for x in found], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, count], names=[*batch.schema.names, "pieces"])

    return run


def _frequencies(path: str):
    """Distinct pre-tokens of a task's texts with their frequencies, handed on before they grow large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = PreTokens(path), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), type=pa.string()), pa.array(list(seen.values()), type=pa.int64())],
                names=["pre_token", "frequency"],
            )
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(cutter.cut(text or ""))
                if len(seen) > 200_000:
                    yield out()
        yield out()

    return run


def pre_token_pieces(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text") -> DataFrame:
    """Every distinct pre-token of the corpus with its frequency and the number of pieces it has."""
    found = docs.select(named(text_col).cast("string").alias("text")).mapInArrow(
        _frequencies(tokenizer_path), "pre_token string, frequency bigint"
    )
    distinct = found.groupBy("pre_token").agg(F.sum("frequency").alias("frequency"))
    return distinct.mapInArrow(_pieces(tokenizer_path), "pre_token string, frequency bigint, pieces bigint")


_REST = T.ArrayType(T.StructType([T.StructField("pre_token", T.StringType()), T.StructField("n", T.LongType())]))
_REST_ARROW = pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int64())]))


def _frequent(pieces: DataFrame) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, at most FREQUENT: those above a frequency that the counts per class give.

    Classes are sixteenths of a power of two, so a thousand rows bound what the counts send, whatever the corpus.
    """
    short = pieces.where(F.octet_length("pre_token") <= LONGEST)
    level = F.floor(16 * F.log2("frequency")).cast("int")
    least, kept = None, 0
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        kept += r["count"]
        if kept > FREQUENT:
            break
        least = r["level"]
    if least is None:
        return {}
    return {r[0]: r[1] for r in short.where(level >= least).select("pre_token", "pieces").collect()}


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """Tokens of every document: ``id_col``, n_bytes, n_tokens and whether they exceed ``limit``.

    Pieces are counted once per distinct pre-token of the corpus. Each task sums the pre-tokens of the bounded table of
    at most ``FREQUENT`` of the most frequent ones itself; only the rare ones are shuffled, as (document, pre-token, frequency),
    and meet their counts in a join. No token ids are kept. Null and empty texts have no tokens, repeated rows are
    counted each, a null id stays null. Columns besides the two named are ignored.
    """
    pieces = scratch_table(pre_token_pieces(docs, tokenizer_path, text_col=text_col), "pieces")
    known = docs.sparkSession.sparkContext.broadcast(_frequent(pieces))
    ids = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, table, part, row = PreTokens(tokenizer_path), known.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, sizes, sums, rest = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                count, left = 0, []
                for token, n in Counter(cutter.cut(text)).items():
                    each = table.get(token)
                    if each is None:
                        left.append({"pre_token": token, "n": n})
                    else:
                        count += each * n
                keys.append(part << 40 | row)
                row += 1
                sizes.append(len(text.encode()))
                sums.append(count)
                rest.append(left)
            columns = [pa.array(x, type=pa.int64()) for x in (keys, sizes, sums)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(rest, type=_REST_ARROW)],
                names=["_id", "_key", "n_bytes", "_sum", "_rest"],
            )

    schema = T.StructType(
        [ids.schema["_id"], *[T.StructField(c, T.LongType()) for c in ("_key", "n_bytes", "_sum")], T.StructField("_rest", _REST)]
    )
    counted = ids.mapInArrow(run, schema)
    # Beside its rare pre-tokens, each document has one row that carries its own figures, under a key that no
    # pre-token has and that spreads such rows over the partitions.
    own = F.struct(F.concat(F.lit("\0"), F.col("_key").cast("string")).alias("pre_token"), F.lit(0).cast("long").alias("n"))
    rows = counted.withColumn("_r", F.explode(F.concat(F.array(own), F.col("_rest"))))
    first = F.col("_r.n") == 0
    rows = rows.select(
        "_key", "_r.pre_token", "_r.n", *[F.when(first, F.col(c)).alias(c) for c in ("_id", "n_bytes", "_sum")]
    )
    joined = rows.join(pieces.select("pre_token", "pieces"), "pre_token", "left")
    total = F.sum(F.coalesce("_sum", F.col("n") * F.col("pieces"), F.lit(0)))
    return (
        joined.groupBy("_key")
        .agg(F.max("_id").alias("_id"), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
        .select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
