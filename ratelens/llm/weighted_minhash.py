"""Document fingerprints by consistent weighted sampling; DataFrame expressions only on the main path."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import named, text_of

#: Samples of a fingerprint: a likeness p has a standard error of sqrt(p (1 - p) / SAMPLES), at most 0.0442 (0.0354 at 0.8).
SAMPLES = 128
#: Partitions of texts per shuffle partition, as the terms of a partition's texts are counted in memory, and ranges of
#: ids per such partition.
PARTS, RANGES = 4, 2
#: Samples that one row carries once the least ones are sought.
BLOCK = 4
#: A sample of a text is sought below a rank that none of its terms reaches with a probability of e^-REACH; where none does, all are taken.
REACH = 9.0
_SEPARATOR = "[ \t\r\n]+"
_LOW = (1 << 32) - 1


def _uniform(bits: Column, width: int) -> Column:
    """The lowest ``width`` bits as a number between 0 and 1, both excluded."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5) * 2.0**-width


def _here(value: Column) -> Column:
    """Adding nothing in a way that is not deterministic has Spark take the number here, once, not wherever it is read."""
    return value + F.spark_partition_id() * 0


def _hashes(term: Column, k: Column) -> tuple[Column, Column]:
    return F.xxhash64(term, 2 * k), F.xxhash64(term, 2 * k + 1)


def _drawn(u: Column, v: Column) -> tuple[Column, Column, Column]:
    """e^-r, e^-c and b of a sample; r and c are from Gamma(2, 1), b is uniform."""
    r = _uniform(u, 21) * _uniform(F.shiftrightunsigned(u, 21), 21)
    return r, _uniform(v, 32) * _uniform(F.shiftrightunsigned(v, 32), 32), _uniform(F.shiftrightunsigned(u, 42), 21)


def _level(weight: Column, r: Column, b: Column) -> Column:
    return F.floor(weight / r + b)


def _above(rank: Column) -> Column:
    """A rank as the upper 31 bits of a sample."""
    high = F.greatest(F.lit(0), F.least(F.lit((1 << 31) - 1), F.floor((rank + 64) * 2.0**24)))
    return F.shiftleft(high.cast("long"), 32)


def _sample(v: Column, r: Column, power: Column, b: Column, level: Column) -> Column:
    """31 bits of the rank ln c - r (t - b + 1) above 32 bits that identify term and level t; ``power`` is e^-c.

    With t = floor(ln(weight) / r + b), the least sample of a text's terms equals that of another text with a probability of
    their generalised Jaccard similarity.
    """
    rank = F.ln(-F.ln(power)) - r * (level - b + 1)
    return _above(rank).bitwiseOR(F.xxhash64(v, level).bitwiseAND(F.lit(_LOW)))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _terms(text: Column) -> Column:
    """Terms of a text (``w``, hashed) and how often it holds them (``c``)."""

    def counted(words: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

        def sizes(begin: Column) -> Column:
            return F.transform(begin, lambda i, j: F.struct(F.get(words, i).alias("w"), (F.coalesce(F.get(begin, j + 1), F.size(words)) - i).alias("c")))

        return _bind(fresh, sizes)

    return _bind(F.sort_array(F.transform(F.split(text, _SEPARATOR), lambda w: F.xxhash64(w))), counted)


def _least_of_all(terms: Column, k: Column) -> Column:
    """The ``k``-th least sample of a list of terms, as 32 bits."""

    def one(term: Column) -> Column:
        u, v = _hashes(term["w"], k)
        power, other, b = _drawn(u, v)
        return _sample(v, -F.ln(power), other, b, _level(F.ln(term["c"]), -F.ln(power), b))

    return F.array_min(F.transform(terms, one)).bitwiseAND(F.lit(_LOW))


def signatures(rows: DataFrame, place: str, number: str, texts: Sequence[str], samples: int = SAMPLES) -> DataFrame:
    """``rows`` with ``_s0``, ``_s1``, ...: the signature, ``samples`` numbers of 32 bits, of each of the columns ``texts``, null of null.

    Terms are what lies between blanks and line ends (an empty text has one empty term), weighted by their number.
    Place and number tell rows apart. Where ``rows`` are partitioned by the place, nothing is shuffled.

    The samples of a term depend on it and its weight alone, so texts of a row that hold it equally often take them once.
    The least rank of a text of n words is beyond ln(x / n) with a probability of e^-x. Only samples below that are taken,
    and most others are told without a logarithm: of ranks, e^rank = c (e^-r)^z / weight with z in (0, 1], which is 1 - b
    where the weight is one, c is at least 2 (1 - e^-c) / (1 + e^-c), and a power of e^-r at least a harmonic mean.
    """
    every = range(len(texts))
    split = F.struct(*[F.split(t, _SEPARATOR).alias(f"w{i}") for i, t in enumerate(texts)])
    words = rows.select(place, number, F.explode(F.array(split)).alias("_w"))
    size = F.array_min(F.array_compact(F.array(*[F.array_size(f"_w.w{i}") for i in every])))
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_w.w{i}").alias("w")) for i in every])
    words = words.select(place, number, size.alias("_size"), F.explode(kinds).alias("_w"))
    words = words.select(place, number, "_size", F.col("_w.i").alias("_i"), F.explode("_w.w").alias("_w"))
    words = words.select(place, number, "_size", "_i", F.xxhash64("_w").alias("_w"))
    counts = words.groupBy(place, number, "_w").agg(F.max("_size").alias("_size"), *[F.count_if(F.col("_i") == i).alias(f"_c{i}") for i in every])
    # One row per term and how often texts hold it.
    each = []
    for i in every:
        fresh = reduce(and_, [F.col(f"_c{j}") != F.col(f"_c{i}") for j in range(i)], F.lit(True))
        held = [(F.col(f"_c{j}") == F.col(f"_c{i}")).alias(f"in{j}") for j in every]
        each.append(F.struct(F.when(fresh, F.col(f"_c{i}")).otherwise(0).alias("c"), *held))
    counts = counts.select(place, number, "_w", "_size", F.explode(F.array(*each)).alias("_in")).where("_in.c > 0")
    held = [F.col(f"_in.in{i}").alias(f"_in{i}") for i in every]
    most = _here(_above(F.ln(REACH / F.col("_size")))).alias("_most")
    room = _here(F.col("_in.c") * (REACH * (1 + 1e-9)) / F.col("_size")).alias("_room")
    terms = counts.select(place, number, *held, "_w", F.ln("_in.c").alias("_weight"), room, most)

    keep = [place, number, *[f"_in{i}" for i in every], "_most", "_k"]
    numbers = F.array(*[F.lit(k) for k in range(samples)])
    df = terms.select("*", F.explode(numbers).alias("_k"))
    u, v = _hashes(F.col("_w"), F.col("_k"))
    df = df.select(*keep, "_weight", "_room", _here(u).alias("_u"), _here(v).alias("_v"))
    power, other, b = _drawn(F.col("_u"), F.col("_v"))
    df = df.select(*keep, "_weight", "_room", "_v", _here(power).alias("_power"), _here(other).alias("_other"), _here(b).alias("_b"))
    power, other, b = F.col("_power"), F.col("_other"), F.col("_b")
    mean = F.when(F.col("_weight") == 0, (1 - b) + b * power).otherwise(1.0)
    df = df.where(2 * (1 - other) * power < (1 + other) * F.col("_room") * mean)
    df = df.select(*keep, "_weight", "_v", "_other", "_b", _here(-F.ln(power)).alias("_log"))
    df = df.select(*keep, "_v", "_other", "_b", "_log", _here(_level(F.col("_weight"), F.col("_log"), F.col("_b"))).alias("_level"))
    df = df.select(*keep, _here(_sample(F.col("_v"), F.col("_log"), F.col("_other"), F.col("_b"), F.col("_level"))).alias("_m")).where("_m < _most")
    of = F.pmod("_k", F.lit(BLOCK))
    least = [F.min(F.when(F.col(f"_in{i}") & (of == j), F.col("_m"))).alias(f"_m{i}_{j}") for i in every for j in range(BLOCK)]
    df = df.groupBy(place, number, F.floor(F.col("_k") / BLOCK).cast("int").alias("_k")).agg(*least)

    # The rows come back to their samples by a union, as a join by place and number would shuffle both.
    parts = [F.array(*[F.col(f"_m{i}_{j}").bitwiseAND(F.lit(_LOW)) for j in range(BLOCK)]).alias(f"x{i}") for i in every]
    found = df.select(place, number, F.struct("_k", *parts).alias("_x"))
    also = [c for c in rows.columns if c not in (place, number)]
    whole = found.unionByName(rows.select(place, number, F.struct(*also).alias("_row")), allowMissingColumns=True)
    whole = whole.groupBy(place, number).agg(F.collect_list("_x").alias("_x"), F.first("_row", ignorenulls=True).alias("_row"))

    def signature(i: int) -> Column:
        blocks = F.sort_array("_x")
        found = F.slice(F.flatten(F.transform(blocks, lambda x: x[f"x{i}"])), 1, samples)
        text = F.col(f"_row.{texts[i]}")

        def filled(terms: Column) -> Column:
            def at(k: Column) -> Column:
                block = F.get(F.filter("_x", lambda x: x["_k"] == F.floor(k / BLOCK)), F.lit(0))
                return F.coalesce(F.get(block[f"x{i}"], F.pmod(k, F.lit(BLOCK)).cast("int")), _least_of_all(terms, k))

            return F.transform(numbers, at)

        whole = F.size(F.array_compact(found)) == samples
        return F.when(text.isNull(), None).when(whole, found).otherwise(_bind(_terms(text), filled)).alias(f"_s{i}")

    return whole.select(place, number, "_row.*", *[signature(i) for i in every])


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal samples of two signatures: their similarity with a standard error of at most 0.5 / sqrt(samples)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def digits(signature: str) -> Column:
    """A signature in hexadecimal digits, eight per sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Id, ``signature`` and ``fingerprint`` (its digits) of every row of ``docs``; null texts count as empty."""
    rows = docs.select(named(id_col).alias("_id"), text_of(text_col).alias("_t"), F.spark_partition_id().alias("_r"))
    rows = rows.select("_r", F.monotonically_increasing_id().alias("_n"), "_id", "_t").repartition("_r")
    found = signatures(rows, "_r", "_n", ["_t"], samples)
    return found.select(F.col("_id").alias(id_col), F.col("_s0").alias("signature"), digits("_s0").alias("fingerprint"))


def _ranges(ids: DataFrame, number: int) -> tuple[Column, Column | None]:
    """The range of ``_id``, and whether it is the range's last id (null if all ids are); bounds are ids, about equally many rows apart.

    Bounds are looked up in two levels, so that their number costs a row only its root.
    """
    shares = F.array(*[F.lit((i + 1) / number) for i in range(number)])
    found = ids.agg(F.approx_percentile("_id", shares, F.lit(20 * number)).alias("b"), F.max("_id").alias("m")).first()
    bounds = sorted({*(found["b"] or []), found["m"] if found["m"] is not None else 0})
    width = math.isqrt(len(bounds)) + 1
    lists = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in part]) for part in lists])
    tops = F.array(*[F.lit(part[-1]).cast("long") for part in lists])
    outer = F.size(F.filter(tops, lambda x: x < F.col("_id")))
    part = F.get(table, outer)
    inner = F.size(F.filter(part, lambda x: x < F.col("_id")))
    is_last = F.coalesce(F.get(part, inner) == F.col("_id"), F.lit(False)) if found["m"] is not None else None
    place = F.when(F.col("_id").isNull(), 0).otherwise(outer * width + inner)
    return F.struct(place.alias("at"), ((place + 1) % len(bounds)).alias("above")), is_last


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and those of neighbours are.

    The edited text has the last third of a text's code points replaced by the first as many of the next document's, in
    descending order of the whole-number ids (nulls last, equal ids by text; the first follows the last). Columns: id,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``. Null texts
    are empty, repeated rows are reported each, other columns are ignored, an empty table gives no rows.

    Texts are shuffled once, by ranges of ids; the first of each range goes along with the range above, whose last
    document it follows. Everything else happens where the ranges lie.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t"))
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, is_last = _ranges(rows.select("_id"), RANGES * parts)
    if is_last is None:  # all rows are one range in the order of their texts, and the first of them follows the last
        is_last = F.col("_t") == rows.agg(F.min("_t").alias("_t")).scalar()
    rows = rows.withColumn("_p", place)
    both = F.array(F.struct(F.col("_p.at").alias("r"), F.lit(0).alias("g")), F.struct(F.col("_p.above").alias("r"), F.lit(1).alias("g")))
    rows = rows.withColumn("_e", F.explode(F.when(is_last, both).otherwise(F.slice(both, 1, 1))))
    rows = rows.select("_id", "_t", F.col("_e.r").alias("_r"), F.col("_e.g").alias("_g")).repartition(parts, "_r")
    order = Window.partitionBy("_r").orderBy("_g", F.col("_id").desc_nulls_last(), "_t")
    rows = rows.select("*", F.lead("_t").over(order).alias("_next"), F.row_number().over(order).cast("long").alias("_n"))
    third = F.floor(F.char_length("_t") / 3).cast("int")
    edited = F.concat(F.substring("_t", F.lit(1), F.char_length("_t") - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third))
    rows = rows.withColumn("_edited", F.when(F.col("_g") == 0, edited))
    rows = rows.select("_r", "_n", "_g", "_id", "_t", "_edited")
    found = signatures(rows, "_r", "_n", ["_t", "_edited"], samples)
    found = found.select("*", F.lead("_s0").over(Window.partitionBy("_r").orderBy("_n")).alias("_s2")).where("_g = 0")
    return found.select(
        F.col("_id").alias(id_col), F.char_length("_t").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        digits("_s0").alias("fingerprint"), digits("_s1").alias("edited_fingerprint"), likeness("_s0", "_s1").alias("near_edited"),
        likeness("_s0", "_s2").alias("near_next"),
    )
