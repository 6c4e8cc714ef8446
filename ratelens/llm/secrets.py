"""Secret scans: patterns, and a battery of randomness tests with false-discovery control by length.

Everything on the main path is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import named, scratch_table, set_aside, text_of

# The base patterns. The last two take in their minimum length, which finds the same spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of these characters are tested for randomness from this length on.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: False discoveries allowed among the strings of a length class that are taken for written text.
RATE = 0.05
#: P-values are counted in classes of this many per unit of their logarithm, up to LAST.
PER_UNIT, LAST = 50, 2000

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings in the order they are inferred: pattern, alphabet.
_ENCODINGS = [
    ("[0-9a-f]+", _DIGIT + "abcdef"), ("[0-9A-F]+", _DIGIT + "ABCDEF"), ("[A-Z2-7]+", _UPPER + "234567"),
    ("[a-z0-9]+", _DIGIT + _LOWER), ("[A-Za-z0-9]+", _DIGIT + _UPPER + _LOWER), (".+", _UPPER + _LOWER + _DIGIT + "+/"),
]
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _with_matches(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Add the leftmost non-overlapping matches as array ``name`` of (start, end, s); positions are code points.

    A text is its gaps and matches in turn, so that their lengths add up to the positions.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    df = df.withColumn("_m", F.expr(f"regexp_extract_all({text}, '{quoted}', 0)"))
    return df.withColumn(name, F.expr(f"""
        case when size(_m) = 0 then cast(array() as array<struct<start:int,end:int,s:string>>) else
        aggregate(zip_with(_m, slice(split({text}, '{quoted}', -1), 1, size(_m)), (m, g) -> struct(char_length(g) as g, m as m)),
            struct(0 as at, cast(array() as array<struct<start:int,end:int,s:string>>) as out),
            (a, x) -> struct(a.at + x.g + char_length(x.m) as at,
                concat(a.out, array(struct(a.at + x.g as start, a.at + x.g + char_length(x.m) as end, x.m as s))) as out),
            a -> a.out) end""")).drop("_m")  # fmt: skip


def base_spans(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted spans of the base patterns as array ``name`` of (start, kind, end)."""
    quoted = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX), strict=False):
        df = _with_matches(df, text, f"_b_{kind}", pattern)
    long_enough = f"char_length(regexp_extract(x.s, '{quoted}', 2)) >= {ASSIGN_LENGTH}"
    parts = [
        f"transform(filter(_b_{kind}, x -> {long_enough if kind == 'assign' else 'true'}), x -> struct(x.start as start, {n} as kind, x.end as end))"
        for n, kind in enumerate(KINDS[:3])
    ]
    return df.withColumn(name, F.expr(f"sort_array(concat({', '.join(parts)}))")).drop(*[f"_b_{k}" for k in KINDS[:3]])


def _normal_tail(z: Column) -> Column:
    """Twice the upper tail of |z| under the normal distribution (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def _chi_tail(chi: Column, df: Column) -> Column:
    """Upper tail of the chi-squared distribution (Wilson and Hilferty)."""
    spread = 2 / (9 * df)
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    tail = _normal_tail(z) / 2
    return F.when(z > 0, tail).otherwise(1 - tail)


def battery(found: Column) -> Column:
    """Candidates (start, end, s) as (start, end, stratum, p): the p-value of a random string of their encoding.

    Tests: chi-squared uniformity of the symbols and of the kinds of characters, runs about the middle of the alphabet,
    and serial correlation of neighbours; p is the least of the four times four. The stratum is the inferred encoding
    with the length class.
    """

    def coded(c: Column) -> Column:
        plain = F.translate(F.rtrim(c["s"], F.lit("=")), "-_=", "+//")
        chosen = F.lit(len(_ENCODINGS) - 1)
        for n, (pattern, _) in reversed(list(enumerate(_ENCODINGS[:-1]))):
            chosen = F.when(plain.rlike(f"^{pattern}$"), F.lit(n)).otherwise(chosen)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), plain.alias("s"), chosen.alias("enc"))

    alphabets = F.array(*[F.lit(a) for _, a in _ENCODINGS])

    def codes(c: Column) -> Column:
        alphabet = F.get(alphabets, c["enc"])
        symbols = F.filter(F.split(c["s"], ""), lambda x: x != "")
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["enc"].alias("enc"), c["s"].alias("s"),
            F.char_length(alphabet).cast("double").alias("b"),
            F.transform(symbols, lambda x: F.position(x, alphabet).cast("double")).alias("x"),
        )

    def sums(c: Column) -> Column:
        x, b = c["x"], c["b"]
        mean = (b + 1) / 2
        left, right = F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x))
        high = F.size(F.filter(x, lambda v: v > mean)).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        kinds = [(F.char_length(c["s"]) - F.char_length(F.translate(c["s"], g, ""))).cast("double") for g in (_LOWER, _UPPER, _DIGIT, "+/")]
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["enc"].alias("enc"), b.alias("b"),
            F.size(x).cast("double").alias("n"), high.alias("high"),
            total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda w: w == v)).cast("double"), F.lit(2.0)))).alias("squares"),
            total(F.zip_with(left, right, lambda u, v: F.when((u > mean) != (v > mean), 1.0).otherwise(0.0))).alias("turns"),
            total(F.zip_with(left, right, lambda u, v: (u - mean) * (v - mean))).alias("lagged"),
            total(F.transform(x, lambda v: (v - mean) * (v - mean))).alias("spread"),
            F.array(*kinds).alias("kinds"),
        )

    def judged(c: Column) -> Column:
        n, b, high = c["n"], c["b"], c["high"]
        symbols = _chi_tail(c["squares"] * b / n - n, b - 1)
        kind_p = F.lit(1.0)
        for code, (_, alphabet) in enumerate(_ENCODINGS):
            sizes = [sum(x in g for x in alphabet) for g in (_LOWER, _UPPER, _DIGIT, "+/")]
            parts = [F.pow(F.get(c["kinds"], F.lit(i)), F.lit(2.0)) * (len(alphabet) / size) for i, size in enumerate(sizes) if size]
            chi = sum(parts[1:], parts[0]) / n - n
            kind_p = F.when(c["enc"] == code, _chi_tail(chi, F.lit(float(len(parts) - 1)))).otherwise(kind_p)
        low = n - high
        mean = 2 * high * low / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(variance > 0, _normal_tail((c["turns"] + 1 - mean) / F.sqrt(variance))).otherwise(F.lit(1e-300))
        serial = F.when(c["spread"] > 0, _normal_tail(c["lagged"] / c["spread"] * F.sqrt(n))).otherwise(F.lit(1e-300))
        p = F.least(F.lit(1.0), 4 * F.least(symbols, kind_p, runs, serial))
        stratum = c["enc"] * 64 + F.least(F.lit(63), F.floor(2 * F.log2(n))).cast("int")
        tested = F.when(n >= 8, p).otherwise(F.lit(1e-300))  # padding alone is no secret
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), stratum.cast("int").alias("stratum"), tested.alias("p"))

    for step in (coded, codes, sums, judged):
        found = F.transform(found, step)
    return found


def _thresholds(tested: DataFrame, column: str) -> dict[int, float]:
    """Benjamini and Hochberg's threshold of each stratum; strata and classes of p bound the table."""
    each = tested.select(F.explode(column).alias("c")).select("c.*")
    cell = F.least(F.floor(-F.log("p") * PER_UNIT), F.lit(LAST)).cast("int")
    cells = each.groupBy("stratum", cell.alias("cell")).count()
    found: dict[int, list[tuple[int, int]]] = {}
    for stratum, at, count in cells.collect():  # at most 6 * 64 * (LAST + 1) rows
        found.setdefault(stratum, []).append((at, count))
    out = {}
    for stratum, rows in found.items():
        total, so_far, limit = sum(n for _, n in rows), 0, 0.0
        for at, count in sorted(rows, reverse=True):
            so_far += count
            edge = math.exp(-at / PER_UNIT)
            if edge <= so_far * RATE / total:
                limit = edge
        out[stratum] = limit
    return out


def find_secrets(docs: DataFrame, *, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with ``base`` and ``secrets``, sorted arrays of (start, kind, end); ``kind`` indexes KINDS.

    ``base`` has the spans of the patterns (null texts count as empty). ``secrets`` has these and the candidates that are
    taken for random: per encoding and length class, the null hypothesis "random" is rejected at the false-discovery
    rate RATE over the whole corpus; what is not rejected and overlaps no base span is a secret of kind "random". Short
    strings, which tests tell apart less well, are so held against strings of their own length only. Repeated rows are
    scanned each; an empty table gives no rows. Columns named ``base`` or ``secrets`` are replaced, those in ``drop``
    not returned. Texts are read once; the figures are written to the shared folder, whose thresholds come from counts.
    """
    names = [c for c in docs.columns if c not in ("base", "secrets") and c not in drop]
    rows = docs.select(*[named(c).alias(f"_c{i}") for i, c in enumerate(names)], text_of(text_col).alias("_t"))
    rows = _with_matches(base_spans(rows, "_t", "_base"), "_t", "_cand", CANDIDATE)
    rows = rows.withColumn("_cand", battery(F.col("_cand"))).drop("_t")
    rows = scratch_table(rows, "secrets")
    limits = _thresholds(rows, "_cand")
    table = F.create_map(*[F.lit(x) for pair in (limits or {-1: 0.0}).items() for x in pair])

    def random(c: Column) -> Column:
        meets = F.exists(F.col("_base"), lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return (c["p"] > F.coalesce(F.element_at(table, c["stratum"]), F.lit(0.0))) & ~meets

    more = F.transform(F.filter("_cand", random), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    rows = rows.withColumn("_all", F.sort_array(F.concat("_base", more.cast(_SPANS))))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_base").alias("base"), F.col("_all").alias("secrets"))


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans share one. Null texts stay null.

    The columns are those of ``docs``.
    """
    rows = set_aside(docs)
    text = rows.columns[docs.columns.index(text_col)]
    found = find_secrets(rows, text_col=text)
    clean = F.expr(f"""
        aggregate(secrets, struct(0 as at, cast(array() as array<string>) as out),
            (a, s) -> struct(greatest(a.at, s.end) as at,
                case when s.start < a.at then a.out
                     else concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), '{mark}')) end as out),
            a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))""")
    out = found.withColumn(text, F.when(F.size("secrets") > 0, clean).otherwise(F.col(text)))
    return out.select(*rows.columns).toDF(*docs.columns)
