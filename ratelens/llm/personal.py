"""Personal data: patterns, and words that disclose what the patterns find; DataFrame expressions only on the main path.

Sanitisation by information content: a word that stands near a protected entity discloses it as far as their pointwise mutual
information reaches the entity's own information content, which the corpus estimates:

    disclosure = PMI(entity; word) / IC(entity) = 1 - IC(entity | word) / IC(entity)

It is 1 where the word never stands elsewhere and 0 where it tells nothing. From DISCLOSE on a word near a mention of the entity
is generalised, from REMOVE on it is taken out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import named, scratch_table, set_aside, text_of

# The base patterns. Possessive and guarded by what stands before, they find the same spans in linear time:
# a run of the first class matches from all its places or from none.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kinds of spans, in their order; the last two are words.
KINDS = ("email", "ip", "card", "phone", "general", "removed")

#: Words that may disclose: three letters and more between blanks, quotes, brackets or sentence marks.
WORD = r"""(?<=^|[\s("'\[])\p{L}{3,}+(?=$|[\s,;:!?)"'\]]|\.(?:\s|$))"""
#: Code points on either side of a mention in which a word is near it; occurrences near it that an estimate needs.
CONTEXT, EVIDENCE = 80, 2
#: Disclosure from which a word is generalised, and from which it is removed.
DISCLOSE, REMOVE = 0.9, 0.97
#: Matches whose positions are added up at once.
BLOCK = 128

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "struct<kind:int,start:int,end:int>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(text: str, pattern: str, needs: str | None) -> str:
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    return f"case when contains({text}, '{needs}') then {found} else cast(array() as array<string>) end" if needs else found


def _with_matches(df: DataFrame, text: str, name: str, pattern: str, needs: str | None = None) -> DataFrame:
    """Add the leftmost non-overlapping matches as array ``name`` of (start, end, s, left, right); positions are code points.

    ``left`` and ``right`` are the contexts up to the neighbouring match. Where one does not end with the text, a mark
    stands there, so that nothing is taken for a word that is cut or touches the match. Lengths are added up in blocks,
    and blocks in turn: appending to an array copies it. ``needs`` occurs in every match.
    """
    df = df.withColumn("_m", F.expr(_found(text, pattern, needs)))
    df = df.withColumn("_g", F.expr(f"case when size(_m) > 0 then split({text}, {_quoted(pattern)}, -1) end"))
    lengths = "zip_with(_m, slice(_g, 1, size(_m)), (m, g) -> struct(char_length(g) as g, char_length(m) as m))"
    df = df.withColumn("_l", F.expr(f"case when size(_m) > 0 then {lengths} end"))
    df = df.withColumn("_p", F.expr(f"""
        transform(transform(sequence(0, (size(_l) - 1) div {BLOCK}), b -> slice(_l, cast(b * {BLOCK} + 1 as int), {BLOCK})), part ->
            aggregate(part, struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as out),
                (a, x) -> struct(a.at + x.g + x.m as at, concat(a.out, array(struct(a.at + x.g as start, a.at + x.g + x.m as end))) as out)))"""))  # fmt: skip
    df = df.withColumn("_o", F.expr("""
        aggregate(_p, struct(0 as at, cast(array() as array<int>) as out), (a, x) -> struct(a.at + x.at as at, concat(a.out, array(a.at)) as out), a -> a.out)"""))  # fmt: skip
    df = df.withColumn("_p", F.expr("flatten(zip_with(_p, _o, (x, o) -> transform(x.out, y -> struct(y.start + o as start, y.end + o as end))))"))
    near = f"""transform(sequence(0, size(_m) - 1), i -> struct(_p[i].start as start, _p[i].end as end, _m[i] as s,
        concat(case when i = 0 and char_length(_g[i]) <= {CONTEXT} then '' else '\\u0001' end, substring(_g[i], -{CONTEXT}, {CONTEXT}), '\\u0001') as left,
        concat('\\u0001', substring(_g[i + 1], 1, {CONTEXT}),
            case when i = size(_m) - 1 and char_length(_g[i + 1]) <= {CONTEXT} then '' else '\\u0001' end) as right))"""
    kind = "array<struct<start:int,end:int,s:string,left:string,right:string>>"
    return df.withColumn(name, F.expr(f"case when size(_m) > 0 then {near} else cast(array() as {kind}) end")).drop("_m", "_g", "_l", "_p", "_o")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def with_mentions(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add what the base patterns find and keep as array ``name`` of (kind, start, end, entity, left, right), sorted.

    ``entity`` is a hash of the value: e-mail addresses in lower case, cards and phone numbers by their digits.
    """
    size = lambda s: F.char_length(_digits(s))
    octets = f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"
    kinds = [
        (EMAIL, "@", lambda s: F.lit(True), F.lower),
        (IP, ".", lambda s: s.rlike(octets), lambda s: s),
        (CARD, None, lambda s: F.when(size(s).between(16, 19), F.call_function("luhn_check", _digits(s))).otherwise(False), _digits),
        (PHONE, "+", lambda s: size(s).between(8, 15), _digits),
    ]
    parts = []
    for n, (pattern, needs, keep, value) in enumerate(kinds):
        df = _with_matches(df, text, f"_k{n}", pattern, needs)
        parts.append(_mentions(f"_k{n}", n, keep, value))
    return df.withColumn(name, F.concat(*parts)).drop(*[f"_k{n}" for n in range(len(kinds))])


def _mentions(found: str, kind: int, keep: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    def mention(x: Column) -> Column:
        entity = F.xxhash64(F.lit(kind), value(x["s"]))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), entity.alias("entity"), x["left"].alias("left"), x["right"].alias("right"))

    return F.transform(F.filter(found, lambda x: keep(x["s"])), mention)


def _words(context: Column, start: Column, before: bool) -> Column:
    """Words of a context as (start, end, word): its code points begin right at ``start`` or end there."""
    found = F.regexp_extract_all(context, F.lit(WORD), F.lit(0))
    gaps = F.split(context, WORD, -1)
    begin = start - F.char_length(context) + 1 if before else start - 1  # a mark stands between context and match

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + F.char_length(x["g"])
        word = F.struct(at.alias("start"), (at + F.char_length(x["m"])).alias("end"), F.xxhash64(F.lower(x["m"])).alias("word"))
        return F.struct((at + F.char_length(x["m"])).alias("at"), F.concat(a["out"], F.array(word)).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    none = F.array().cast("array<struct<start:int,end:int,word:bigint>>")
    return F.aggregate(pairs, F.struct(begin.alias("at"), none.alias("out")), step, lambda a: a["out"])


def _disclosing(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``entity, word, kind``: pairs whose disclosure reaches DISCLOSE, from EVIDENCE occurrences on.

    ``rows`` holds ``_near``, arrays of words near mentions, and ``_entities``; ``texts`` all texts as ``_t``. Every count is
    taken per value first, so that a frequent word or entity is a row a task.
    """
    pairs = rows.select(F.explode("_near").alias("x")).groupBy("x.entity", "x.word").agg(F.count(F.lit(1)).alias("both"))
    entities = rows.select(F.explode("_entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    words = texts.select(F.explode(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).alias("w"))
    counts = scratch_table(words.groupBy(F.xxhash64(F.lower("w")).alias("word")).agg(F.count(F.lit(1)).alias("times")), "words")
    total = counts.agg(F.sum("times").alias("n")).scalar()
    known = pairs.where(F.col("both") >= EVIDENCE).join(entities, "entity").join(counts, "word", "left")
    share = F.least(F.lit(1.0), F.col("both") / F.greatest("both", F.coalesce("times", F.lit(0))))
    information = -F.log2(F.col("mentions") / F.greatest(total + 1, F.col("mentions") + 1))
    judged = known.select("entity", "word", (1 + F.log2(share) / information).alias("disclosure"))
    kind = F.when(F.col("disclosure") >= REMOVE, KINDS.index("removed")).otherwise(KINDS.index("general"))
    return judged.where(F.col("disclosure") >= DISCLOSE).select("entity", "word", kind.alias("kind"))


def find_personal(docs: DataFrame, *, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with ``base`` and ``spans``, arrays of (kind, start, end), sorted; ``kind`` indexes KINDS.

    ``base`` has the spans of the patterns (null texts count as empty). ``spans`` has these and the words near a mention, in
    the same text, that disclose its entity; a word near two entities has the stronger kind. The estimates are over all
    texts; repeated rows count and are returned each; an entity or word that occurs once gives no estimate. An empty
    table gives no rows. Columns named ``base`` or ``spans`` are replaced, those in ``drop`` not returned.

    Texts are read twice, for mentions and for words; figures go to tables in the shared folder, texts only if they
    are to be returned.
    """
    names = [c for c in docs.columns if c not in ("base", "spans") and c not in drop]
    kept = [f"_c{i}" for i in range(len(names))]
    given = docs.select(*[named(c).alias(k) for c, k in zip(names, kept, strict=True)], text_of(text_col).alias("_t"))
    rows = with_mentions(given, "_t", "_found").drop("_t")

    def near(x: Column) -> Column:
        words = F.concat(_words(x["left"], x["start"], True), _words(x["right"], x["end"], False))
        return F.transform(words, lambda w: F.struct(x["entity"].alias("entity"), w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end")))

    rows = rows.select(
        *kept, F.monotonically_increasing_id().alias("_row"), F.transform("_found", lambda x: x["entity"]).alias("_entities"),
        F.sort_array(F.transform("_found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).alias("_base"),
        F.flatten(F.transform("_found", near)).alias("_near"),
    )
    rows = scratch_table(rows, "personal")
    marks = rows.select("_row", F.explode("_near").alias("x")).select("_row", "x.*")
    marked = marks.join(_disclosing(rows, given.select("_t")), ["entity", "word"])
    each = marked.groupBy("_row", "start", "end").agg(F.max("kind").alias("kind"))
    more = each.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
    out = rows.drop("_near", "_entities").join(more, "_row", "left")
    added = F.coalesce("_more", F.array().cast(f"array<{_SPAN}>")).cast(f"array<{_SPAN}>")
    spans = F.sort_array(F.concat(F.col("_base").cast(f"array<{_SPAN}>"), added))
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, kept, strict=True)], F.col("_base").alias("base"), spans.alias("spans"))


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind, as in ``[EMAIL]``, and disclosing words by ``[NAME]`` or ``[WORD]``.

    A word is a name if it begins with a capital letter; words that are to be removed leave nothing. Overlapping spans
    share the first one's replacement. Null texts stay null, the columns are those of ``docs``.
    """
    rows = set_aside(docs)
    text = rows.columns[docs.columns.index(text_col)]
    found = find_personal(rows, text_col=text)
    marks = ", ".join(f"'[{k.upper()}]'" for k in KINDS[:4])
    clean = F.expr(f"""
        aggregate(array_sort(transform(spans, s -> struct(s.start as start, -s.end as longest, s.kind as kind, s.end as end))),
            struct(0 as at, cast(array() as array<string>) as out),
            (a, s) -> struct(greatest(a.at, s.end) as at,
                case when s.start < a.at then a.out else concat(a.out, array(substring({text}, a.at + 1, s.start - a.at),
                    case when s.kind < 4 then array({marks})[s.kind] when s.kind = 5 then ''
                         when substring({text}, s.start + 1, 1) rlike '\\\\p{{Lu}}' then '[NAME]' else '[WORD]' end)) end as out),
            a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))""")
    out = found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text)))
    return out.select(*rows.columns).toDF(*docs.columns)
