"""SQL statements of the training-data queries that SQL can express."""

from __future__ import annotations

from ratelens.llm.collocations import LONGEST, NO_LANG, SUPPORT, TOP

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COLLOCATIONS = f"""WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
   unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
 totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY 1),
 grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
   FROM lists, unnest(range(1, {LONGEST + 1})) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
 counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= {SUPPORT}),
 candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
 inside AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase
   FROM candidates, unnest(range(2, k)) AS s(j), unnest(range(1, k - j + 2)) AS u(i)),
 kept AS (SELECT c.* FROM candidates c WHERE NOT EXISTS
   (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)),
 cuts AS (SELECT c.lang, c.phrase, c.a, c.k, c.part, l.f AS l, r.f AS r, cast(t.n AS BIGINT) AS n,
   cast(cast(1000 AS HUGEINT) * c.a * t.n // (cast(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
   FROM (SELECT *, unnest(range(1, k)) AS part FROM kept) c
   JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.part], ' ')
   JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.part + 1:c.k], ' ')
   JOIN totals t ON t.lang = c.lang),
 least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, part) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least QUALIFY rank <= {TOP}"""
