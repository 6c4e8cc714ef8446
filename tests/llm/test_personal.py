"""Personal data against the plain patterns, disclosure against direct counts, and what sanitising leaves."""

import hashlib
import math
import re
from collections import Counter

from ratelens.llm import personal
from ratelens.llm.queries import op13_personal

SCHEMA = "doc_id long, text string, base string, `a.b` int"
CARD = "4111 1111 1111 1111"
TEXTS = [
    None, "", "no data here", "mail a.b+c@x-y.co.uk, or a@b.com_c@d.org. a@bcd@e.com @x.y u@v", "a@b.c a@b.c", "é" * 5 + "ü@x.com ü.z@x.com",
    "1.2.3.4 255.255.255.255 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.0.0255 1.2.3", "99999999999999999999.1.1.1",
    f"card {CARD}, 4111-1111-1111-1111 4111111111111112 {CARD} 5500 0000 0000 0004", "4" * 30_000, "12-34 5-", "+49 (0)30 123-4567, +1.2.3.4 +123 +1234567890123456 ++49301234567 x",
    "+1.2.3.45.6789012", "x" * 50_000 + "@" + "y" * 50_000, " ".join(f"u{i}@h{i}.org 10.0.{i % 300}.7" for i in range(700)),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], SCHEMA)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    """Spans of the patterns as they are given."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    for kind, (pattern, keep) in enumerate(rules):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if keep(m.group())]
    return out


def test_base_spans_equal_the_plain_patterns(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 100_000]
    found = {r.doc_id: r for r in personal.find_personal(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in found[i].base] == plain(t), t[:60]
        assert {tuple(s) for s in found[i].base} <= {tuple(s) for s in found[i].spans}


def test_a_long_run_without_match_ends(spark):
    assert [len(r.base) for r in personal.find_personal(frame(spark, [TEXTS[13], "a" * 300_000, "1 " * 100_000])).collect()] == [0, 0, 0]


def near_words(text, start, end, left_end, right_end):
    left = [(m.start(), m.group()) for m in re.finditer(WORD, text) if max(left_end, start - personal.CONTEXT) <= m.start() and m.end() <= start]
    right = [(m.start(), m.group()) for m in re.finditer(WORD, text) if end <= m.start() and m.end() <= min(right_end, end + personal.CONTEXT)]
    return left + right


WORD = r"""(?:(?<=^)|(?<=[\s("'\[]))[^\W\d_]{3,}(?=$|[\s,;:!?)"'\]]|\.(?:\s|$))"""


def test_disclosing_words_follow_the_counts(spark):
    filler = "many other words stand in this long enough line of text that tells nothing. "
    texts = [f"The agent Zorro (call Diego) writes to zorro@fox.org about the {filler}" for _ in range(3)]
    texts += [f"the line {filler * 3}", f"Zorro once {filler}", "single Quux quux@once.org", f"about the agent {filler * 2}"] * 4
    found = {r.doc_id: r for r in personal.find_personal(frame(spark, texts)).collect()}
    times = Counter(m.group().lower() for t in texts for m in re.finditer(WORD, t))
    both, mentions = Counter(), Counter()
    places = {}
    for i, t in enumerate(texts):
        for m in re.finditer(r"[a-z]+@[a-z]+\.org", t):
            mentions[m.group()] += 1
            places[i] = [(s, w, m.group()) for s, w in near_words(t, m.start(), m.end(), 0, len(t))]
            both.update((m.group(), w.lower()) for _, w, _ in places[i])
    for i in range(len(texts)):
        want = []
        for s, w, entity in places.get(i, []):
            k = both[entity, w.lower()]
            value = 1 + math.log2(k / times[w.lower()]) / -math.log2(mentions[entity] / (sum(times.values()) + 1))
            if k >= personal.EVIDENCE and value >= personal.DISCLOSE:
                want.append((5 if value >= personal.REMOVE else 4, s, s + len(w)))
        assert [tuple(x) for x in found[i].spans if x.kind > 3] == sorted(want)
    words = {texts[0][s.start : s.end] for s in found[0].spans if s.kind > 3}
    assert {"Diego"} <= words and not words & {"The", "the", "words", "many"}
    assert not any(s.kind > 3 for i in (3, 4, 6) for s in found[i].spans)


def test_sanitised_texts(spark):
    texts = ["Diego at zorro@fox.org now", "ask Diego at zorro@fox.org, 10.0.0.1", "we are at home now", None, f"pay {CARD}!"] + ["they look at us now"] * 30
    got = [r.text for r in personal.sanitise(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got[2:4] == [texts[2], None] and got[4] == "pay [CARD]!"
    assert "[EMAIL]" in got[0] and "zorro" not in got[0] and "Diego" not in got[0] + got[1] and "[IP]" in got[1]
    assert personal.sanitise(frame(spark, texts)).columns == ["doc_id", "text", "base", "a.b"]


def test_query_digests_and_empty_table(spark, tmp_path):
    assert personal.find_personal(frame(spark, [])).count() == 0
    frame(spark, TEXTS[:12]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op13_personal(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS[:12]):
        spans = plain(t)
        text = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(k == n for k, *_ in spans) for n in range(4))
        assert rows[i].spans.startswith(text)
