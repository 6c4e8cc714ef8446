"""Phrase mining against brute force, with several passes, odd texts and hash groups that collide."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratelens.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, `a.b` int"
TEXTS = [
    ("the big red dog. The big\tred  dog! the big red dog, runs", "en"), ("the big red dog runs; big red", "en"), (None, "en"), ("", None), ("  \t", "en"),
    ("red dog red dog red dog red dog red dog", "en"), ("über ß ÜBER über ß", "de"), ("a a a a a a a", None), ("a a a", "und"), ("x" * 3000 + " y z", "en"),
    ("one two three four five six one two three four five six one two three four five six", "de"), ("big red\nbig red\r\nbig red", "en"), ("big red", "en"), ("big red", "en"),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, lang, "p", 1) for i, (t, lang) in enumerate(texts)], SCHEMA)


def brute(texts, support, longest=co.LONGEST, top=co.TOP):
    f, n = defaultdict(Counter), Counter()
    for text, lang in texts:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            longer = [q for q, b in counts.items() if b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if len(p) < 2 or a < support or longer:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("support", "top"), [(2, co.TOP), (3, 2), (5, co.TOP)])
def test_phrases_and_scores_equal_brute_force(spark, support, top):
    got = co.collocations(frame(spark, TEXTS), support=support, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(TEXTS, support, top=top)


def test_products_beyond_64_bits_stay_exact(spark):
    row = spark.createDataFrame([("en", "a b", 2, 4 * 10**12), ("en", "a", 1, 5 * 10**12), ("en", "b", 1, 7 * 10**12), ("en", "", 0, 9 * 10**13)], "lang string, phrase string, words int, f long")
    got = co.scored(row, co.TOP).first()
    assert got.score == 1000 * 4 * 10**12 * 9 * 10**13 // (35 * 10**24)


def test_equal_first_hashes_are_told_apart():
    one, two = np.array([5, 5, 7, 5, 7], np.uint64), np.array([1, 2, 3, 1, 3], np.uint64)
    places, sizes = co._grouped(one, two)
    assert sorted(zip(one[places].tolist(), two[places].tolist(), sizes.tolist(), strict=True)) == [(5, 1, 2), (5, 2, 1), (7, 3, 2)]


def test_long_texts_go_in_parts_that_end_with_a_piece():
    import pyarrow as pa

    text = "word " * 300_000 + ". " + "next " * 900_000 + "!tail"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "a"])], names=["lang", "text"])
    slices = list(co._slices(iter([batch])))
    assert b"".join(s[0] for s in slices).replace(b"\n", b"").decode() == text + "a"
    assert len(slices) > 1 and all(s[1][-1] == len(s[0]) for s in slices)


def test_empty_table(spark):
    assert co.collocations(frame(spark, [])).count() == 0


def test_languages_and_long_words_that_nearly_collide_are_told_apart(spark):
    morse = "a"  # words of the Thue-Morse sequence have equal sums of powers modulo 2^64, whatever the base
    for _ in range(11):
        morse += morse.translate(str.maketrans("ab", "ba"))
    ends = ["prefix--" + w + "--suffix" for w in (morse, morse.translate(str.maketrans("ab", "ba")))]
    texts = [(f"x {ends[i % 2]} y", "en") for i in range(9)] + [("big red", lang) for lang in ("en", "en\0", "en\0", "e\0n") for _ in range(3)]
    assert sorted(tuple(r) for r in co.collocations(frame(spark, texts), support=2).collect()) == brute(texts, 2)


def test_new_phrases_that_share_the_bit_of_a_counted_one_are_extended():
    part = co._Slice(co._Powers(), b"a b c\n", [6], ["en"])
    everything = np.full((1 << co.BITS) // 8, 255, np.uint8)
    counted = everything.copy()
    at = int(part.words[0][0]) >> (64 - co.BITS)
    counted[at >> 3] &= ~np.uint8(1 << (at & 7))  # only the word "a" was missed
    found = [p for b in part.expansions(everything, counted, np.zeros_like(counted), 3, set()) for p in b.column("phrase").to_pylist()]
    assert found == [None, "a b", "a b c"]
