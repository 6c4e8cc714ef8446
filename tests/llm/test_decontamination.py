"""Benchmark windows against direct search, with nulls, short items, repeats and odd columns."""

import hashlib
import re

from ratelens.llm.decontamination import decontaminate, find_contamination

WINDOW = 10
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASE = " ".join(f"w{i}" for i in range(25))
ITEMS = [("a", PHRASE), ("b", "Short Item"), ("c", None), ("d", "  !? "), ("e", "w3 " * 12), ("f", "Äpfel über 12 w1"), ("g", " ".join(f"w{i}" for i in range(5, 17)))]
TEXTS = [
    None, "", "nothing to see", "x " + PHRASE.upper().replace(" ", ", ") + " y", " ".join(f"w{i}" for i in range(2, 11)), " ".join(f"w{i}" for i in range(2, 12)),
    "a short item here, and SHORT-item again", "w3 " * 30, "äpfel über 12 w1; Äpfel über 12 w1", "w4 w5 w6 " + PHRASE[:60], PHRASE + " " + "z " * 20_000 + PHRASE, PHRASE, PHRASE,
]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text):
    own, hit, items = words(text), set(), set()
    for name, item in ITEMS:
        w = words(item)
        windows = [w[i : i + WINDOW] for i in range(len(w) - WINDOW + 1)] if len(w) >= WINDOW else [w] if w else []
        for window in windows:
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    items.add(name)
    return len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def frames(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit string, `a.b` int")
    return docs, spark.createDataFrame(items, "item_id string, text string")


def test_hits_equal_direct_search(spark):
    docs, items = frames(spark, TEXTS)
    found = {r["doc_id"]: r for r in find_contamination(docs.select("doc_id", "text"), items, drop=("text",)).collect()}
    for i, t in enumerate(TEXTS):
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(t), (t or "")[:50]


def test_empty_tables_and_kept_columns(spark):
    docs, items = frames(spark, TEXTS)
    assert decontaminate(docs, items).columns == docs.columns
    none = items.where("false")
    assert not any(r["contaminated"] for r in find_contamination(docs.select("doc_id", "text"), none).collect())
    assert find_contamination(docs.select("doc_id", "text").where("false"), items).count() == 0
