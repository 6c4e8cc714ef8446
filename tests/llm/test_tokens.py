"""Token counts against the tokenizer, the bound of the frequent table and of the labelled sample."""

import public_tokenizers

from ratelens.llm import tokens
from ratelens.llm.tokens import count_tokens, tokenizer
from ratelens.llm.toxicity import labelled_sample

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, `a.b` int"
TEXTS = [
    None, "", "  ", "one", "one", "it's Über-fast — 12,345 ok?\r\n\tend", "<|endoftext|> inside", "漢字かな交じり文 🙂🙂 naïve", "x" * 5000, "=" * 300,
    " ".join(f"w{i * i % 997}" for i in range(4000)), "line\n" * 700, "\0 nul   sep",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_counts_equal_the_tokenizer(spark):
    model = tokenizer(PATH)
    rows = {r.doc_id: r for r in count_tokens(frame(spark, TEXTS * 2), PATH).collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS * 2):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert count_tokens(frame(spark, []), PATH).count() == 0


def test_the_frequent_table_is_bounded_by_a_frequency(spark, monkeypatch):
    rows = [(f"t{i}", 1000 // (i + 1) + 1, 2) for i in range(500)] + [("long" * 100, 10**9, 3)]
    pieces = spark.createDataFrame(rows, "pre_token string, frequency long, pieces long")
    for most in (1, 7, 50, 499, 500):
        monkeypatch.setattr(tokens, "FREQUENT", most)
        found = tokens._frequent(pieces)
        assert len(found) <= most
        assert not found or max(int(t[1:]) for t in found) == len(found) - 1
    assert len(found) == 500
    assert tokens._frequent(pieces.where("false")) == {}


def test_the_labelled_sample_bounds_rows_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {i % 40}") for i in range(3000)] + [(i, "t") for i in range(2, 30)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    few = labelled_sample(docs, labels, "toxic", "doc_id", "text", 1000, 999, 10).collect()
    assert len(few) == 10
    every = labelled_sample(docs, labels, "toxic", "doc_id", "text", 1000, 999, 4096).collect()
    assert len(every) == 40 + 28 and len(set(every)) == len(every)
