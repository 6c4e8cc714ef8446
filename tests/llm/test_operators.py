"""Training-data operators against brute force on small frames with nulls, ties, repeats and odd columns."""

import hashlib
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratelens.llm import chat, quality, repeats, secrets, toxicity, weighted_minhash
from ratelens.llm.packing import balance
from ratelens.llm.simhash import fingerprint as simhash
from ratelens.llm.simhash import keep_one, near_duplicates
from ratelens.llm.weighted_minhash import edited_fingerprints

SCHEMA = "doc_id long, text string, score string, `a.b` int"
LONG = " ".join(f"w{i * i % 9973}" for i in range(30_000))
ONE = "8e7efd6dfb178cf1a0720c3091b0dd30d26df5f8f2e835d0"
PASSAGE = " ".join(f"p{i * 7919 % 1009}" for i in range(120))
TEXTS = [None, "", "  ", "one", "one", LONG, LONG + " end", PASSAGE, "head " + PASSAGE + " tail", "é ü " * 200 + PASSAGE[:450], "a" * 1000, "x" + PASSAGE[50:500] + "y"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], SCHEMA)


def test_fingerprints_follow_the_edit_and_jaccard(spark):
    found = {r.doc_id: r for r in edited_fingerprints(frame(spark)).collect()}
    ids = sorted(found, reverse=True)
    assert len(ids) == len(TEXTS)

    def jaccard(a, b):
        a, b = (Counter(re.split("[ \t\r\n]+", x)) for x in (a, b))
        return sum((a & b).values()) / sum((a | b).values())

    for n, i in enumerate(ids):
        text, after = TEXTS[i] or "", TEXTS[ids[(n + 1) % len(ids)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (found[i].n_chars, found[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(found[i].near_edited - jaccard(text, edited)) < 0.45
        assert abs(found[i].near_next - jaccard(text, after)) < 0.45
    assert found[0].fingerprint == found[1].fingerprint and found[3].fingerprint == found[4].fingerprint
    assert edited_fingerprints(frame(spark, [])).count() == 0


def test_edited_texts_where_all_ids_are_null(spark):
    texts = sorted(["aaa bbb ccc", "ddd eee fff ggg", "zzz yyy"])
    rows = spark.createDataFrame([(None, t) for t in reversed(texts)], "doc_id long, text string")
    found = {r.n_chars: r.edited_sha256 for r in edited_fingerprints(rows, samples=4).collect()}
    for t, after in zip(texts, texts[1:] + texts[:1], strict=True):
        third = len(t) // 3
        assert found[len(t)] == hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()


def test_fingerprints_shuffle_the_texts_once_and_nothing_else(spark):
    rows = spark.createDataFrame([(i, f"w{i} same words w{i // 2}", "s", 1) for i in range(300)], SCHEMA)
    found = edited_fingerprints(rows, samples=4)
    assert len(found.collect()) == 300
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    exchanges = [x for x in lines if re.search(r"[-:] (Exchange|ReusedExchange)", x)]
    assert sum("ReusedExchange" in x for x in exchanges) == len(exchanges) - 1, exchanges
    # The signature that a row is compared with is that of the next row, the first row of the next range included.
    by = {r.doc_id: r for r in found.collect()}
    for i in range(300):
        own, after = by[i].fingerprint, by[(i - 1) % 300].fingerprint
        assert by[i].near_next == sum(own[k : k + 8] == after[k : k + 8] for k in range(0, 32, 8)) / 4


def test_fingerprints_do_not_depend_on_how_many_samples_are_sought_at_once(spark, monkeypatch):
    """Logarithms are taken of few samples: of none that cannot be least, then of all terms where none was below the rank."""
    texts = [None, "", "one", "one", "a a b\tc", "a a a\nb", "é  ü é " * 40 + PASSAGE[:200], PASSAGE, "head " + PASSAGE]
    found = []
    for reach in (1e-30, 0.3, 9.0, 1e30):
        monkeypatch.setattr(weighted_minhash, "REACH", reach)
        found.append(sorted(edited_fingerprints(frame(spark, texts), samples=6).collect(), key=lambda r: r.doc_id))
    assert found[0] == found[1] == found[2] == found[3]
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 48 for r in found[0])
    # The samples as they were before any were left out.
    assert found[0][2].fingerprint == found[0][3].fingerprint == ONE
    both = weighted_minhash.fingerprint(frame(spark, texts), samples=6).collect()
    assert {r.doc_id: r.fingerprint for r in both} == {r.doc_id: r.fingerprint for r in found[0]}


def test_repeats_against_brute_force(spark):
    texts = [(t or "").encode() for t in TEXTS]
    seen = Counter(hash(t[i : i + 400]) for t in texts for i in range(len(t) - 399))
    found = {r.doc_id: r for r in repeats.remove_repeats(frame(spark)).collect()}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans) == (len(t), sum(gone), spans)
        assert found[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_secrets(spark):
    random = "kR8x/Zq2Lw9TfB7mYc4HsVd1Jp6NgAe3UoXi0KtW"
    texts = ["é password='abcdefgh' token: abc", "AKIA" + "A1B2C3D4E5F6G7H8", "0123456789abcdef01234567 ", f"see {random} there", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", None, ""]
    found = {r.doc_id: r for r in secrets.find_secrets(frame(spark, texts)).collect()}
    assert [tuple(s) for s in found[0].base] == [(2, 0, 20)]
    assert [tuple(s) for s in found[1].base] == [(0, 1, 20)]
    assert [tuple(s) for s in found[2].base] == [(0, 2, 24)]
    assert [tuple(s) for s in found[3].secrets] == [(4, 3, 4 + len(random))]
    assert found[4].secrets == found[5].secrets == found[6].secrets == []
    clean = secrets.redact(frame(spark, texts))
    assert clean.columns == frame(spark, texts).columns
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert rows[0] == "é [SECRET]' token: abc" and rows[3] == "see [SECRET] there" and rows[5] is None
    assert secrets.find_secrets(frame(spark, [])).count() == 0


def test_chat_round_trip(spark):
    said = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|x <\\\\| \\", None, "", "plain"]
    rows = [(c, n, role, t) for c in (1, None) for n, (role, t) in enumerate(zip(["user", "assistant", "a\nb\\", None, "assistant"], said, strict=True))]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id")
    for r in chat.digests(chat.format_chats(turns)).collect():
        whole = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in rows[:5])
        learnt = (said[1] or "") + said[4]
        assert (r.n_turns, r.loss_chars) == (5, len(learnt))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


def test_chat_layouts(spark):
    records = [
        {"prompt": "q", "completion": "a"}, {"instruction": "q", "input": "", "output": "a"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"strange": 1},
    ]
    given = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "{")]
    found = chat.record_turns(spark.createDataFrame(given, "id long, j string"), "id", "j").collect()
    assert {i: [(r.role, r.text) for r in sorted(found, key=lambda r: r.turn) if r.conv == i] for i in {r.conv for r in found}} == dict.fromkeys(range(4), [("user", "q"), ("assistant", "a")])
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "id long, z int"), "id")


def test_classifiers_learn_and_define_edges(spark):
    bad = ["you idiot scum fool"] * 3 + ["a moron and idiot " + str(i) for i in range(60)]
    good = ["a calm walk " + " ".join(f"t{i * k % 17}" for k in range(9)) for i in range(120)]
    texts = bad + good + [None, ""]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= len(bad)), int(i < len(bad))) for i in range(len(texts) - 2)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert min(scores[i] for i in range(3, len(bad))) > max(scores[i] for i in range(len(bad), len(bad) + len(good)))
    assert scores[len(texts) - 1] == scores[len(texts) - 2]
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    shouted = frame(spark, [t.upper() + "!!!" if t and i < len(bad) else t for i, t in enumerate(texts)])
    judge = quality.fit_quality(shouted, labels)
    scores = {r.doc_id: r.score for r in quality.score_quality(shouted, judge).collect()}
    assert max(scores[i] for i in range(len(bad))) < 0.3 < min(scores[i] for i in range(len(bad), len(bad) + len(good)))
    empty = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, empty).collect()} == {0.5}
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


def test_simhash_against_all_pairs(spark):
    texts = TEXTS + [PASSAGE + " more", "ONE"]
    prints = [simhash((t or "").encode()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group = [group[j] if g == group[i] else g for g in group] if group[j] < group[i] else [group[i] if g == group[j] else g for g in group]
    found = {r.doc_id: r for r in near_duplicates(frame(spark, texts)).collect()}
    assert [int(found[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [found[i].component_id for i in range(len(texts))] == group
    assert sorted(r.doc_id for r in keep_one(frame(spark, texts)).collect()) == sorted(set(group))


def test_balanced_windows_hold_every_piece():
    pieces = [(i, 0, 1 + i * 37 % 500) for i in range(200)]
    windows = balance(pieces, 2048)
    assert sorted(p for w in windows for p in w) == pieces
    assert max(sum(n for _, _, n in w) for w in windows) <= 2048


def test_held_out_is_a_crc_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", toxicity.held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_packing_encoder_equals_the_tokenizer():
    import numpy as np
    import public_tokenizers

    from ratelens.llm.packing import Encoder

    texts = ["", " ", "it's 12 o'clock||x | y", "É²¼ Straße\nÀ'LL", "tab\tİ ǅ <|endoftext|> b", "日本 éx | ", "zq" * 300, LONG[:5000]]
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in texts:
        ids = encoder.model.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, dtype="<u4").tobytes()


def test_toxicity_learns_what_only_two_terms_together_say():
    import numpy as np

    draw = np.random.default_rng(3)

    def texts(rows):
        out = []
        for a, b in draw.integers(0, 2, (rows, 2)):
            words = [f"fill{n}" for n in draw.integers(0, 40, 8)] + ["insultx"] * a + ["groupx"] * b
            out.append((" ".join(draw.permutation(words)).encode(), int(a == b)))  # each word alone says nothing
        return out

    seen = texts(600)
    model = toxicity.fit([toxicity.terms(t) for t, _ in seen], [y for _, y in seen])
    new = texts(300)
    assert sum((model.score(t) >= toxicity.THRESHOLD) == y for t, y in new) >= 0.95 * len(new)


def test_quality_reads_words_not_layout_alone():
    import numpy as np

    good, bad = ["calm", "river", "window", "lantern"], ["zarp", "quolt", "blexid", "fronzak"]
    draw = np.random.default_rng(5)

    def texts(rows):
        shapes = draw.integers(0, 4, (rows, 30))
        return [(" ".join((good if n % 2 else bad)[k] for k in shape).encode(), n % 2) for n, shape in enumerate(shapes)]

    seen, new = texts(200), texts(100)
    judge = quality.fit(np.stack([quality.term_vector(t) for t, _ in seen]), [y for _, y in seen])
    score = judge.score(np.stack([quality.term_vector(t) for t, _ in new]))
    assert ((score >= quality.THRESHOLD) == [y for _, y in new]).mean() >= 0.95
    vector = quality.term_vector(seen[0][0])
    assert (quality._unpacked([quality._packed(vector)])[0] == vector).all()


def test_fingerprints_are_within_three_standard_errors(spark):
    def jaccard(a, b):
        a, b = (Counter(re.split("[ \t\r\n]+", x)) for x in (a, b))
        return sum((a & b).values()) / sum((a | b).values())

    texts = []
    for i in range(60):  # neighbours share between none and nearly all of their words
        shared = 3 * i + 10
        texts += [" ".join(f"s{i}x{k}" for k in range(shared)) + " " + " ".join(f"{side}{i}x{k}" for k in range(200 - shared)) for side in "ab"]
    found = {r.doc_id: r for r in edited_fingerprints(frame(spark, texts)).collect()}
    errors = []
    for i in range(1, len(texts), 2):
        true = jaccard(texts[i], texts[i - 1])
        errors.append((found[i].near_next - true) / (true * (1 - true) / 128) ** 0.5)
    assert max(map(abs, errors)) < 4  # of 60 draws; three standard errors hold for nearly all
    assert sum(abs(e) > 3 for e in errors) <= 1
    assert abs(sum(errors)) / len(errors) < 3 / len(errors) ** 0.5
    assert len(found[0].fingerprint) == 8 * 128
