"""Packing against the tokenizer itself: every id once, no gap, no sequence above the capacity, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from ratelens.llm.packing import CAPACITY, pack
from ratelens.llm.tokens import tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, `a.b` int"
TEXTS = [None, "", " ", "one", "one", "Ünder the sea's foam, 12 fish!", "word " * 5000, "x" * 9000, "naïve café 漢字 🙂 <|end|> ok"] + [
    f"doc {i} " + "alpha beta gamma " * (i % 97) for i in range(400)
]


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("checksum", [False, True])
def test_every_id_lies_in_one_piece(spark, checksum):
    model = tokenizer(PATH)
    want = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(TEXTS)}
    rows = pack(frame(spark, TEXTS), PATH, checksum=checksum).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        part = want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert (r.ids_crc32 == zlib.crc32(part)) if checksum else bytes(r.ids) == part
        assert r.doc_tokens == len(want[r.doc_id]) // 4
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids) // 4
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    assert len(sequences) <= sum(len(v) // 4 for v in want.values()) / CAPACITY * 1.15 + 3


def test_repeated_and_null_ids_and_an_empty_table(spark):
    rows = spark.createDataFrame([(None, "a b"), (7, "c"), (7, "c")], "doc_id long, text string")
    got = pack(rows.coalesce(1), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 3), (7, 2), (7, 2)]
    assert len({r.sequence_id for r in got}) == 1
    assert pack(frame(spark, [], 1), PATH).count() == 0
