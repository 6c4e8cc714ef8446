"""The pipeline on a small table: what each stage has to take out and what it has to leave."""

import random
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from ratelens.llm.tokens import tokenizer

PASSAGE = " ".join(f"bench{i}" for i in range(30))
SECRET = "password = hunter2secret99"


def texts():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ke", "lo") for b in ("mi", "nu", "ra") for c in ("ts", "vo", "x", "y")]
    prose = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(99)) for _ in range(n))
    out = {i: prose(60) for i in range(40)}
    out[40] = out[41] = out[42] = prose(80)
    out[43] = prose(30) + " " + PASSAGE + " " + prose(30)
    out[44] = prose(30) + " " + SECRET + " " + prose(30)
    out[45] = prose(5000)
    out[46], out[47] = None, ""
    return out


def test_stages_take_out_what_they_have_to_and_nothing_else(spark, tmp_path):
    given = texts()
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in given.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("item", PASSAGE)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    seen = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, folder)
        if name != "packing":
            assert rows.columns == docs.columns
            path = f"{folder}/{name}"
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
            seen[name] = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert seen["toxicity"] == given
    kept = seen["near_dedup"]
    assert len({40, 41, 42} & set(kept)) == 1 and len({46, 47} & set(kept)) == 1
    assert set(given) - set(kept) <= {40, 41, 42, 46, 47}
    clean = seen["decontamination"]
    assert all(clean[i] == kept[i] for i in clean if i != 43)
    assert not any(f"bench{i}" in (clean.get(43) or "") for i in range(30))
    safe = seen["secret_scan"]
    assert "hunter2" not in safe[44] and all(safe[i] == clean[i] for i in safe if i != 44)
    model = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in safe.items()}
    pieces = rows.collect()
    for r in pieces:
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])])
    assert sum(r["length"] for r in pieces) == sum(len(v) // 4 for v in want.values())
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in again.collect()) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces)
