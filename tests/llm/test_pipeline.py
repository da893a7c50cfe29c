"""The pipeline's stages against brute force over a small table."""

import random
import re

import corpus_pipeline
from quefrency.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    pool = [a + b for a in ("the", "and", "ing", "her", "ion") for b in ("re", "st", "ou", "ea", "nd", "on")]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    shared, item = text(60), text(20)
    rows = [(i, text(120)) for i in range(12)] + [(20, "!!! 123"), (21, None), (22, text(50) + " " + item + " " + text(50)), (23, shared + " " + text(40)), (24, text(40) + " " + shared)]
    rows += [(30, rows[0][1]), (31, rows[1][1] + " more")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = queries.table(spark, str(tmp_path), "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append(docs)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    everything = {i for i, _ in rows}
    assert ids[0] == everything - {20, 21} and ids[1] == ids[0] - {30, 31} and ids[2] == ids[1] and ids[3] == ids[2] - {22} and ids[4] == ids[3]
    kept = {r.doc_id: (r.text, r.n_chars) for r in seen[2].collect()}
    given = dict(rows)
    assert kept[5] == (given[5], len(given[5]))
    assert WORD.findall(kept[23][0]) == WORD.findall(given[23])[60:] and WORD.findall(kept[24][0]) == WORD.findall(given[24])[:40]
    assert all(x.columns == ["doc_id", "text", "lang", "source", "n_chars"] for x in seen[:-1])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == ids[4]
