"""Each pipeline stage against brute force, and the whole run."""

import zlib

import numpy as np

import corpus_pipeline
from sievewright.llm import queries

from . import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in queries.op5_quality(spark, sf_dir).collect()}
    one = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert one.columns == docs.columns
    kept = {r.doc_id: r for r in one.collect()}
    assert set(kept) == {i for i, k in verdict.items() if k} and all(kept[i] == rows[i] for i in kept)
    two = corpus_pipeline.dedup_stage(spark, one, sf_dir)
    want = brute.near_duplicates([(i, r.text) for i, r in kept.items()], per_cent=80)
    left = {r.doc_id: r for r in two.collect()}
    assert two.columns == docs.columns and set(left) == {i for i, x in want.items() if x[2]}
    three = corpus_pipeline.secrets_stage(spark, two, sf_dir)
    assert three.columns == docs.columns
    done = {r.doc_id: r for r in three.collect()}
    assert set(done) == set(left)
    for i, r in done.items():
        assert brute.secrets(r.text)[:3] == (0, 0, 0) and r.n_chars == len(r.text)
        if brute.secrets(left[i].text)[:3] == (0, 0, 0) and "[REDACTED]" not in r.text:
            assert r == left[i]
    pieces = corpus_pipeline.run(spark, sf_dir)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(np.array(r.ids, "<u4").tobytes())} for r in pieces.collect()]
    brute.check_packing([(i, r.text) for i, r in done.items()], rows, lambda t: tok.encode(t, add_special_tokens=False).ids)


def test_stage_edges(spark):
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 10))) for _ in range(100))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, text + " token=abcdefabcdefabcd9", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, "")
        assert got.columns == docs.columns
        empty = stage(spark, docs.limit(0), "")
        assert empty.columns == docs.columns and empty.count() == 0
        if name == "quality":
            assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 1, 2, 5]
    # The copies without an id and with a larger one go, the row that repeats id and text as well, and so does the near copy.
    assert sorted(((r.doc_id or 0), r.text == text) for r in got.collect()) == [(1, True)]
    again = corpus_pipeline.dedup_stage(spark, docs.filter("doc_id is null or doc_id in (3, 4)"), "")
    assert sorted((r.doc_id or 0) for r in again.collect()) == [0, 3, 4]
    alone = corpus_pipeline.secrets_stage(spark, docs, "").collect()
    assert [r.text for r in alone if r.doc_id in (3, 4)] == [None, ""] and "[REDACTED]" in next(r.text for r in alone if r.doc_id == 5)
    assert corpus_pipeline.STAGES[3][1](spark, got, "").count() == 1
