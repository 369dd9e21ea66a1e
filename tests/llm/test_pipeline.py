"""The pipeline's stages, each against plain Python on its own input."""

import brute
import pytest
from pyspark.sql import functions as F
from test_shingles import similar

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("source", ["sf0.001", "odd", "empty"])
def test_pipeline(spark, tmp_path, source):
    import corpus_pipeline
    import public_tokenizers
    import tokenizers

    if source == "sf0.001":
        sf_dir = DATA
    else:
        sf_dir = str(tmp_path)
        rows = brute.odd_documents() if source == "odd" else []
        spark.createDataFrame(rows, brute.DOCUMENTS).withColumn("key", F.lit("x")).withColumn("copies", F.lit(1)).write.parquet(f"{sf_dir}/documents.parquet")
        spark.createDataFrame(brute.odd_benchmark(), "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, bench = before.columns, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars is None, r.n_chars or 0, r.text or "")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/out-{name}"
        stage(spark, before, sf_dir).write.parquet(path)
        after, old = spark.read.parquet(path), before.collect()
        if name != "token_output":
            assert after.columns == columns
        new = after.collect()
        if name == "language_id":
            assert {key(r) for r in new} <= {key(r) for r in old}
            assert all(any(map(str.isalpha, r.text or "")) for r in new)
            assert source == "odd" or len(new) >= 0.97 * sum(any(map(str.isalpha, r.text or "")) for r in old)
        elif name == "near_dedup":
            kept = {d for d, c in similar([(r.doc_id, r.text) for r in old]) if d == c}
            assert {r.doc_id for r in new} == kept
            assert len([r for r in new if r.doc_id is not None]) == len(kept - {None})
        elif name == "decontamination":
            hits = {d for d, _, n, *_ in brute.op10([(r.doc_id, r.text) for r in old], bench) if n}
            assert {key(r) for r in new if r.doc_id not in hits} == {key(r) for r in old if r.doc_id not in hits}
        elif name == "source_mix":
            assert {key(r) for r in new} <= {key(r) for r in old}
            words = lambda rows: sum(len(brute.WORD.findall(r.text or "")) for r in rows)
            assert source == "odd" or words(new) == pytest.approx(words(old), rel=0.02)
            assert all(sum(key(r) == key(x) for r in new) <= 3 * sum(key(r) == key(x) for r in old) for x in old[:50])
        else:
            t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = brute.op3([(r.doc_id, r.text) for r in sorted(old, key=key)], lambda x: t.encode(x, add_special_tokens=False).ids)
            assert len(new) == len(want) and {(r.doc_id, r.n_tokens, r.ids_crc32) for r in new} == {(d, n, c) for d, _, n, c in want}
            placed, at = sorted(new, key=lambda r: r.start), 0
            for r in placed:
                assert r.start == at
                at += r.n_tokens
            ids = [(r.doc_id is not None, r.doc_id or 0) for r in placed]
            assert ids == sorted(ids)
        before = after
    if source != "odd":
        assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, new))
