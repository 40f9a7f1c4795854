import hashlib

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, minhash, mixing, quality, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    kept, steps = docs, []
    for _, stage in pipeline.STAGES:
        before, kept = kept, stage(spark, kept, data).cache()
        steps.append((before, kept))
    for _, after in steps[:-1]:
        assert after.columns == COLUMNS
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).collect()}
    assert {r["doc_id"] for r in steps[0][1].collect()} == good
    assert 0 < len(good) < docs.count()
    alone = minhash.near_duplicates(steps[1][1])
    assert alone.where("not kept").count() == 0
    assert {r["class_id"] for r in minhash.near_duplicates(steps[1][0]).collect()} == {r["doc_id"] for r in steps[1][1].collect()}
    assert steps[2][1].count() == steps[2][0].count()
    assert secrets.scan(steps[2][1]).where(F.exists("spans", lambda s: s["kind"].isin("hex", "access"))).count() == 0
    times = {r["doc_id"]: r["count"] for r in steps[3][1].groupBy("doc_id").count().collect()}
    want = {r["row"]["doc_id"]: r["times"] for r in mixing.mixed(steps[3][0], mixing.n_words(F.col("text"))).collect()}
    assert times == {k: v for k, v in want.items() if v}
    tok = bpe.load(bpe.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in steps[4][0].collect()}
    last = steps[4][1].collect()
    assert len(last) == steps[4][0].count()
    for r in last:
        assert r["ids"] == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, data):
    got = pipeline.run(spark, data)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert got.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nasty_and_empty_tables(spark, data, nasty, no_docs, stage):
    _, f = pipeline.STAGES[stage]
    assert f(spark, no_docs, data).count() == 0
    for docs in (nasty.select(*COLUMNS), nasty):  # with clashing columns too
        got = f(spark, docs, data)
        assert got.count() <= 3 * docs.count()
        if stage < 4:
            assert got.columns == docs.columns
