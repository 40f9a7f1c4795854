import os
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_held_out_fold(spark):
    got = {r["i"]: r["h"] for r in spark.range(200).select(F.col("id").alias("i"), quality.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    # without copies of texts that the model has seen
    seen = docs.join(labels.where(~quality.held_out(F.col("doc_id"))), "doc_id").select("text").distinct()
    rows = quality.score(docs.join(seen, "text", "left_anti"), model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    good = [r["score"] >= quality.THRESHOLD for r in rows if r["quality"] == 1]
    bad = [r["score"] < quality.THRESHOLD for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.97
    assert sum(bad) / len(bad) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_model_does_not_see_the_held_out_labels(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, flipped)


def test_few_or_no_labels(spark, nasty, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(nasty, quality.train(nasty, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (4, 1), (None, 0), (7, None)], "doc_id long, quality int")
    scores = quality.score(nasty, quality.train(nasty, one)).collect()
    assert len(scores) == nasty.count()
    assert all(0 <= r["score"] <= 1 for r in scores)
    few = spark.createDataFrame([(i, i % 2) for i in range(100, 160)], "doc_id long, quality int")
    model = quality.train(nasty, few)
    scores = quality.score(nasty, model).collect()
    assert len(scores) == nasty.count()
    assert all(0 <= r["score"] <= 1 for r in scores)
    assert quality.score(no_docs, model).count() == 0


def test_filter_keeps_rows_and_columns(nasty, tables):
    model = quality.train(*tables)
    kept = quality.keep_good(nasty, model)
    assert kept.columns == nasty.columns
    want = sorted(str(r["doc_id"]) for r in quality.score(nasty, model).where(F.col("score") >= quality.THRESHOLD).collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert quality.keep_good(nasty, model, 0.0).count() == nasty.count()


def plain_scores(rows, model):
    """Each text cut, compressed under both dictionaries and looked up on the curve, one by one."""
    import zstandard

    made = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        cuts = [raw[k : k + quality.CHUNK] for k in range(0, len(raw), quality.CHUNK)]
        x = sum(len(made[0].compress(c)) - len(made[1].compress(c)) for c in cuts) / (len(raw) + 16)
        xs, ys = model.curve
        k = sum(v <= x for v in xs)
        y = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k - 1] + (ys[k] - ys[k - 1]) * (x - xs[k - 1]) / (xs[k] - xs[k - 1])
        out.append((str(i), round(y, 9)))
    return sorted(out)


def test_scores_equal_brute_force(spark, nasty, tables):
    model = quality.train(*tables)
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in quality.score(nasty, model).collect()) == plain_scores(rows, model)
    docs = tables[0].where("doc_id % 9 = 0")
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in quality.score(docs, model).collect()) == plain_scores([(r["doc_id"], r["text"]) for r in docs.collect()], model)


def test_curve_falls_and_is_nearest():
    import numpy as np

    x, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([1.0, 1, 0, 1, 0, 0])
    xs, ys = quality.falling(x, y)
    assert list(xs) == [0, 1, 2, 3, 4, 5]
    assert list(ys) == [2.5 / 3, 2.5 / 3, 0.5, 0.5, 0.5 / 3, 0.5 / 3]
    rng = np.random.default_rng(0)
    xs, ys = quality.falling(rng.random(200), rng.integers(0, 2, 200))
    assert all(a <= b for a, b in zip(xs, xs[1:])) and all(a >= b for a, b in zip(ys, ys[1:]))


def test_contradictions_and_repeated_ids(spark):
    rows = [(i, ("good text of words %d " % i) * 30 if i % 2 else ("!!bad %d## " % i) * 30) for i in range(200)]
    docs = spark.createDataFrame(rows + [(1, "another text of the same id")] * 3, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(200)]
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.curve
    both = quality.train(docs, spark.createDataFrame(labels + [(i, 1 - i % 2) for i in range(0, 200, 3)] + labels, "doc_id long, quality int"))
    less = quality.train(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int"))
    assert (both.good, both.bad, both.curve) == (less.good, less.bad, less.curve)
    assert quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), build_bytes=2000).good != model.good


def test_whole_texts_count():
    sizes = quality.Sizes(b"good words " * 20, b"!!## junk " * 20)
    assert sizes.difference(b"ab" * 50_000 + b"!!## junk " * 40) != sizes.difference(b"ab" * 50_200)
    assert sizes.difference(b"") == 0.0


def test_query_columns(spark, data):
    got = quality.op4_quality_classifier(spark, data)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())
