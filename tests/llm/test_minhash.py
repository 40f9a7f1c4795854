import random
import re

import numpy as np
import pytest

from weftline.llm import minhash
from weftline.llm.components import components


def shingles(text, size=5):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def classes(rows, threshold=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if rows[i][0] == rows[j][0] or a == b or (a and b and len(a & b) >= threshold * len(a | b)):
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[y] = x
    return sorted((r[0], rows[find(i)][0]) for i, r in enumerate(rows) if r[0] is not None)


def found(frame):
    return sorted((r["doc_id"], r["class_id"]) for r in frame.collect() if r["doc_id"] is not None)


def test_classes_equal_brute_force_on_nasty_documents(nasty):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    got = minhash.near_duplicates(nasty)
    assert got.columns == ["doc_id", "class_id", "kept"]
    assert found(got) == classes(rows)
    assert got.count() == len(rows)
    assert {(r["class_id"], r["kept"]) for r in got.where("doc_id is null").collect()} == {(None, True)}


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_chains_and_large_groups_are_whole(spark, rounds, monkeypatch):
    monkeypatch.setattr(minhash, "WIDE", 8)
    rng = random.Random(rounds)
    base = [str(rng.randrange(10**6)) for _ in range(150)]
    rows, now = [], list(base)
    for i in range(40):  # a chain: neighbours are near, the ends are not
        rows.append((i, " ".join(now)))
        now[rng.randrange(150)] = f"c{i}"
    for i in range(60):  # copies with edits of their own
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"e{i}{rng.random()}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000 + i, " ".join(base[:90] + [str(rng.random()) for _ in range(60)])) for i in range(40)]  # a common passage only
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds)
    assert found(got) == classes(rows)


def test_wide_buckets_keep_pairs_of_one_common_band(spark, monkeypatch):
    monkeypatch.setattr(minhash, "WIDE", 4)
    members = spark.createDataFrame([(7, i, i, 20) for i in range(20)], "key long, a long, comp long, c long")
    vertices = spark.createDataFrame([(i, 10, [7, 100 + i], [0] * 8) for i in range(20)], "a long, n long, bands array<long>, parity array<long>")
    got = minhash._across(members, vertices, 0.8).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(a, b) for a in range(20) for b in range(a)]


def test_words_of_a_pattern_stay_apart(spark):
    """Words that meet under every sum of powers modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = spark.createDataFrame([(1, " ".join([x] * 9)), (2, " ".join([y] * 9)), (3, x), (4, y)], "doc_id long, text string")
    for counted in (False, True):
        assert [c for _, c in found(minhash.near_duplicates(rows, counted=counted))] == [1, 2, 3, 4]


def test_equal_words_are_one_vertex_whatever_stands_between(spark):
    rows = [(1, "One two, three; four five SIX"), (2, "one two three four five six "), (3, "one two three four fivesix"), (4, "onetwo three four five six"), (5, "!"), (6, ""), (7, None)]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == classes(rows)


def test_one_of_each_keeps_rows_not_ids(spark):
    a, b = ("words of the first text " * 3, "another text about other things altogether " * 2)
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, b, "y"), (None, a, "z"), (None, "only here stands this text of some words", "z"), (3, None, "w"), (4, "", "w")]
    got = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row_number string"))
    assert got.columns == ["doc_id", "text", "row_number"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("1", a), ("1", b), ("None", rows[5][1]), ("3", None)])


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_no_text_is_shuffled_to_keep_one_of_each(spark, monkeypatch, room):
    """However many rows stay: their numbers go to the texts. Without room for these a join gives the same."""
    monkeypatch.setattr(minhash, "BROADCAST", room)
    rows = [(i, f"{i % 150} some words of text number {i % 150} and so on") for i in range(300)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        moved = "hashpartitioning" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in got.collect()) == list(range(150))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved == (not room)


def test_query_columns(spark, data):
    got = minhash.op1_minhash_near_dedup(spark, data)
    assert got.dtypes == [("doc_id", "bigint"), ("class_id", "bigint"), ("kept", "boolean")]
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_empty_table(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 2**63, 400, dtype=np.uint64)
    wx, wy = rng.random(400) * 3, rng.random(400) * 3
    wy[:200] = wx[:200]
    row = np.repeat([0, 1], 400)
    sig = minhash.dart_minhash(row, np.concatenate([ids, ids]), np.concatenate([wx, wy]), 3, 2000)
    true = np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=0.05)
    assert (sig[2] == 0).all()


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 50, dtype=np.uint64)
    alone = minhash.dart_minhash(np.zeros(50, int), ids, np.ones(50), 1, 64)
    more = minhash.dart_minhash(np.repeat([0, 1], [7, 50]), np.concatenate([ids[:7] + np.uint64(1), ids]), np.ones(57), 2, 64)
    assert (alone[0] == more[1]).all()


def test_parity_bound_never_excludes_a_pair_at_the_threshold():
    rng = np.random.default_rng(2)
    for n in (5, 60, 400, 5000):
        core, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (n, n // 9, n // 9))
        maps = minhash.parity(np.repeat([0, 1], [n + n // 9] * 2), np.concatenate([core, a, core, b]), None, 2)
        differ = sum(int(x ^ y).bit_count() for x, y in zip(*maps.view(np.uint64).tolist(), strict=True))
        assert differ <= len(a) + len(b)


def test_bags_count_copies(spark):
    text = "one two three four five"
    rows = spark.createDataFrame([(1, " ".join([text] * 4)), (2, " ".join([text] * 40))], "doc_id long, text string")
    assert found(minhash.near_duplicates(rows)) == [(1, 1), (2, 1)]
    assert found(minhash.near_duplicates(rows, counted=True)) == [(1, 1), (2, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 3), (3, 7), (9, 8), (None, 1), (8, 3)] + [(1000, 2000 + i) for i in range(50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 8: 3, 9: 3} | {1000: 1000} | {2000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
