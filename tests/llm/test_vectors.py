import math

import numpy as np
import pytest

from weftline.llm import pq, topk

INF, NAN = math.inf, math.nan


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS e", "'y' AS copies", "1 AS list", "2 AS v", "3 AS rank")


def near_rows(seed=0, n=160, dim=12):
    """Some groups of near vectors, equal ones, scaled ones, and what can't link."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(8, dim))
    rows = [(i, (heads[i % 8] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 1.0])).tolist(), int(i % 16 // 8)) for i in range(n)]
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(12)] + [(n + 20, [2 * x for x in rows[0][1]], rows[0][2]), (n + 21, rows[0][1], 1 - rows[0][2]), (n + 22, [-x for x in rows[0][1]], rows[0][2])]
    return rows + [(900, None, 0), (901, [0.0] * dim, 0), (902, [NAN] + [1.0] * (dim - 1), 0), (903, [INF] + [0.0] * (dim - 1), 0), (904, [None] + [1.0] * (dim - 1), 0), (905, [], 0), (906, rows[0][1], None), (None, rows[0][1], 0), (907, [1e200] * dim, 0), (908, [1e-200] * dim, 0), (909, rows[3][1][:4], rows[3][2]), (0, rows[0][1], rows[0][2])]


def brute_links(rows, cosine=0.93):
    usable = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = (np.array(v, float) / max(map(abs, v)), lab)
    width = max(len(v) for v, _ in usable.values())
    x = {i: (np.pad(v, (0, width - len(v))), lab) for i, (v, lab) in usable.items()}
    links = {i: [j for j in x if j != i and x[i][1] == x[j][1] and x[i][0] @ x[j][0] / np.linalg.norm(x[i][0]) / np.linalg.norm(x[j][0]) >= cosine] for i in x}
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links.get(todo.pop(), ()) if j not in seen]
            seen.update(new)
            todo += new
        out[i] = (len(links.get(i, ())), None if i is None else min(seen), None if i is None else i == min(seen))
    return sorted((str(i), *map(str, out[i])) for i, _, _ in rows)


@pytest.mark.parametrize(("per_list", "block"), [(4000, 2048), (10, 2048), (10, 7)])
def test_links_equal_brute_force(spark, monkeypatch, per_list, block):
    monkeypatch.setattr(pq, "PER_LIST", per_list)
    monkeypatch.setattr(pq, "BLOCK", block)
    monkeypatch.setattr(pq, "CHUNK", block)
    rows = near_rows(per_list + block)
    got = sorted((str(r["vec_id"]), str(r["n_links"]), str(r["component_id"]), str(r["kept"])) for r in pq.near_duplicates(table(spark, rows)).collect())
    want = [(a, b, c, "True" if a == "None" else d) for a, b, c, d in brute_links(rows)]
    assert got == want


def test_no_vectors(spark):
    assert pq.near_duplicates(table(spark, [])).count() == 0
    assert pq.near_duplicates(table(spark, [(1, None, None)])).collect()[0]["n_links"] == 0


def test_links_in_sql(spark, data, duck, same):
    same(pq.op3_embedding_near_dedup(spark, data).toPandas(), duck(pq.SQL, data))


def test_table_distances_are_off_by_what_codes_miss_at_most():
    rng = np.random.default_rng(5)
    x = pq.unit(rng.normal(size=(300, 16)))
    model = pq.fit(x, 6)
    _, near = model.nearest(x)
    codes, missed = model.encode(x - model.centroids[near])
    dim = model.books.shape[2]
    spelt = model.centroids[near] + np.concatenate([model.books[p][codes[:, p]] for p in range(model.books.shape[0])], axis=1)
    assert dim * model.books.shape[0] == 16
    assert np.linalg.norm(x - spelt, axis=1) == pytest.approx(missed, abs=1e-9)
    d, e = np.linalg.norm(x[:, None] - x[None], axis=2), np.linalg.norm(x[:, None] - spelt[None], axis=2)
    assert (np.abs(d - e) <= missed[None] + 1e-9).all()


def brute_top(rows, k=10, every=100):
    good = {}
    out = []
    q = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(1024 * x) for x in v])
            q.append((i, good[i][-1]))
    for i in good:
        if i % every == 0:
            mine = min(good[i])
            scored = sorted((-max(min(sum(a * b for a, b in zip(mine, v, strict=False)), 2**63 - 1), -(2**63)), j) for j, v in q if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("budget", [16 << 20, 200])
def test_top_k_equals_brute_force(spark, budget):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=40).round(1 if i % 3 else 6).tolist(), 0) for i in range(400)]
    rows += [(500 + i, rows[100][1], 0) for i in range(15)] + [(700, None, 0), (800, [NAN] * 40, 0), (900, [], 0), (1000, [1.0, -2.5], 0), (None, rows[0][1], 0), (1100, rows[7][1], 0), (1100, rows[8][1], 0)]
    v = topk.quantised(table(spark, rows))
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), budget=budget).collect())
    assert got == brute_top(rows)


def test_top_k_of_few_and_of_large_numbers(spark):
    rows = [(0, [3.0, 1e9], 0), (1, [-1e9, 1e9], 0), (2, [1e15, 1e15], 0)]
    v = topk.quantised(table(spark, rows))
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0")).collect())
    assert got == brute_top(rows)
    none = topk.quantised(table(spark, []))
    assert topk.top_k(none, none).count() == 0
    assert topk.top_k(v, none).count() == 0


def test_top_k_in_sql(spark, data, duck, same):
    same(topk.op7_exact_topk(spark, data).toPandas(), duck(topk.SQL, data))


def test_bounds_prune_without_loss():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(-5, 5, (500, 64)), rng.integers(-500, 500, (30, 64))])
    q = rng.integers(-500, 500, (5, 64))
    search = topk.Search(np.arange(5) + 10_000, q, 10)
    for lo in range(0, len(x), 100):
        search.add(np.arange(lo, min(lo + 100, len(x))), x[lo : lo + 100])
    for i in range(5):
        s = x @ q[i]
        order = np.lexsort((np.arange(len(s)), -s))[:10]
        assert (search.best[i][1] == order).all()
        assert (search.best[i][0] == s[order]).all()
