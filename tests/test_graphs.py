import collections
import itertools
import math
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import frames as fr
from weftline.operators import graph, graphlets, knn, matching, profiles, walks


def frame(spark, points, labels=None, frame_id=0):
    labels = labels or ["a"] * len(points)
    return spark.createDataFrame([(frame_id, i, list(map(float, p)), lab) for i, (p, lab) in enumerate(zip(points, labels, strict=True))], "frame_id int, item_id long, features array<double>, label string")


def edges(spark, pairs, frame_id=0):
    return spark.createDataFrame([(frame_id, min(p), max(p)) for p in pairs], "frame_id int, u long, v long")


@pytest.mark.parametrize("block", [3, 4096])
def test_knn_with_ties_and_copies(spark, block):
    points = [(0, 0), (0, 0), (0, 0), (1, 0), (0, 1), (5, 5), (5, 6), (5, 6)]
    got = {}
    for r in knn.knn_graph(frame(spark, points), 3, scaled=False, block=block).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    x = np.array(points, float)
    for i in range(len(points)):
        want = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in range(len(points)) if j != i)[:3]
        assert [(d, round(e, 9)) for _, d, e in sorted(got[i])] == [(j, round(d, 9)) for d, j in want]


def test_knn_order_is_that_of_scaled_and_turned_frames(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    pairs = lambda p: {(r["src"], r["rank"], r["dst"]) for r in knn.knn_graph(frame(spark, p), 3).collect()}
    assert pairs(x) == pairs(7 * x + 3) == pairs(x @ turn)


def test_fewer_items_than_neighbours_and_empty_frames(spark):
    assert knn.knn_graph(frame(spark, [(0,), (1,)]), 3).count() == 2
    assert knn.knn_graph(frame(spark, [(0,)]), 3).count() == 0
    assert knn.knn_graph(frame(spark, [(0,)]).where("false"), 3).count() == 0


def test_constant_frame_scales_to_null(spark):
    assert fr.minmax_scaled(frame(spark, [(2, 2), (2, 2)])).first()["features"] == [None, None]


def test_undirected_and_directed_views(spark):
    links = spark.createDataFrame([(0, 1, 2, 1, 0.5), (0, 2, 1, 1, 0.5), (0, 3, 1, 1, 0.7), (0, 4, 4, 1, 0.0)], "frame_id int, src long, dst long, rank int, dist double")
    assert sorted((r["u"], r["v"]) for r in graph.undirected(links).collect()) == [(1, 2), (1, 3)]
    assert graph.directed(links).count() == 3
    with pytest.raises(Exception, match="wrong number of neighbours"):
        graph.directed(links.union(links.where("src = 1")), 1).collect()


def test_components_of_sizes(spark):
    got = graph.components(edges(spark, [(1, 2), (3, 4), (4, 5), *((i, i + 1) for i in range(10, 40))]))
    assert {r["component"]: r["size"] for r in graph.component_sizes(got).collect()} == {1: 2, 3: 3, 10: 31}


def test_edge_counts_and_layers(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3)])
    assert graph.edge_count(e).first()["n"] == 3
    assert graph.edge_count(e, 2).first()["n"] == sum(d * (d - 1) for d in (1, 2, 2, 1))
    assert graph.edge_count(e, 3).first()["n"] == 0
    layers = graph.bfs_layers(e, graph.nodes(e), 3).where("seed = 0").collect()
    assert sorted((r["layer"], r["item_id"]) for r in layers) == [(0, 0), (1, 1), (2, 2)]


def all_graphlets():
    """One graph of each class of connected graphs on 3 to 5 nodes, by its canonical edges."""
    out = {}
    for n in (3, 4, 5):
        pairs = list(itertools.combinations(range(n), 2))
        for bits in range(1 << len(pairs)):
            chosen = [p for i, p in enumerate(pairs) if bits >> i & 1]
            near = {i: {a + b - i for a, b in chosen if i in (a, b)} for i in range(n)}
            if graphlets._joined(frozenset(range(n)), near):
                key = min(tuple(sorted(tuple(sorted((m[a], m[b]))) for a, b in chosen)) for m in itertools.permutations(range(n)))
                out[n, key] = list(key)
    return out


def test_types_are_one_to_one_with_the_classes(spark):
    found, rows = all_graphlets(), []
    assert len(found) == 29
    for f, pairs in enumerate(found.values()):
        turned = [(len(found) - a, len(found) - b) for a, b in pairs]
        rows += [(f, min(p), max(p)) for p in turned]
    e = spark.createDataFrame(rows, "frame_id int, u long, v long")
    typed = graphlets.typed_sets(graphlets.connected_sets(e), e)
    size = {f: n for f, (n, _) in enumerate(found)}
    own = {r["frame_id"]: r["gtype"] for r in typed.collect() if len(r["nodes"]) == size[r["frame_id"]]}
    assert sorted(own.values()) == list(range(29))
    for f, pairs in enumerate(found.values()):
        near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in range(5)}
        assert graphlets._shape(frozenset(range(size[f])), near) == own[f]


def test_ambiguous_signatures(spark):
    kite = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)]
    shapes = {12: [(0, 1), (1, 2), (2, 3), (3, 4), (2, 4)], 15: [(0, 1), (1, 2), (2, 3), (3, 4), (4, 1)], 19: [(0, 1), (0, 2), (0, 3), (4, 1), (4, 2), (4, 3)], 20: [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (0, 2)]}
    for kind, pairs in (shapes | {12: kite}).items():
        near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in range(5)}
        assert graphlets._shape(frozenset(range(5)), near) == kind


def test_shares_sum_to_one_and_small_components_have_none(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (8, 9)])
    items = graph.nodes(e)
    shares = graphlets.layered(graphlets.exact_counts(e), graph.bfs_layers(e, items, 1))
    sums = {r["item_id"]: r["s"] for r in shares.groupBy("item_id").agg(F.sum("x").alias("s")).collect()}
    assert sums == pytest.approx({0: 1, 1: 1, 2: 1, 3: 1})


def test_hubs_are_refused(spark, monkeypatch):
    monkeypatch.setattr(graphlets, "MOST_SETS", 5)
    with pytest.raises(ValueError, match="sampled_counts"):
        graphlets.exact_counts(edges(spark, [(0, 1), (0, 2), (0, 3)]))


def test_sampled_profiles_come_near_the_exact_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(25, 3))
    e = graph.undirected(knn.knn_graph(frame(spark, x), 2)).cache()
    dense = lambda c: {(r["item_id"], r["gtype"]): r["cnt"] for r in c.collect()}
    exact, walk = dense(graphlets.exact_counts(e)), dense(graphlets.sampled_counts(e, 400, 5))
    for i in range(25):
        a, b = (np.array([c.get((i, t), 0) for t in range(29)], float) for c in (exact, walk))
        assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.95


def test_similarity_of_equal_frames_is_one_and_zero_vectors_give_zero(spark):
    pairs = matching.consecutive(spark, [4, 7])
    features = spark.createDataFrame([(4, 1, 0, 3, 0.25), (4, 1, 0, 5, 0.75), (7, 1, 0, 3, 0.25), (7, 1, 0, 5, 0.75), (4, 2, 0, 1, 1.0)], "frame_id int, item_id long, layer int, gtype int, x double")
    items = spark.createDataFrame([(f, i) for f in (4, 7) for i in (1, 2, 3)], "frame_id int, item_id long")
    got = {k: {r["item_id"]: r["sim"] for r in matching.point_similarity(pairs, features, items, k).collect()} for k in ("cosine", "rbf", "laplacian")}
    assert got["cosine"] == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0})
    assert got["rbf"] == pytest.approx({1: 1.0, 2: np.exp(-0.5), 3: 1.0})
    assert got["laplacian"] == pytest.approx({1: 1.0, 2: np.exp(-1), 3: 1.0})


def test_equal_weights_stay_and_no_match_gives_no_edges(spark):
    rows = spark.createDataFrame([(0, 1, 1, 2, 0.4), (0, 1, 2, 1, 0.4)], "frame_a int, frame_b int, src long, dst long, weight double")
    assert {r["weight"] for r in matching.normalised_weights(rows).collect()} == {0.4}
    assert matching.normalised_weights(rows.where("false")).count() == 0
    spread = rows.withColumn("weight", F.col("src") * 1.0)
    assert sorted(r["weight"] for r in matching.normalised_weights(spread).collect()) == [0.0, 1.0]


def test_types_within_a_size(spark):
    got = [r[0] for r in spark.range(29).orderBy("id").select(graphlets.type_within_size(F.col("id"))).collect()]
    assert got == [0, 1, *range(6), *range(21)]


def test_types_of_grown_and_of_given_sets_agree(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 14, (26, 2)).tolist() if p[0] != p[1]}
    e = edges(spark, pairs)
    grown = graphlets.typed_connected_sets(e).cache()
    got = {tuple(r["nodes"]): r["gtype"] for r in grown.collect()}
    assert grown.count() == len(got)
    assert got == {tuple(r["nodes"]): r["gtype"] for r in graphlets.typed_sets(grown.select("frame_id", "nodes"), e).collect()}
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(14)}
    assert set(got) == {c for k in (3, 4, 5) for c in itertools.combinations(range(14), k) if graphlets._joined(frozenset(c), near)}


def test_halves_of_an_odd_cluster(spark):
    rows = fr.split_cluster(frame(spark, [(0.0,)] * 9, ["a"] * 7 + ["b"] * 2), "a", 1.0, "s").collect()
    moved = [r["features"][0] for r in rows if r["label"] == "a"]
    assert (moved.count(-1.0), moved.count(1.0)) == (3, 4)
    assert [r["features"] for r in rows if r["label"] == "b"] == [[0.0]] * 2


def test_lsh_graph_finds_most_neighbours(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(40, 3)) * 0.1 + c for c in ((0, 0, 0), (3, 0, 0), (0, 3, 0))])
    pairs = lambda rows: {(r["src"], r["dst"]) for r in rows.collect()}
    exact, found = pairs(knn.knn_graph(frame(spark, points), 3)), pairs(knn.knn_graph_lsh(frame(spark, points), 3))
    assert len(exact & found) >= 0.9 * len(exact)


def test_coherence_error(spark):
    from weftline.operators import quality

    at = lambda f, ys: spark.createDataFrame([(f, i, float(a), float(b)) for i, (a, b) in enumerate(ys)], "frame_id int, item_id long, y0 double, y1 double")
    matches = spark.createDataFrame([(0, 1, 0, 1, 1.0), (0, 1, 1, 2, 3.0)], "frame_a int, frame_b int, src long, dst long, weight double")
    got = quality.coherence_error(matches, at(0, [(0, 0), (1, 0), (1, 1)]), at(1, [(0, 0), (1, 0), (1, 3)])).first()
    assert (got["frame_a"], got["frame_b"], got["error"]) == (0, 1, pytest.approx((1 * 0 + 3 * 2) / 4))


@pytest.mark.parametrize("density", [0.15, 0.4, 0.8, 1.0])
def test_counts_without_listing_are_those_of_the_sets(spark, density):
    rng = np.random.default_rng(int(density * 100))
    pairs = [p for p in itertools.combinations(range(11), 2) if rng.random() < density]
    e = edges(spark, pairs).union(edges(spark, [(5, 900), (900, 7)], 3))
    rows = lambda c: sorted(map(tuple, c.collect()))
    listed = graphlets.typed_connected_sets(e).cache()
    counts = graphlets.exact_counts(e)
    assert rows(counts) == rows(graphlets.item_counts(listed))
    assert rows(graphlets.type_totals(counts)) == rows(graphlets.type_counts(listed))


def test_a_hub_is_counted_exactly(spark):
    """A star of 2000 leaves, for which listing or its estimate gave up: 2000 choose 4 sets of five."""
    got = {(r["item_id"], r["gtype"]): r["cnt"] for r in graphlets.exact_counts(edges(spark, [(0, i) for i in range(1, 2001)])).collect()}
    assert [got[0, t] for t in (0, 3, 10)] == [math.comb(2000, k) for k in (2, 3, 4)]
    assert [got[7, t] for t in (0, 3, 10)] == [math.comb(1999, k) for k in (1, 2, 3)]
    assert {t for _, t in got} == {0, 3, 10}


def test_counting_holds_few_numbers_for_each_path_of_two_links():
    """One executor may count two frames at a time: products over the same cells share these, and none is sorted whole.

    Bytes a path: 250 before, 105 since."""
    rng = np.random.default_rng(5)
    n = 20_000
    links = np.unique(np.sort(np.concatenate([np.stack([np.arange(n), (np.arange(n) + k) % n], 1) for k in (1, 2)] + [rng.integers(0, n, (n, 2))]), axis=1), axis=0)
    u, v = links[links[:, 0] != links[:, 1]].T
    paths = int((np.bincount(np.concatenate([u, v])) ** 2).sum())
    tracemalloc.start()
    try:
        profiles.item_counts(n, u, v, graphlets._shape, graphlets._joined)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 160 * paths


def test_ids_beyond_narrow_numbers_are_counted(spark):
    """Items are many enough for products of two narrow numbers to overflow."""
    n = 70_000
    pairs = [(i, i + 1) for i in range(0, n, 2)] + [(n - 4 + i, n - 4 + j) for i, j in itertools.combinations(range(4), 2) if (i, j) not in ((0, 1), (2, 3))]
    got = {(r["item_id"], r["gtype"]): r["cnt"] for r in graphlets.exact_counts(edges(spark, pairs)).collect()}
    assert got == {(n - 4 + i, t): c for i in range(4) for t, c in ((1, 3), (7, 1))}


def test_steps_of_a_walk_are_its_moves():
    rng = np.random.default_rng(0)
    for _ in range(200):
        near = {i: set() for i in range(9)}
        for a, b in itertools.combinations(range(9), 2):
            if rng.random() < 0.35:
                near[a].add(b)
                near[b].add(a)
        nodes = frozenset(rng.choice(9, int(rng.integers(3, 6)), replace=False).tolist())
        if graphlets._joined(nodes, near):
            steps = graphlets._Steps(nodes, near)
            assert [steps[i] for i in range(len(steps))] == graphlets._moves(nodes, near)


def test_walks_share_the_length_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(graphlets, "WALK", 10)
    ring = [(i, (i + 1) % 40) for i in range(40)]
    got = graphlets.sampled_counts(edges(spark, ring), 50, 3).collect()
    sizes = {0: 3, 2: 4, 8: 5}
    assert {r["gtype"] for r in got} == set(sizes) and len({(r["item_id"], r["gtype"]) for r in got}) == len(got)
    assert sum(r["cnt"] / sizes[r["gtype"]] for r in got) == pytest.approx(40 * 50)


def test_lanes_count_and_draw_the_moves():
    rng = np.random.default_rng(1)
    linked = {tuple(sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(90)} | {(0, k) for k in range(1, 30)}
    u, v = np.array(sorted(linked)).T
    near = {i: set() for i in range(40)}
    for a, b in linked:
        near[a].add(b)
        near[b].add(a)
    starts = [graphlets._first(k % 40, lambda n: sorted(near[n])) for k in range(60)]
    lanes = walks.Lanes(40, u, v, [s for s in starts if len(s) == 4], graphlets._shape)
    sets = lambda nodes: [frozenset(int(x) for x in r if x >= 0) for r in nodes]
    for _ in range(25):
        before = sets(lanes.nodes)
        assert lanes.moves.tolist() == [len(graphlets._moves(s, near)) for s in before]
        assert lanes.kinds[lanes.code(lanes.links), lanes.used].tolist() == [graphlets._shape(s, near) for s in before]
        nodes, used, links, away = lanes.draw(len(before), rng)
        assert all(new in graphlets._moves(s, near) if gone else new == s for s, new, gone in zip(before, sets(nodes), away, strict=True))
        lanes.nodes, lanes.used, lanes.links = nodes, used, links
        lanes.moves = lanes.count(nodes, used, links)
    one = walks.Lanes(40, u, v, [starts[5]] * 20000, graphlets._shape)
    moves = collections.Counter(graphlets._moves(frozenset(starts[5]), near))
    got = collections.Counter(sets(one.draw(20000, rng)[0]))
    each = 20000 / sum(moves.values())
    assert got.keys() == moves.keys() and sum((got[s] - each * k) ** 2 / each / k for s, k in moves.items()) < 1.5 * len(moves)


def test_many_short_walks_cost_little(spark):
    """Sets around a hub were counted one by one, at about 0.1 ms a step."""
    rng = np.random.default_rng(2)
    hub = [(0, k) for k in range(1, 600)] + [(k, int(rng.integers(1, k))) for k in range(2, 600)] + [(1000 + 4 * k + a, 1000 + 4 * k + b) for k in range(50) for a, b in ((0, 1), (1, 2), (2, 3))]
    began = time.monotonic()
    got = graphlets.sampled_counts(edges(spark, hub), 3000, 3).collect()
    assert time.monotonic() - began < 45
    sizes = {k: 3 if k < 2 else 4 if k < 8 else 5 for k in range(29)}
    assert sum(r["cnt"] / sizes[r["gtype"]] for r in got) == pytest.approx(800 * 3000)
    assert sum(r["cnt"] / sizes[r["gtype"]] for r in got if r["item_id"] >= 1000) == pytest.approx(200 * 3000)
