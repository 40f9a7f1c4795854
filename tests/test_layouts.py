import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.config import Config, load
from weftline.operators import affinity, descent, tiles
from weftline.operators import frames as fr
from weftline.plans import catalog, pipeline
from weftline.sources import text as files

ROUNDED_PAIRS = ["pairwise_sqdist", "conditional_p", "joint_p", "student_q"]
RNG = np.random.default_rng(11)
POINTS = np.concatenate([RNG.normal(size=(8, 3)), RNG.normal(size=(8, 3)) + 4])


def frame(spark, points, frame_id=0):
    return spark.createDataFrame([(frame_id, i, list(map(float, p)), str(i * 2 // len(points))) for i, p in enumerate(points)], "frame_id int, item_id long, features array<double>, label string")


def layout(y, spark, frame_id=0):
    return spark.createDataFrame([(frame_id, i, float(a), float(b)) for i, (a, b) in enumerate(y)], descent.LAYOUT)


def kl(p, y):
    num = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(num, 0)
    q = num / num.sum()
    off = ~np.eye(len(y), dtype=bool)
    return (p[off] * np.log(p[off] / q[off])).sum()


def gradient(f, y, h=1e-6):
    g = np.zeros_like(y)
    for at in np.ndindex(*y.shape):
        for sign in (1, -1):
            z = y.copy()
            z[at] += sign * h
            g[at] += sign * f(z) / (2 * h)
    return g


def test_perplexity_is_met_and_both_calibrations_agree(spark):
    d2 = affinity.squared_distances(frame(spark, POINTS)).cache()
    betas = {r["i"]: r["beta"] for r in affinity.calibrated(d2, 5.0).collect()}
    folds = {r["i"]: r["beta"] for r in affinity.calibrated_by_folds(d2, 5.0).collect()}
    assert folds == pytest.approx(betas, rel=1e-9)
    for i, b in betas.items():
        row = ((POINTS[i] - np.delete(POINTS, i, 0)) ** 2).sum(1)
        p = np.exp(-row * b)
        p /= p.sum()
        assert np.exp(-(p * np.log(p)).sum()) == pytest.approx(5.0, rel=1e-4)


def test_far_outlier_does_not_underflow():
    beta, tries = affinity.beta_of(np.array([1e8, 2e8, 3e8]), 2.0)
    assert np.isfinite(beta)
    assert tries <= affinity.TRIES


def test_joint_affinities_sum_to_one(spark):
    d2 = affinity.squared_distances(frame(spark, POINTS))
    rows = affinity.joint(affinity.conditional(d2, affinity.calibrated(d2, 4.0))).collect()
    assert sum(r["p"] for r in rows) == pytest.approx(1.0)
    dense = descent.affinities(POINTS, 4.0)
    assert max(abs(r["p"] - dense[r["i"], r["j"]]) for r in rows) < 1e-9


def test_forces_are_fixed_shares_of_the_gradients(spark):
    p, y, was = descent.affinities(POINTS, 4.0), RNG.normal(size=(16, 2)), RNG.normal(size=(16, 2))
    ids = [(0, i, j, float(p[i, j])) for i in range(16) for j in range(16) if i != j]
    table = spark.createDataFrame(ids, "frame_id int, i long, j long, p double")
    now = layout(y, spark)
    force = {r["item_id"]: (r["f0"], r["f1"]) for r in descent.kl_force(table, affinity.student(now), now).collect()}
    got = np.array([force[i] for i in range(16)])
    assert gradient(lambda z: kl(p, z), y) == pytest.approx(4 * got, abs=1e-6)
    src, dst, w = np.arange(15), np.arange(1, 16), RNG.random(15)
    c1 = lambda z: (w[:, None] * ((was[src] - was[dst]) - (z[src] - z[dst])) ** 2).sum() / 15
    links = spark.createDataFrame([(0, int(a), int(b), float(x)) for a, b, x in zip(src, dst, w, strict=True)], "frame_id int, src long, dst long, weight double")
    force = {r["item_id"]: (r["f0"], r["f1"]) for r in descent.edge_force(links, layout(was, spark), now, 0.3).collect()}
    got = np.array([force[i] for i in range(16)])
    assert 0.3 * gradient(c1, y) == pytest.approx(2 * got, abs=1e-6)
    assert descent.edge_push((src, dst, w), was, y, 0.3) == pytest.approx(got, abs=1e-12)
    assert descent.edge_cost(links, layout(was, spark), now).first()["c1"] == pytest.approx(c1(y))


def test_first_step_of_the_kernel_and_of_the_tables_agree(spark):
    y = RNG.normal(size=(16, 2))
    p = descent.affinities(POINTS, 4.0)
    table = spark.createDataFrame([(0, i, j, max(float(p[i, j]) * 4, 1e-12)) for i in range(16) for j in range(16) if i != j], "frame_id int, i long, j long, p double")
    now = layout(y, spark)
    step = {r["item_id"]: (r["y0"], r["y1"]) for r in descent.first_step(now, descent.kl_force(table, affinity.student(now), now)).collect()}
    assert descent.descend(p, y, 1) == pytest.approx(np.array([step[i] for i in range(16)]), abs=1e-9)


def test_blocks_and_one_task_descend_alike(spark):
    f, start = frame(spark, POINTS), descent.initial(frame(spark, POINTS))
    whole = {r["item_id"]: (r["y0"], r["y1"]) for r in descent.tsne(f, start, 4.0, 3).collect()}
    cut = {r["item_id"]: (r["y0"], r["y1"]) for r in descent.descend_blocks(f.join(start, ["frame_id", "item_id"]), 4.0, 3, block=5).collect()}
    for i, at in whole.items():
        assert cut[i] == pytest.approx(at, abs=1e-6)


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_one_stage_takes_all_steps(spark, monkeypatch, far):
    """Tasks that hold their affinities descend as one task does, with shares below the floor too, and no step is a job."""
    y = np.random.default_rng(4).normal(size=(len(POINTS), 2)) + np.repeat([[0.0], [far]], [len(POINTS) - 4, 4], 0)
    rows = frame(spark, POINTS).join(layout(y, spark), ["frame_id", "item_id"])
    monkeypatch.setattr(descent, "nearness", None)  # the steps that are jobs
    monkeypatch.setattr(descent, "BOOSTED", 2)
    got = descent.descend_blocks(rows, 4.0, 4, block=5).orderBy("item_id").toPandas()[["y0", "y1"]].to_numpy()
    p, now = np.maximum(descent.affinities(POINTS, 4.0) * affinity.EXAGGERATION, affinity.FLOOR), descent.Motion(y)
    for t in range(4):
        num = 1 / (1 + ((now.y[:, None] - now.y) ** 2).sum(2))
        np.fill_diagonal(num, 0)
        w = (p / (1 if t < descent.BOOSTED else affinity.EXAGGERATION) - np.maximum(num / num.sum(), affinity.FLOOR)) * num
        now.push((w[:, :, None] * (now.y[:, None] - now.y)).sum(1))
    assert got == pytest.approx(now.y, rel=1e-6, abs=1e-6)


def test_steps_of_one_stage_do_not_wait_for_its_exchange(spark):
    """A barrier stage's own exchange took half a second or more, whatever the frame's size."""
    y = np.random.default_rng(4).normal(size=(len(POINTS), 2))
    rows = frame(spark, POINTS).join(layout(y, spark), ["frame_id", "item_id"])
    began = time.monotonic()
    got = descent.descend_blocks(rows, 4.0, 90).orderBy("item_id").toPandas()[["y0", "y1"]].to_numpy()
    assert time.monotonic() - began < 25
    assert got == pytest.approx(descent.descend(descent.affinities(POINTS, 4.0), y, 90), rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("far", [1.0, 1e6])
def test_tiles_stand_for_both_orders_of_their_pairs(far):
    rng = np.random.default_rng(9)
    y, p = rng.normal(size=(30, 2)) * 5 + np.repeat([[0.0], [far]], [20, 10], 0), rng.random((30, 30))
    p = p + p.T
    cuts = [slice(0, 13), slice(13, 26), slice(26, 30)]
    got = descent._pulls([(a, b, p[a, b]) for k, a in enumerate(cuts) for b in cuts[k:]], y)
    off = y[:, None] - y
    num = 1 / (1 + (off**2).sum(2))
    np.fill_diagonal(num, 0)
    assert got[30, 0] == pytest.approx(num.sum(), rel=1e-9)
    for k, w in enumerate((p * num, num**2)):
        assert got[:30, 2 * k : 2 * k + 2] == pytest.approx((w[:, :, None] * off).sum(1), rel=1e-7, abs=1e-7)


def test_a_joint_descent_over_tasks_is_that_of_one(spark):
    f, rng = frame(spark, POINTS), np.random.default_rng(6)
    was = layout(rng.normal(size=(16, 2)), spark).drop("frame_id").cache()
    links = spark.createDataFrame([(i, (3 * i + 1) % 16, 0.25 * (i % 4)) for i in range(16)], "src long, dst long, weight double")
    began = time.monotonic()
    cut = descent.joint_layout(f, descent.initial(f), was, links, 4.0, 0.1, 60, 3).orderBy("item_id").toPandas()
    assert time.monotonic() - began < 25  # no step waits for the stage's exchange
    whole = descent.joint_layout(f, descent.initial(f), was, links, 4.0, 0.1, 60).orderBy("item_id").toPandas()
    assert cut[["y0", "y1"]].to_numpy() == pytest.approx(whole[["y0", "y1"]].to_numpy(), rel=1e-4, abs=1e-4)


def test_kernels_round_as_spark_does(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=2000), rng.integers(-999, 999, 500) / 8, rng.integers(0, 99999, 500) * 10 + 5, np.arange(500) * 1e-3 + 5e-4, rng.normal(size=50) * 1e13, [0.0, -0.0, -1e-9, 2.5e-7, 1e300, 1e-300, np.nan, np.inf, -np.inf]])
    x = np.concatenate([x, x * 1e-6, x * 1e-9])
    for part in (x, x[np.abs(x) < 1e5]):  # with numbers that have no such digits, and without
        for digits in (3, 6, 9, 11):
            want = spark.createDataFrame([(i, float(v)) for i, v in enumerate(part)], "k int, x double").select("k", (F.round("x", digits) + F.lit(0.0)).alias("x")).orderBy("k").toPandas()["x"].to_numpy()
            got = tiles.rounded(part, digits)
            assert ((got == want) | (np.isnan(got) & np.isnan(want))).all()
            assert not np.signbit(got[got == 0]).any()


def test_rounded_distances_are_those_of_differences():
    rng = np.random.default_rng(13)
    for x in (rng.integers(0, 4, (90, 6)) / np.sqrt(8e3), rng.normal(size=(90, 6)) * 1e4, rng.integers(0, 9, (90, 6)) / 2000.0):
        x[5] = x[7]
        assert (affinity.rounded_squares(x[:40], x, 6) == tiles.rounded(affinity.direct(x[:40], x), 6)).all()


def test_rounding_of_pairs_is_not_left_to_spark(spark, data):
    """Spark rounds by way of decimals, which took longer than all else."""
    for name in ROUNDED_PAIRS:
        assert "round(" not in catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_folds_move_no_distances(spark, data):
    rng = np.random.default_rng(14)
    points = frame(spark, np.concatenate([rng.normal(size=(120, 4)), rng.normal(size=(30, 4)) * 1e3, np.zeros((20, 4))]).tolist())
    want = {r["i"]: r["beta"] for r in affinity.folded_rows(affinity.distance_rows(points), 10.0).collect()}
    got = {r["i"]: r["beta"] for r in affinity.betas_by_folds(points, 10.0).collect()}
    assert len(got) == 170 and got == pytest.approx(want, rel=1e-9)
    assert affinity.betas_by_folds(points.limit(1), 10.0).count() == 0
    plan = catalog.QUERIES["perplexity_beta_folds"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # folds of expressions took microseconds a distance


def test_layouts_are_centred_and_edges_hold_them(spark):
    x = np.random.default_rng(2).normal(size=(90, 4)) + np.repeat(np.eye(4)[:3] * 6, 30, 0)
    y = x + np.random.default_rng(3).normal(size=x.shape) * 0.2
    frames = frame(spark, x).union(frame(spark, y, 1))
    config = Config(3, 15.0, 0.1, "two", (0, 1))
    got = pipeline.analyse(spark, frames, config, plain_steps=300, joint_steps=300)
    loose = pipeline.layouts_of(frames, got.weights.where("false"), config, plain_steps=300, joint_steps=300)
    assert got.graphs.count() == 540
    for r in got.layouts.groupBy("frame_id").agg(F.avg("y0").alias("a"), F.avg("y1").alias("b")).collect():
        assert abs(r["a"]) + abs(r["b"]) < 1e-6
    edges = got.weights.select(F.lit(0).alias("frame_id"), "src", "dst", "weight")
    cost = lambda t: descent.edge_cost(edges, t.where("frame_id = 0"), t.where("frame_id = 1").withColumn("frame_id", F.lit(0))).first()["c1"]
    assert cost(got.layouts) < cost(loose)


def test_items_of_one_frame_only_raise(spark):
    frames = frame(spark, POINTS).union(frame(spark, POINTS[:-1], 1))
    with pytest.raises(ValueError, match="only"):
        pipeline.analyse(spark, frames, Config(2, 4.0, 0.1, "x", (0, 1)))


def test_generators(spark):
    f = fr.gaussian_clusters(spark, 20, 2, 3, 5.0, 0.1, "s")
    assert f.count() == 20
    with pytest.raises(ValueError, match="equal sizes"):
        fr.gaussian_clusters(spark, 21, 2, 3, 5.0, 0.1, "s")
    assert fr.keep_split(f, 0.35, "k").where("kept").count() == 7
    assert sorted(r.item_id for r in fr.keep_split(f, 0.35, "k").where("kept").collect()) == sorted(r.item_id for r in fr.keep_split(f.repartition(7), 0.35, "k").where("kept").collect())
    centre = {r["label"]: r["centroid"] for r in fr.centroids(fr.overlap(f, ["0", "1"])).collect()}
    assert centre["0"] == pytest.approx(centre["1"])
    given = fr.gaussian_clusters(spark, 4, 2, 2, 5.0, 0.0, "s", means=[[1, 2], [3, 4]])
    assert sorted(map(tuple, (r["features"] for r in given.collect()))) == [(1.0, 2.0), (1.0, 2.0), (3.0, 4.0), (3.0, 4.0)]


def test_projection(spark):
    f = frame(spark, POINTS)
    assert fr.projected(f, 3) is f
    assert len(fr.projected(f, 2).first()["features"]) == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in (3, 10):
        (tmp_path / "in" / f"f_{i}.txt").write_text("".join(f"{i} {j}.5\t-1e-3  c{j}\n" for j in range(30)))
    f = files.read_frames(spark, str(tmp_path / "in"))
    assert sorted((r.frame_id, r.item_id, r.features[1], r.label) for r in f.collect()) == [(i, j, j + 0.5, f"c{j}") for i in (3, 10) for j in range(30)]
    assert files.read_frames(spark, str(tmp_path / "in"), [10]).select("frame_id").distinct().count() == 1
    placed = f.select("frame_id", "item_id", F.col("features")[1].alias("y0"), (F.col("item_id") / 7).alias("y1"), "label")
    files.write_layouts(placed, str(tmp_path / "out"))
    back = files.read_layouts(spark, str(tmp_path / "out"))
    assert sorted((r.frame_id, r.item_id, r.y0, r.label) for r in back.collect()) == sorted((r.frame_id, r.item_id, r.y0, r.label) for r in placed.collect())
    sims = spark.createDataFrame([(0, 1, 5, 0.25), (0, 1, 6, 1.0)], "frame_a int, frame_b int, item_id long, sim double")
    files.write_similarities(sims, str(tmp_path / "sims"))
    assert sorted(tuple(r) for r in files.read_similarities(spark, str(tmp_path / "sims")).select("item_id", "sim").collect()) == [(5, 0.25), (6, 1.0)]


def test_graph_files(spark, tmp_path):
    links = spark.createDataFrame([(2, 0, 1, 1, 0.5), (2, 0, 2, 2, 0.75), (2, 1, 0, 1, 0.5)], "frame_id int, src long, dst long, rank int, dist double")
    files.write_graph(links, frame(spark, POINTS[:3], 2), str(tmp_path / "g"))
    assert sorted(map(tuple, files.read_graph(spark, str(tmp_path / "g")).collect())) == sorted(map(tuple, links.collect()))
    with pytest.raises(Exception, match="wrong number of tokens"):
        files.read_graph(spark, str(tmp_path / "g"), 2).collect()


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"algo": {"perplexity": 5, "k_closest_count": 3, "bfs_level": 1, "gamma": 0.1}, "thesne": {"data_name": "d", "pts_size": 20, "norm": true, "data_ids": [1, 3, 6], "data_dims": [4, 4, 4], "data_titles": []}}')
    c = load(str(tmp_path / "c.json"))
    assert (c.k, c.pairs()) == (3, [(1, 3), (3, 6)])
    with pytest.raises(ValueError, match="perplexity"):
        Config(3, 30.0, 0.1, "d", (0,), n_items=20)
    (tmp_path / "c.json").write_text('{"algo": {}, "thesne": {}}')
    with pytest.raises(KeyError):
        load(str(tmp_path / "c.json"))


def test_frames_that_arrive(spark, tmp_path):
    from weftline.streaming.arrivals import graphs_as_frames_arrive

    for i in (0, 1):
        frame(spark, POINTS, i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        graphs_as_frames_arrive(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["frame_id"], r["count"]) for r in got.groupBy("frame_id").count().collect()} == {(0, 32), (1, 32)}


def test_command(spark, tmp_path):
    from weftline.__main__ import main

    rng = np.random.default_rng(6)
    (tmp_path / "in").mkdir()
    x = rng.normal(size=(40, 3))
    for i in (1, 4):
        (tmp_path / "in" / f"f_{i}.txt").write_text("".join(f"{a!r} {b!r} {c!r} {j % 2}\n" for j, (a, b, c) in enumerate((x + 0.1 * i * rng.normal(size=x.shape)).tolist())))
    settings = '{"algo": {"perplexity": 8, "k_closest_count": 3, "bfs_level": 1, "gamma": 0.01}, "thesne": {"data_name": "d", "pts_size": 40, "norm": true, "data_ids": [4, 1], "data_dims": [3, 3]}}'
    (tmp_path / "c.json").write_text(settings)
    main([str(tmp_path / "c.json"), str(tmp_path / "in"), str(tmp_path / "out"), "--plain-steps", "30", "--joint-steps", "30"])
    assert files.read_graph(spark, str(tmp_path / "out" / "graphs"), 3).count() == 240
    assert files.read_similarities(spark, str(tmp_path / "out" / "similarities")).count() == 40
    assert {(r["frame_id"], r["count"]) for r in files.read_layouts(spark, str(tmp_path / "out" / "layouts")).groupBy("frame_id").count().collect()} == {(4, 40), (1, 40)}
    (tmp_path / "c.json").write_text(settings.replace("[3, 3]", "[3, 4]"))
    with pytest.raises(ValueError, match="numbers"):
        main([str(tmp_path / "c.json"), str(tmp_path / "in"), str(tmp_path / "out")])


def test_first_dimensions(spark):
    from weftline import config
    from weftline.operators import frames

    rows = spark.createDataFrame([(0, 1, [1.0, 2.0, 3.0], "a"), (1, 1, [4.0, 5.0], "a")], "frame_id int, item_id long, features array<double>, label string")
    settings = config.Config(1, 1.0, 0.0, "d", (0, 1), dims=(2, 2))
    config.check(rows, settings)  # wider files are cut, not refused
    got = {r["frame_id"]: r["features"] for r in frames.first_dimensions(rows, dict(zip(settings.frame_ids, settings.dims))).collect()}
    assert got == {0: [1.0, 2.0], 1: [4.0, 5.0]}
    assert {tuple(r["features"]) for r in frames.first_dimensions(rows, {0: 1}).collect()} == {(1.0,), (4.0, 5.0)}
    assert {tuple(r["features"]) for r in frames.first_dimensions(rows, 1).collect()} == {(1.0,), (4.0,)}


def test_block_kernels_equal_tables(spark):
    points = frame(spark, POINTS)
    d2 = affinity.squared_distances(points).cache()
    betas, fit = affinity.calibrated(d2, 4.0).cache(), affinity.fitted(points, 4.0).cache()
    close = lambda a, b: [x for x in a if abs(a[x] - b[x]) > 1e-9] == [] and a.keys() == b.keys()
    pairs = lambda rows, c: {(r["i"], r["j"]): r[c] for r in rows.collect()}
    assert close({r["i"]: r["beta"] for r in betas.collect()}, {r["item_id"]: r["beta"] for r in fit.collect()})
    cond = affinity.conditional(d2, betas)
    assert close(pairs(cond, "p"), pairs(affinity.conditional_shares(fit), "p"))
    assert close(pairs(affinity.joint(cond), "p"), pairs(affinity.joint_shares(fit), "p"))
    start = descent.initial(points).cache()
    table, q = affinity.joint(cond, 4.0), affinity.student(start)
    forces = lambda rows: {(r["item_id"], k): r[k] for r in rows.collect() for k in ("f0", "f1")}
    assert close(forces(descent.kl_force(table, q, start)), forces(descent.kl_forces(fit, start, 4.0)))
    assert descent.kl_costs(fit, start).first()["kl"] == pytest.approx(descent.kl_cost(affinity.joint(cond), q).first()["kl"])


def test_too_large_a_frame_is_refused(spark, monkeypatch):
    monkeypatch.setattr(descent, "MOST_BYTES", 100)
    points = frame(spark, POINTS)
    with pytest.raises(ValueError, match="beyond"):
        descent.tsne(points, descent.initial(points), 4.0, 2, most=3)


def test_frames_and_info_are_written(spark, tmp_path):
    import json

    points = frame(spark, POINTS).union(frame(spark, POINTS[::-1], 3))
    files.write_frames(points, str(tmp_path / "frames"))
    back = {(r["frame_id"], r["item_id"]): (r["features"], r["label"]) for r in files.read_written_frames(spark, str(tmp_path / "frames")).collect()}
    assert back == {(r["frame_id"], r["item_id"]): (pytest.approx(r["features"], abs=1e-15), r["label"]) for r in points.collect()}
    files.write_info({"a": [1, 2]}, str(tmp_path / "info.json"))
    assert json.loads((tmp_path / "info.json").read_text()) == {"a": [1, 2]}


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * (4, 2, 1, 0.1)
    got = {r["item_id"]: r["features"] for r in fr.projected(frame(spark, x), 2).collect()}
    centred = x - x.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    want = x @ axes[:, ::-1][:, :2]
    y = np.array([got[i] for i in range(60)])
    for k in range(2):  # up to the sign
        assert min(np.abs(y[:, k] - want[:, k]).max(), np.abs(y[:, k] + want[:, k]).max()) < 1e-8


def test_rows_of_distances_serve_both_calibrations_and_no_pair_is_shuffled(spark):
    rng = np.random.default_rng(8)
    points = frame(spark, rng.normal(size=(150, 4)).tolist())
    pairs, rows = affinity.squared_distances(points).cache(), affinity.distance_rows(points).cache()
    assert (rows.count(), {len(r["d"]) for r in rows.collect()}) == (150, {149})
    betas = lambda got: [pytest.approx(b, rel=1e-9) for _, b in sorted((r["i"], r["beta"]) for r in got.collect())]
    want = [r["beta"] for r in affinity.calibrated(pairs, 10.0).orderBy("i").collect()]
    assert betas(affinity.calibrated_rows(rows, 10.0)) == want
    assert betas(affinity.folded_rows(rows, 10.0)) == want
    assert betas(affinity.calibrated_by_folds(pairs, 10.0)) == want
    for got in (affinity.squared_distances(points), affinity.fitted(points, 10.0)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "FlatMapGroupsInArrow" not in plan
