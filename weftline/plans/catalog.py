"""One query for each operator over the table ``embeddings``, and the same in SQL.

Frame 0 is the table; frame 1 contracts labels 0 to 2 about their centroids and shifts label 3."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import affinity, descent, frames as fr, graph, graphlets, knn, matching, quality
from ..sources import text as files
from .storage import keep_path, shared_dir, write_table

K, PERPLEXITY, GAMMA, LEVELS = 3, 30.0, 0.1, 2
MOVED, FACTOR, SHIFTED, SHIFT = ["0", "1", "2"], 0.3, ["3"], 0.1


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def frame0(spark: SparkSession, d: str) -> DataFrame:
    return fr.from_vectors(spark.read.parquet(f"{d}/embeddings.parquet").repartition(max(1, spark.sparkContext.defaultParallelism)))


def both(spark: SparkSession, d: str) -> DataFrame:
    first = frame0(spark, d)
    second = fr.as_frame(fr.translate(fr.scale_cluster(first, MOVED, FACTOR), SHIFTED, SHIFT, True, ""), 1)
    return first.union(second)


def cells(frames: DataFrame) -> DataFrame:
    return frames.select("item_id", F.posexplode("features").alias("pos", "x")).select("item_id", "pos", r("x").alias("x"))


def pair(spark: SparkSession) -> DataFrame:
    return matching.consecutive(spark, [0, 1])


def links(spark: SparkSession, d: str) -> DataFrame:
    return write_table(knn.knn_graph(both(spark, d), K), "knn")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return write_table(graph.undirected(links(spark, d)), "edges")


def sets_near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sets of an item and its two nearest and the item of the next id, and the edges."""
    near = links(spark, d)
    sets = near.where("rank <= 2").groupBy("frame_id", "src").agg(F.concat(F.array("src"), F.array_sort(F.collect_list("dst")), F.array(F.col("src") + 1)).alias("nodes"))
    return sets.select((F.col("src") * 2 + F.col("frame_id")).alias("set_id"), "frame_id", "nodes"), graph.undirected(near)


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    frames, near = both(spark, d), links(spark, d)
    e = write_table(graph.undirected(near), "edges")
    features = graphlets.layered(graphlets.exact_counts(e), graph.bfs_layers(e, frames.select("frame_id", "item_id"), LEVELS))
    return frames, near, write_table(features, "features")


def similarity(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        frames, _, features = _features(spark, d)
        return matching.point_similarity(pair(spark), features, frames, kind).select("item_id", r("sim").alias("sim"))

    return query


def _discounted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    frames, near, features = _features(spark, d)
    p, l = pair(spark), graph.directed(near, K)
    return l, matching.discounted(matching.point_similarity(p, features, frames), matching.neighbor_ratio(p, l, frames, K))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    l, sims = _discounted(spark, d)
    return write_table(matching.match_edges(pair(spark), l, sims), "weights")


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return affinity.squared_distances(frame0(spark, d), 6)


def _fit(spark: SparkSession, d: str) -> DataFrame:
    return write_table(affinity.fitted(frame0(spark, d), PERPLEXITY), "fit")


def _start(spark: SparkSession, d: str, seed: str = "layout") -> DataFrame:
    return descent.initial(frame0(spark, d), seed)


def _force(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    start = write_table(_start(spark, d), "start")
    return start, descent.kl_forces(_fit(spark, d), start, affinity.EXAGGERATION)


def _unit_edges(spark: SparkSession, d: str) -> DataFrame:
    """Common edges of both frames as edges of frame 0, weighted by the rank of their ends."""
    common = matching.common_edges(pair(spark), graph.directed(links(spark, d)))
    return common.select(F.lit(0).alias("frame_id"), "src", "dst", ((F.col("src") % 5 + F.col("dst") % 3) / 6.0).alias("weight"))


def _pairs_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = frame0(spark, d).select("item_id", F.col("features").alias("a"))
    return rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")


def kernels(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs_of_vectors(spark, d).select(
        "item_id", r(vec.kernel("cosine", a, b)).alias("cosine"), r(vec.kernel("rbf", a, b)).alias("rbf"), r(vec.kernel("laplacian", a, b)).alias("laplacian"), r(vec.l1_distance(a, b)).alias("l1"), r(vec.squared_l2(a, b)).alias("l2")
    )


def argsorted(spark: SparkSession, d: str) -> DataFrame:
    rows = frame0(spark, d).select("item_id", F.posexplode(vec.argsort(F.col("features"))).alias("rank", "pos"))
    return rows.select("item_id", "rank", F.col("pos").cast("int").alias("pos"))


def l1_shares(spark: SparkSession, d: str) -> DataFrame:
    magnitudes = F.transform("features", lambda x: F.abs(x))
    return cells(fr.with_features(frame0(spark, d), vec.l1_normalised(magnitudes)))


def knn_query(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn_graph(both(spark, d), K).select("frame_id", "src", "dst", "rank", r("dist").alias("dist"))


def has_edge(spark: SparkSession, d: str) -> DataFrame:
    near = links(spark, d)
    probes = near.where("frame_id = 0").select(F.lit(1).alias("frame_id"), F.col("dst").alias("a"), F.col("src").alias("b"))
    return graph.has_edges(probes.distinct(), graph.undirected(near)).select("a", "b", "linked")


def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.undirected(links(spark, d).where("rank = 1")))


def graphlet_counts(spark: SparkSession, d: str) -> DataFrame:
    return graphlets.exact_counts(edges(spark, d))


def dense_profile(spark: SparkSession, d: str) -> DataFrame:
    _, _, features = _features(spark, d)
    return graphlets.dense(features, LEVELS).select("frame_id", "item_id", F.posexplode("vector").alias("pos", "x")).where("x > 0").select("frame_id", "item_id", "pos", r("x").alias("x"))


def complement(spark: SparkSession, d: str) -> DataFrame:
    frame = frame0(spark, d)
    return fr.without(frame, fr.with_label(frame, ["1", "4"])).select("item_id", "label")


def subsets(spark: SparkSession, d: str) -> DataFrame:
    return cells(fr.disturb_subsets(frame0(spark, d), ["1", "2"], 0.9, 0.5, False, "subset"))


def noise(spark: SparkSession, d: str) -> DataFrame:
    frame = frame0(spark, d)
    return cells(fr.add_noise(frame, frame.where(F.col("item_id") % 3 == 0), 0.2, "noise"))


def tsne_layout(spark: SparkSession, d: str) -> DataFrame:
    frames = both(spark, d)
    return descent.tsne(frames, descent.initial(frames, "layout"), PERPLEXITY)


def joint_layouts(spark: SparkSession, d: str) -> DataFrame:
    from ..config import Config
    from .pipeline import analyse

    got = analyse(spark, both(spark, d), Config(K, PERPLEXITY, GAMMA, "two frames", (0, 1)))
    return got.layouts


def sampled(spark: SparkSession, d: str) -> DataFrame:
    return graphlets.sampled_counts(edges(spark, d), seed=1)


def _folder(spark: SparkSession, tag: str) -> str:
    return keep_path(spark, f"{shared_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}")


def graph_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "graph-text")
    files.write_graph(links(spark, d), both(spark, d), path)
    return files.read_graph(spark, path, K).select("frame_id", "src", "dst", "rank", r("dist").alias("dist"))


def frame_files(spark: SparkSession, d: str) -> DataFrame:
    """Written by frame and read again; a line's number is its item, as ids in the table have no gaps."""
    path = _folder(spark, "frame-text")
    files.write_frames(both(spark, d), path)
    back = files.read_written_frames(spark, path)
    return back.select("frame_id", "item_id", "label", F.posexplode("features").alias("pos", "x")).select("frame_id", "item_id", "label", "pos", r("x").alias("x"))


def similarity_files(spark: SparkSession, d: str) -> DataFrame:
    frames, _, features = _features(spark, d)
    path = _folder(spark, "similarity-text")
    files.write_similarities(matching.point_similarity(pair(spark), features, frames, "cosine"), path)
    return files.read_similarities(spark, path).select("frame_a", "frame_b", "item_id", r("sim").alias("sim"))


def layout_files(spark: SparkSession, d: str) -> DataFrame:
    frame = frame0(spark, d)
    path = _folder(spark, "layout-text")
    files.write_layouts(descent.initial(frame, "layout").join(frame.select("item_id", "label"), "item_id"), path)
    return files.read_layouts(spark, path).select("frame_id", "item_id", "label", r("y0").alias("y0"), r("y1").alias("y1"))


def within_size(spark: SparkSession, d: str) -> DataFrame:
    totals = graphlets.type_totals(graphlet_counts(spark, d))
    size = F.when(F.col("gtype") < 2, 3).when(F.col("gtype") < 8, 4).otherwise(5).cast("long")
    return totals.select("frame_id", size.alias("size"), graphlets.type_within_size(F.col("gtype")).alias("gtype"), "n")


def pca_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """The variance along all principal components together, which is that of the frame."""
    along = fr.projected(frame0(spark, d), 64, turn=True).select(F.posexplode("features").alias("pos", "x"))
    return along.groupBy("pos").agg(F.var_samp("x").alias("v")).agg(r(F.sum("v")).alias("variance"))


def preserved(spark: SparkSession, d: str) -> DataFrame:
    near = links(spark, d).where("frame_id = 0")
    return quality.neighborhood_preservation(near, _start(spark, d), K).select("frame_id", r("preserved").alias("preserved"))


def pca_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of neighbours after a projection to 8 dimensions; all dimensions would change none."""
    flat = fr.projected(frame0(spark, d), 8).select("item_id", "features")
    a, b = flat.select(F.col("item_id").alias("src"), F.col("features").alias("a")), flat.select(F.col("item_id").alias("dst"), F.col("features").alias("b"))
    near = links(spark, d).where("frame_id = 0").select("src", "dst")
    return near.join(a, "src").join(b, "dst").select("src", "dst", r(vec.squared_l2(F.col("a"), F.col("b"))).alias("d2"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "frame_minmax": lambda s, d: cells(fr.minmax_scaled(frame0(s, d))),
    "cluster_centroids": lambda s, d: fr.centroids(frame0(s, d)).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", r("x").alias("x")),
    "label_complement": complement,
    "gaussian_clusters": lambda s, d: fr.gaussian_clusters(s, 300, 5, 6, 10.0, 0.5, "g").select("item_id", "label", F.posexplode("features").alias("pos", "x")).select("item_id", "label", "pos", r("x").alias("x")),
    "keep_split": lambda s, d: fr.keep_split(frame0(s, d), 0.7, "keep").select("item_id", "kept"),
    "disturb_points": lambda s, d: cells(fr.disturb(frame0(s, d), 0.3, False, "jitter")),
    "disturb_cluster": lambda s, d: cells(fr.disturb_label(frame0(s, d), "2", 0.3, False, "jitter")),
    "translate_clusters": lambda s, d: cells(fr.translate(frame0(s, d), ["0", "5"], 0.4, False, "move")),
    "disturb_label_subsets": subsets,
    "shift_all": lambda s, d: cells(fr.shift_all(frame0(s, d), 0.25, True, "shift")),
    "add_noise": noise,
    "overlap_clusters": lambda s, d: cells(fr.overlap(frame0(s, d), ["0", "1", "2"])),
    "scale_cluster": lambda s, d: cells(fr.scale_cluster(frame0(s, d), ["4"], 0.25, [0.5] * 64)),
    "split_cluster": lambda s, d: cells(fr.split_cluster(frame0(s, d), "6", 0.3, "split")),
    "kernels": kernels,
    "argsort": argsorted,
    "l1_normalised": l1_shares,
    "knn_graph": knn_query,
    "graph_text_roundtrip": graph_file,
    "frames_text_roundtrip": frame_files,
    "similarities_text_roundtrip": similarity_files,
    "layouts_text_roundtrip": layout_files,
    "first_dimensions": lambda s, d: cells(fr.first_dimensions(frame0(s, d), 10)),
    "pca_spectrum": pca_spectrum,
    "graphlet_types_within_size": within_size,
    "undirected_edges": lambda s, d: edges(s, d).select("frame_id", "u", "v"),
    "degrees": lambda s, d: graph.degrees(edges(s, d)),
    "edge_num_1": lambda s, d: graph.edge_count(edges(s, d), 1),
    "edge_num_2": lambda s, d: graph.edge_count(edges(s, d), 2),
    "has_edge": has_edge,
    "induced_edges": lambda s, d: graph.induced(*sets_near(s, d)),
    "connected_sets": lambda s, d: graph.connected(*sets_near(s, d)).select("set_id", "is_connected"),
    "connected_components": components,
    "component_sizes": lambda s, d: graph.component_sizes(components(s, d)),
    "bfs_layers": lambda s, d: graph.bfs_layers(edges(s, d), both(s, d).select("frame_id", "item_id"), 3),
    "graphlet_type_counts": lambda s, d: graphlets.type_totals(graphlet_counts(s, d)),
    "node_gfd": graphlet_counts,
    "node_gfd_normalised": dense_profile,
    "point_similarity_cos": similarity("cosine"),
    "point_similarity_rbf": similarity("rbf"),
    "point_similarity_laplacian": similarity("laplacian"),
    "aligned_items": lambda s, d: matching.aligned_items(pair(s), both(s, d)).select("item_id", "in_a", "in_b"),
    "common_edges": lambda s, d: matching.common_edges(pair(s), graph.directed(links(s, d))).select("src", "dst"),
    "neighbor_ratio": lambda s, d: matching.neighbor_ratio(pair(s), graph.directed(links(s, d)), both(s, d), K).select("item_id", r("ratio").alias("ratio")),
    "discounted_similarity": lambda s, d: _discounted(s, d)[1].select("item_id", r("sim").alias("sim")),
    "match_edges": lambda s, d: _weights(s, d).select("src", "dst", r("weight").alias("weight")),
    "match_edges_norm": lambda s, d: matching.normalised_weights(_weights(s, d)).select("src", "dst", r("weight").alias("weight")),
    "pairwise_sqdist": lambda s, d: _distances(s, d).select("i", "j", "d2"),
    "perplexity_beta": lambda s, d: affinity.betas(frame0(s, d), PERPLEXITY).select("i", r("beta").alias("beta")),
    "perplexity_beta_matrix": lambda s, d: affinity.calibrated_rows(affinity.distance_rows(frame0(s, d)), PERPLEXITY).select("i", r("beta").alias("beta")),
    "perplexity_beta_folds": lambda s, d: affinity.betas_by_folds(frame0(s, d), PERPLEXITY).select("i", r("beta").alias("beta")),
    "mean_sigma": lambda s, d: affinity.mean_sigma(affinity.betas(frame0(s, d), PERPLEXITY)).select("frame_id", r("sigma").alias("sigma")),
    "conditional_p": lambda s, d: affinity.conditional_shares(_fit(s, d), 9).select("i", "j", "p"),
    "joint_p": lambda s, d: affinity.joint_shares(_fit(s, d), digits=11).select("i", "j", "p"),
    "init_layout": lambda s, d: _start(s, d).select("item_id", r("y0").alias("y0"), r("y1").alias("y1")),
    "centred_layout": lambda s, d: descent.centred(_start(s, d)).select("item_id", r("y0").alias("y0"), r("y1").alias("y1")),
    "student_q": lambda s, d: affinity.student(_start(s, d), (6, 11)).select("i", "j", "num", "q"),
    "kl_force": lambda s, d: _force(s, d)[1].select("item_id", r("f0", 9).alias("f0"), r("f1", 9).alias("f1")),
    "edge_force": lambda s, d: descent.edge_force(_unit_edges(s, d), _start(s, d, "before"), _start(s, d), GAMMA).select("item_id", r("f0", 9).alias("f0"), r("f1", 9).alias("f1")),
    "one_step_layout": lambda s, d: descent.first_step(*_force(s, d)).select("item_id", r("y0").alias("y0"), r("y1").alias("y1")),
    "kl_cost": lambda s, d: descent.kl_costs(_fit(s, d), _start(s, d)).select("frame_id", r("kl").alias("kl")),
    "edge_cost": lambda s, d: descent.edge_cost(_unit_edges(s, d), _start(s, d, "before"), _start(s, d)).select("frame_id", r("c1").alias("c1")),
    "neighborhood_preservation": preserved,
    "pca_distances": pca_distances,
    "tsne_layout": tsne_layout,
    "joint_layouts": joint_layouts,
    "gfd_sampled": sampled,
}
QUERIES = Q
