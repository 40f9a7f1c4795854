"""Graphs by frame: undirected edges (frame_id, u, v) with u < v, and what is counted and walked on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stars


def undirected(knn: DataFrame) -> DataFrame:
    """Each linked pair of items once; self links are left out."""
    return knn.where("src <> dst").select("frame_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def directed(knn: DataFrame, k: int | None = None) -> DataFrame:
    """(frame_id, src, dst); with ``k``, an item that has another number of neighbours raises an error."""
    links = knn.where("src <> dst").select("frame_id", "src", "dst")
    if k is None:
        return links
    n = links.groupBy("frame_id", "src").agg(F.count("*").alias("n"))
    return links.join(n, ["frame_id", "src"]).where(F.when(F.col("n") == k, True).otherwise(F.raise_error(F.lit("an item has the wrong number of neighbours")).cast("boolean"))).select("frame_id", "src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("frame_id", "u", "v").union(edges.select("frame_id", F.col("v").alias("u"), F.col("u").alias("v")))


def nodes(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select("frame_id", F.col("u").alias("item_id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("frame_id", F.col("u").alias("item_id")).agg(F.count("*").alias("degree"))


def has_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (frame_id, a, b) with ``linked``, whichever way round they are given; unknown ids are not linked."""
    known = edges.select("frame_id", F.col("u").alias("x"), F.col("v").alias("y"), F.lit(True).alias("hit"))
    ends = pairs.select("frame_id", "a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return ends.join(known, ["frame_id", "x", "y"], "left").select("frame_id", "a", "b", F.coalesce("hit", F.lit(False)).alias("linked"))


def edge_count(edges: DataFrame, distance: int = 1) -> DataFrame:
    """Edges of each frame, or for distance 2 the sum over edges of deg u + deg v - 2; 0 for other distances."""
    if distance == 1:
        return edges.groupBy("frame_id").agg(F.count("*").alias("n"))
    if distance != 2:
        return edges.groupBy("frame_id").agg(F.lit(0).cast("long").alias("n"))
    # each node of degree d is the end of d edges: the sum is that of d * (d - 1)
    return degrees(edges).groupBy("frame_id").agg(F.sum(F.col("degree") * (F.col("degree") - 1)).alias("n"))


def induced(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (set_id, frame_id, u, v) between the members of each set (set_id, frame_id, nodes array)."""
    member = sets.select("set_id", "frame_id", F.explode(F.array_distinct("nodes")).alias("u"))
    return member.join(edges, ["frame_id", "u"]).join(member.withColumnRenamed("u", "v"), ["set_id", "frame_id", "v"]).select("set_id", "frame_id", "u", "v")


def connected(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, frame_id, is_connected): whether the edges among a set's members join them all. A set has at most a few
    members, so its edges are folded in one row: reach grows by the edges it touches until it can't."""
    links = induced(sets, edges).groupBy("set_id", "frame_id").agg(F.collect_list(F.array("u", "v")).alias("links"))
    rows = sets.select("set_id", "frame_id", F.array_distinct("nodes").alias("nodes")).join(links, ["set_id", "frame_id"], "left")
    none = F.array().cast("array<array<bigint>>")
    grow = lambda reach: F.array_union(reach, F.flatten(F.filter(F.coalesce("links", none), lambda e: F.arrays_overlap(e, reach))))
    reach = F.aggregate(F.col("nodes"), F.slice("nodes", 1, 1), lambda acc, _: grow(acc))
    return rows.select("set_id", "frame_id", (F.size(reach) == F.size("nodes")).alias("is_connected"))


def components(edges: DataFrame) -> DataFrame:
    """(frame_id, item_id, component): the smallest item that edges reach."""
    found = stars.components(edges.select("frame_id", F.col("u").alias("a"), F.col("v").alias("b")), ["frame_id"])
    return found.withColumnRenamed("id", "item_id")


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("frame_id", "component").agg(F.count("*").alias("size"))


def bfs_layers(edges: DataFrame, items: DataFrame, levels: int) -> DataFrame:
    """(frame_id, seed, item_id, layer): the items at distance 0 to levels - 1 of every seed (frame_id, item_id)."""
    both = both_ways(edges)
    layers = [items.select("frame_id", F.col("item_id").alias("seed"), "item_id", F.lit(0).alias("layer"))]
    for depth in range(1, levels):
        step = layers[-1].join(both, (layers[-1].frame_id == both.frame_id) & (layers[-1].item_id == both.u)).select(layers[-1].frame_id, "seed", F.col("v").alias("item_id")).distinct()
        # a neighbour lies in this layer, the one before or the next
        for seen in layers[-2:]:
            step = step.join(seen, ["frame_id", "seed", "item_id"], "left_anti")
        layers.append(step.withColumn("layer", F.lit(depth)))
    return reduce(DataFrame.union, layers)
