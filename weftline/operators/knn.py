"""Exact k-nearest-neighbour graphs: (frame_id, src, dst, rank, dist)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import minmax_scaled

#: Items of a block; two blocks meet in one task.
BLOCK = 4096
#: Items of a block at least, where smaller blocks would give every core work.
LEAST = 256


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, self_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, distance) of each query's k nearest, ties to the smaller id, itself left out.

    Products of matrices tell a superset; the distances of that are taken from the differences."""
    out_q, out_c, out_d = [], [], []
    norm = (x**2).sum(1)
    for lo in range(0, len(q), 512):
        part = q[lo : lo + 512]
        near = np.maximum((part**2).sum(1)[:, None] + norm - 2 * part @ x.T, 0)
        near[self_ids[lo : lo + 512, None] == ids] = np.inf
        m = min(k, len(x)) - 1
        if m < 0:
            continue
        edge = np.partition(near, m, axis=1)[:, m]
        slack = 1e-9 * ((part**2).sum(1) + norm.max(initial=0)) + 1e-12
        i, j = np.nonzero((near <= (edge + slack)[:, None]) & np.isfinite(near))
        d = np.sqrt(((part[i] - x[j]) ** 2).sum(1))
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        out_q.append(i[keep] + lo)
        out_c.append(j[keep])
        out_d.append(d[keep])
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_c, np.int64), cat(out_d, float)


def _meet(k: int):
    def run(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").combine_chunks())
        ids, x = group.column("item_id").to_numpy(), _matrix(group.column("features"))
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(c):
            return pa.table({"frame_id": pa.array([], pa.int32()), "src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        i, j, d = nearest(x[q], x[c], ids[c], ids[q], k)
        frame = group.column("frame_id")[0].as_py()
        return pa.table({"frame_id": pa.array(np.full(len(i), frame, np.int32)), "src": pa.array(ids[q][i]), "dst": pa.array(ids[c][j]), "dist": pa.array(d)})

    return run


def knn_graph(frames: DataFrame, k: int, scaled: bool = True, block: int = BLOCK) -> DataFrame:
    """The k nearest other items of each item by Euclidean distance, ties to the smaller id; fewer if there are fewer.

    Distances are those of min-max scaled frames unless ``scaled`` is off. Items are dealt into blocks by a hash of
    their id, and each pair of blocks is one task of at most block squared distances, so memory follows the block, not the
    frame. Every task passes k neighbours of an item on, and the last step ranks these."""
    rows = (minmax_scaled(frames) if scaled else frames).select("frame_id", "item_id", "features")
    lots = max(1, round(rows.sparkSession.sparkContext.defaultParallelism ** 0.5))  # pairs of blocks then are as many as cores
    sizes = rows.groupBy("frame_id").agg(F.greatest(F.ceil(F.count("*") / block), F.least(F.lit(lots), F.ceil(F.count("*") / LEAST))).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "frame_id").withColumn("own", F.pmod(F.xxhash64("item_id"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = rows.select("frame_id", "item_id", "features", F.lit(True).alias("asks"), F.col("own").alias("a"), every.alias("b"))
    told = rows.select("frame_id", "item_id", "features", F.lit(False).alias("asks"), every.alias("a"), F.col("own").alias("b"))
    found = asks.union(told).groupBy("frame_id", "a", "b").applyInArrow(_meet(k), "frame_id int, src long, dst long, dist double")
    order = Window.partitionBy("frame_id", "src").orderBy("dist", "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("frame_id", "src", "dst", "rank", "dist")


def knn_graph_lsh(frames: DataFrame, k: int, width: float = 0.5, tables: int = 8, seed: int = 7) -> DataFrame:
    """An approximate graph by bucketed random projections, for frames too large for all pairs of blocks. An extension."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = minmax_scaled(frames).select("frame_id", "item_id", array_to_vector("features").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(rows)
    pairs = model.approxSimilarityJoin(rows, rows, float("inf"), "dist")
    pairs = pairs.select(F.col("datasetA.frame_id").alias("frame_id"), F.col("datasetA.item_id").alias("src"), F.col("datasetB.frame_id").alias("f"), F.col("datasetB.item_id").alias("dst"), "dist")
    order = Window.partitionBy("frame_id", "src").orderBy("dist", "dst")
    pairs = pairs.where((F.col("frame_id") == F.col("f")) & (F.col("src") != F.col("dst")))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("frame_id", "src", "dst", "rank", "dist")
