"""Exact top-k by integer inner product: columnar branch and bound.

Candidates stand in a vertical layout, dimension by dimension. Sums grow by blocks of dimensions; after each block a
candidate's bound is its sum plus the product of what remains of both lengths (Cauchy-Schwarz), and candidates whose bound
can't reach the query's k-th best so far are compacted away. What is left at the end has exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

K, SCALE, EVERY, BLOCK = 10, 1024, 100, 16
#: Bytes of query vectors that one broadcast may hold; more queries go in several blocks.
BROADCAST = 16 << 20
LONG = (-(2**63), 2**63 - 1)


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; without null ids, null vectors, and null or non-finite components."""
    bad: Column = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    return out.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad).select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array as an int64 matrix, short ones filled up with zeros."""
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(width, int(lens.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = flat
    return out


class Search:
    """The k best of the candidates seen so far, for each query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, queries, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def _keep(self, i: int, score: np.ndarray, vec: np.ndarray) -> None:
        s, v = np.concatenate([self.best[i][0], score]), np.concatenate([self.best[i][1], vec])
        order = np.lexsort((v, -s))[: self.k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], v[j]))[: self.k], int)
        self.best[i] = (s[order], v[order])

    def add(self, vec: np.ndarray, x: np.ndarray) -> None:
        width = max(x.shape[1], self.q.shape[1])
        x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, self.q))
        largest = [int(max(-int(m.min(initial=0)), int(m.max(initial=0)))) for m in (x, q)]
        if largest[0] * largest[1] * max(width, 1) >= 2**52:
            self._plain(vec, x, q)
            return
        columns, q = np.ascontiguousarray(x.T, dtype=np.float64), q.astype(np.float64)  # whole numbers below 2**53 are exact
        cuts = [*range(0, width, BLOCK), width]
        rest_x = np.sqrt(np.array([(columns[c:] ** 2).sum(0) for c in cuts]))
        rest_q = np.sqrt(np.array([(q[:, c:] ** 2).sum(1) for c in cuts]))
        for lo in range(0, len(q), 256):
            hi = min(lo + 256, len(q))
            first = q[lo:hi, : cuts[1] if width else 0] @ columns[: cuts[1] if width else 0]
            floor = np.array([self.best[i][0][-1] if len(self.best[i][0]) == self.k else -np.inf for i in range(lo, hi)])
            alive = first + rest_q[min(1, len(cuts) - 1), lo:hi, None] * rest_x[min(1, len(cuts) - 1)] * (1 + 1e-9) + 1e-3 >= floor[:, None]
            for i in range(lo, hi):
                left = np.flatnonzero(alive[i - lo] & (vec != self.ids[i]))
                total = first[i - lo, left]
                for b in range(1, len(cuts) - 1):
                    if not len(left):
                        break
                    total = total + q[i, cuts[b] : cuts[b + 1]] @ columns[cuts[b] : cuts[b + 1], left]
                    near = total + rest_q[b + 1, i] * rest_x[b + 1, left] * (1 + 1e-9) + 1e-3 >= floor[i - lo]
                    if not near.all():
                        left, total = left[near], total[near]
                if len(left):
                    self._keep(i, total.astype(np.int64), vec[left])

    def _plain(self, vec: np.ndarray, x: np.ndarray, q: np.ndarray) -> None:
        """Components too large for exact doubles: whole numbers of any size, held to the range of a long."""
        x = x.astype(object)
        for i, one in enumerate(q.astype(object)):
            left = np.flatnonzero(vec != self.ids[i])
            if len(left):
                self._keep(i, np.array([min(max(int(s), LONG[0]), LONG[1]) for s in x[left] @ one], np.int64), vec[left])


def _search(ids, queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        search = Search(ids.value, q, k)
        for batch in batches:
            if batch.num_rows:
                search.add(batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), q.shape[1]))
        for i, (score, vec) in enumerate(search.best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), search.ids[i])), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, budget: int = BROADCAST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k candidates of greatest inner product, ties to the
    smaller vec_id; candidates with the query's own id don't count. Both tables are (vec_id, v array<bigint>).

    Queries go through the driver in blocks of at most ``budget`` bytes, one after the other, each against all candidates, which
    are never moved. Vectors
    of different lengths are filled up with zeros; of rows that repeat a query's id the smallest vector asks; repeated
    candidates each count; scores beyond a long are held to its range. Without queries or candidates there are no rows."""
    spark = candidates.sparkSession
    tune(spark)
    asks = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n, width = asks.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * max(width or 1, 1) * 8 // budget))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for b in range(blocks):
        rows = asks.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect() if n else []
        q = np.zeros((len(rows), max(width or 1, 1)), np.int64)
        for i, r in enumerate(rows):
            q[i, : len(r["v"])] = r["v"]
        held = spark.sparkContext.broadcast(q), spark.sparkContext.broadcast(np.array([r["vec_id"] for r in rows], np.int64))
        del rows, q
        found = candidates.select("vec_id", "v").mapInArrow(_search(held[1], held[0], k), "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:  # one block is held at a time, here and in the executors
            found = materialize(found, "ranked")
            for x in held:
                x.destroy()
        out = found if out is None else out.union(found)
    return out


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""
