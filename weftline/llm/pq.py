"""Embedding near-duplicates by product quantisation over coarse inverted lists.

Lists and codebooks are fitted on a bounded sample; every vector is coded, with the length of what its code misses. Two
bounds make the search whole for a threshold: a unit vector within r of a query can lie in a list only if the query is
within r of the bisector of the two centroids and within r plus the list's radius of its centroid, so those lists are
probed; and its table distance is off by no more than the length missed, so a pair is dropped only beyond that. What is left
gets its exact cosine. Lists are cut into blocks, queries into chunks, and only equal labels meet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, tune
from .components import components

COSINE = 0.93
#: The sample that the model is fitted on, vectors for each list, the most lists, subspaces, codes in each.
SAMPLE, PER_LIST, LISTS, PARTS, CODES = 16_384, 4_000, 1_024, 8, 64
#: Vectors of a list in one block, and queries in one chunk.
BLOCK, CHUNK = 2_048, 2_048
SLACK = 1e-6


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray
    #: (part, code, dimension): of residuals.
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centroids, and the nearest."""
        d = np.maximum((x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0)
        return d, d.argmin(1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length that they miss."""
        parts, _, dim = self.books.shape
        codes, missed = np.empty((len(residual), parts), np.uint8), np.zeros(len(residual))
        for p in range(parts):
            r, book = residual[:, p * dim : (p + 1) * dim], self.books[p]
            codes[:, p] = ((book**2).sum(1) - 2 * r @ book.T).argmin(1)
            missed += ((r - book[codes[:, p]]) ** 2).sum(1)
        return codes, np.sqrt(missed)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(x: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES) -> Model:
    """A model of unit vectors; the width is filled up to a multiple of the parts."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    centroids = np.unique(kmeans(x, min(lists, len(x))), axis=0)
    near = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)
    residual, dim = x - centroids[near], x.shape[1] // parts
    books = np.stack([np.pad(b, ((0, codes - len(b)), (0, 0)), mode="edge") for b in (kmeans(residual[:, p * dim : (p + 1) * dim], min(codes, len(x)), seed=p) for p in range(parts))])
    return Model(centroids, books)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    lens = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lens[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _encode(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(2), model.width))
            d, near = model.nearest(x)
            codes, missed = model.encode(x - model.centroids[near])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(near.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(x)), near])), pa.array(missed), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["vec_id", "label", "e", "copies", "list", "far", "missed", "codes"],
            )

    return run


def _probe(held, radii: np.ndarray, r: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        gaps = 2 * np.sqrt(np.maximum(((model.centroids[:, None] - model.centroids[None]) ** 2).sum(2), 1e-30))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(2), model.width))
            d, near = model.nearest(x)
            own = d[np.arange(len(x)), near][:, None]
            go = ((d - own) / gaps[near] <= r + SLACK) & (np.sqrt(d) <= r + radii + SLACK)
            go[np.arange(len(x)), near] = True
            i, lists = np.nonzero(go)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(lists.astype(np.int32))], names=["vec_id", "label", "e", "list"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same ids as the links (a, b), one for each id at most: to the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    rest = np.flatnonzero(low != np.arange(len(ids)))
    return ids[rest], ids[low[rest]]


def _meet(held, cosine: float, r: float):
    def run(group: pa.Table) -> pa.Table:
        model = Model(*held.value)
        group = group.combine_chunks()
        col = lambda k: group.column(k).combine_chunks() if isinstance(group.column(k), pa.ChunkedArray) else group.column(k)
        is_query = np.array(col("missed").is_null())
        raw, ids = _matrix(col("e"), model.width), col("vec_id").to_numpy(zero_copy_only=False)
        x, q, c = unit(raw), np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out_a, out_b, out_n = [], [], []
        if len(q) and len(c):
            parts, _, dim = model.books.shape
            centroid = model.centroids[int(group.column("list")[0].as_py())]
            codes = np.frombuffer(b"".join(v for v in col("codes").take(pa.array(c)).to_pylist()), np.uint8).reshape(-1, parts)
            missed, copies = np.array(col("missed").take(pa.array(c))), np.array(col("copies").take(pa.array(c)))
            links_a, links_b = [], []
            for lo in range(0, len(q), 256):
                part = q[lo : lo + 256]
                residual = x[part] - centroid
                near = np.zeros((len(part), len(c)))
                for p in range(parts):  # a table of distances for each query, looked up by code
                    rp, book = residual[:, p * dim : (p + 1) * dim], model.books[p]
                    tables = (rp**2).sum(1)[:, None] + (book**2).sum(1) - 2 * rp @ book.T
                    near += tables[:, codes[:, p]]
                i, j = np.nonzero((np.sqrt(np.maximum(near, 0)) <= r + missed + SLACK) & (ids[part][:, None] != ids[c]))
                for s in range(0, len(i), 1 << 16):
                    a, b = part[i[s : s + (1 << 16)]], j[s : s + (1 << 16)]
                    ok = (x[a] * x[c[b]]).sum(1) >= cosine
                    links_a.append(ids[a[ok]])
                    links_b.append(b[ok])
            if links_a:
                a, b = np.concatenate(links_a), np.concatenate(links_b)
                found, back = np.unique(a, return_inverse=True)
                out_a, out_n = [found], [np.bincount(back, copies[b], len(found)).astype(np.int64)]
                out_b = [np.full(len(found), -1)]
                x_, y_ = _forest(a, ids[c[b]])
                out_a, out_b, out_n = [*out_a, x_], [*out_b, y_], [*out_n, np.full(len(x_), -1)]
        cat = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cat(out_a)), "b": pa.array(cat(out_b)), "n": pa.array(cat(out_n))})

    return run


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id that links reach), kept for each row.

    ``vectors`` has vec_id, embedding, label. Links join vectors of one label whose cosine in double precision reaches
    the threshold. A vector that is null, empty, zero or holds null or non-finite components, a null label or a null id has no
    links. Shorter vectors are filled up with zeros. Equal vectors of one label are searched as one; rows repeated with their
    id are one vector. The model sees at most ``sample`` vectors, the smallest by a hash of the id; an empty table gives no
    rows."""
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e"))
    ready = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("e"))
    good = rows.where(ready)
    distinct = good.groupBy("label", "e").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies"))
    distinct = materialize(distinct.select("vec_id", "label", "e", "copies"), "distinct")
    n, width = distinct.agg(F.count("*"), F.max(F.size("e"))).first()
    alone_of = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone_of(rows)
    picked = distinct.select("vec_id", "e").orderBy(F.xxhash64(F.lit("pq"), "vec_id"), "vec_id").limit(sample).collect()
    x = np.zeros((len(picked), width))
    for i, p in enumerate(picked):
        x[i, : len(p["e"])] = p["e"]
    model = fit(unit(x), max(1, min(LISTS, n // PER_LIST)))
    held, r = spark.sparkContext.broadcast((model.centroids, model.books)), float(np.sqrt(2 - 2 * cosine))
    coded = materialize(distinct.mapInArrow(_encode(held), "vec_id long, label string, e array<double>, copies long, list int, far double, missed double, codes binary"), "coded")
    radii = np.zeros(len(model.centroids))
    for row in coded.groupBy("list").agg(F.max("far").alias("far")).collect():
        radii[row["list"]] = row["far"]
    probes = materialize(distinct.mapInArrow(_probe(held, radii, r), "vec_id long, label string, e array<double>, list int"), "probes")
    cells = coded.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = materialize(cells.join(probes.groupBy("label", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), ["label", "list"]), "cells")
    spread = F.xxhash64(F.lit("cell"), "vec_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = coded.join(cells, ["label", "list"]).select("vec_id", "label", "list", "e", "copies", "missed", "codes", F.pmod(spread, "blocks").cast("int").alias("block"), each("chunks").alias("chunk"))
    here = probes.join(cells, ["label", "list"]).select("vec_id", "label", "list", "e", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("double").alias("missed"), F.lit(None).cast("binary").alias("codes"), each("blocks").alias("block"), F.pmod(spread, "chunks").cast("int").alias("chunk"))
    met = there.union(here).groupBy("label", "list", "block", "chunk").applyInArrow(_meet(held, cosine, r), "a long, b long, n long")
    met = materialize(met, "met")
    comp = materialize(components(met.where("n < 0")), "comp")
    links = met.where("n >= 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("linked"))
    classes = distinct.join(links, "vec_id", "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    classes = classes.select(F.col("label"), F.col("e"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    classes = materialize(classes, "classes")
    release(coded, probes, cells)
    found = good.withColumn("h", F.xxhash64("label", "e")).join(classes.withColumn("h", F.xxhash64("label", "e")), ["h", "label", "e"])
    found = found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return found.union(alone_of(rows.where(~F.coalesce(ready, F.lit(False)))))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id <= coalesce(c.b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""
