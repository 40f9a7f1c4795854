"""Quality scores by compression: texts are compressed with a zstandard dictionary of good and with one of bad text.

A text is cut into chunks so that the dictionaries, not the text's own past, decide the sizes. The difference of the two
sizes over the text's size is all that a score depends on; a falling step curve with straight lines between the steps, fitted
on labelled texts that took no part in building the dictionaries, turns it into a probability. Good texts lie at one end of
the differences and junk at the other; what repeats itself costs little under either dictionary, so it lies between them, where
few good texts are, and a curve that must fall everywhere but has no shape of its own can part the two."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, texts, tune

FOLDS, THRESHOLD = 5, 0.3
#: Labelled documents of each class that build a dictionary, their bytes at most, and documents that fit the curve.
BUILD, BUILD_BYTES, FIT = 2000, 16 << 20, 3000
CHUNK, SAMPLE, DICTIONARY, LEVEL = 1024, 4096, 1 << 16, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: Rising differences and the probabilities there; None if a class has no labelled text, then ``prior`` is every score.
    curve: tuple[tuple[float, ...], tuple[float, ...]] | None
    prior: float

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return np.interp(difference, *self.curve) if self.curve else np.full(len(difference), self.prior)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


class Sizes:
    """Compressed sizes of texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = (self._compressor(x) for x in (good, bad))

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        if not raw:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def difference(self, raw: bytes) -> float:
        """Bytes more under the good dictionary than under the bad one, for each byte of the text."""
        diff, view = 0, memoryview(raw)
        for i in range(0, len(raw), CHUNK):
            part = view[i : i + CHUNK]
            diff += len(self.good.compress(part)) - len(self.bad.compress(part))
        return diff / (len(raw) + 16)

    def differences(self, text: pa.Array) -> np.ndarray:
        return np.array([self.difference(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in text], float)


def _differences(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.differences(batch.column(1)))], names=["key", "difference"])

    return run


def dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes serve as they are
        return b"".join(samples)[-DICTIONARY:]


def falling(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The ends of the steps of the falling step curve nearest to the labels y (0 or 1) at x, by pooling adjacent violators.

    A step's height counts half a label of either kind more, so none is quite 0 or 1."""
    steps: list[list[float]] = []  # least x, greatest x, sum of y, count
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        steps.append([a, a, b, 1.0])
        while len(steps) > 1 and steps[-2][2] * steps[-1][3] <= steps[-1][2] * steps[-2][3]:
            _, hi, total, n = steps.pop()
            steps[-1][1:] = [hi, steps[-1][2] + total, steps[-1][3] + n]
    height = np.minimum.accumulate([(total + 0.5) / (n + 1) for _, _, total, n in steps])
    return tuple(v for lo, hi, _, _ in steps for v in (lo, hi)), tuple(float(h) for h in height for _ in (0, 1))


def train(docs: DataFrame, labels: DataFrame, build: int = BUILD, fit: int = FIT, column: str = "quality", build_bytes: int = BUILD_BYTES) -> Model:
    """Fits a model on a bounded sample of the labelled rows outside the held-out fold: of each class the first
    ``build`` + ``fit`` by a hash of the id. Those that build a dictionary are taken whole, in that order, as long as their
    bytes stay within ``build_bytes``. An id with labels of both classes counts for neither; of rows that share an id the
    least text counts."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(F.col(column).cast("int")).alias("y"), F.max(F.col(column).cast("int")).alias("other")).where("y = other").select("doc_id", "y")
    order = [F.xxhash64(F.lit("quality"), "doc_id"), F.col("doc_id")]
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    picked = []
    for y in (0, 1):
        n = min(build + fit, counts.get(y, 0))
        first = max(1, n * build // (build + fit)) if n else 0
        picked += [(r["doc_id"], y, i, i < first) for i, r in enumerate(known.where(F.col("y") == y).orderBy(*order).limit(build + fit).collect())]
    if not picked:
        return Model(b"", b"", None, 0.5)
    spark = docs.sparkSession
    sample = texts(docs).join(F.broadcast(spark.createDataFrame(picked, "doc_id long, y int, at int, builds boolean")), "doc_id")  # at most 2 * (build + fit) rows
    sizes = sample.where("builds").groupBy("y", "at", "doc_id").agg(F.min(F.struct("text")).getField("text").alias("text")).select("y", "at", "doc_id", F.octet_length("text").alias("size"))
    whole, room = [], {0: build_bytes, 1: build_bytes}
    for r in sizes.orderBy("y", "at").collect():
        if r["size"] <= room[r["y"]]:
            whole.append(r["doc_id"])
            room[r["y"]] -= r["size"]
    pieces: dict[int, list[bytes]] = {0: [], 1: []}
    rows = sample.where("builds").where(F.col("doc_id").isin(whole)).groupBy("y", "at").agg(F.min("text").alias("text"))
    for r in rows.orderBy("y", "at").collect():
        raw = r["text"].encode()
        pieces[r["y"]] += [raw[i : i + SAMPLE] for i in range(0, len(raw), SAMPLE)]
    if not all(pieces.values()):
        return Model(b"", b"", None, prior)
    good, bad = dictionary(pieces[1]), dictionary(pieces[0])
    tune(spark)
    rest = sample.where("not builds").groupBy("y", "at").agg(F.min("text").alias("text")).select(F.col("y").cast("long").alias("key"), "text")
    rows = rest.mapInArrow(_differences(good, bad), "key long, difference double").collect()
    if len({r["key"] for r in rows}) < 2:
        return Model(good, bad, None, prior)
    got = np.array(sorted((r["difference"], r["key"]) for r in rows))
    return Model(good, bad, falling(got[:, 0], got[:, 1]), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``, over its whole text; a null text is the empty one."""
    tune(docs.sparkSession)
    return _scored(texts(docs).select(F.col("doc_id").alias("key"), "text"), model).withColumnRenamed("key", "doc_id")


def _scored(keyed: DataFrame, model: Model) -> DataFrame:
    if model.curve is None:
        return keyed.select("key", F.lit(model.prior).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(sizes.differences(batch.column(1))))], names=["key", "score"])

    return keyed.mapInArrow(run, "key long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the threshold; repeated rows fare alike."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            yield batch.filter(pa.array(model.probability(sizes.differences(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
