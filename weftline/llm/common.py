"""Shared plumbing of the corpus operators: Arrow limits and the columns that they read."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import free_shuffles, release  # noqa: F401
from ..plans.storage import write_table as materialize

#: Rows in one Arrow batch; a batch of long texts then stays far below a worker's memory.
ARROW_ROWS = 2000
#: Bytes of text for which there is one bucket; a bucket's rows are one group of a kernel.
BUCKET = 4 << 20
#: Partitions of a shuffle by bucket or block, at most: more than the driver can keep count of help nobody.
PARTITIONS = 50_000


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that kernels receive, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Returns what this worker has freed to the system. Spark keeps workers for further stages, several an executor, and what
    each has reached would count against the executor throughout."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(name: str, taken: list[str]) -> str:
    """``name`` or, where a column has it already in whatever case, the same with a number behind it."""
    lower, i, out = {c.lower() for c in taken}, 0, name
    while out.lower() in lower:
        i += 1
        out = f"{name}_{i}"
    return out


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, so that further columns can't clash; a null text is the empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def replayable(docs: DataFrame, tag: str) -> DataFrame:
    """``docs`` itself if it is a scan of files with nothing but projections and filters, whose rows come in the same order in
    every run; else a written copy.

    Kernels that number blocks of rows run more than once over the same input, so the numbers must not change."""
    plan = docs._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    scans = all(leaves.apply(i).getClass().getSimpleName() == "FileSourceScanExec" for i in range(leaves.size()))
    text = plan.toString()
    moves = any(x in text for x in ("Exchange", "MapInArrow", "MapInPandas", "Union", "Sort", "Limit", "Sample"))
    return docs if scans and leaves.size() == 1 and not moves else materialize(docs, tag)


def buckets_for(docs: DataFrame, column: str = "text") -> int:
    """How many buckets the hashes of so much text are dealt into: they follow the input, so that no bucket grows with it."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(8, -(-size // BUCKET))


def dealt(rows: DataFrame, column: str, buckets: int) -> DataFrame:
    """``rows`` by ``column``, in as many partitions as buckets; a partition of several groups takes one after the other."""
    return rows.repartition(min(buckets, PARTITIONS), column)
