"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
#: Folders of local sessions, which go with the process.
_temporary: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a local session gets a temporary folder and any other an
    error, since executors elsewhere would not see such a folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _temporary.append(tempfile.mkdtemp(prefix="weftline-"))
        where = "file://" + _temporary[-1]
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts the lineage and survives the loss of executors. The table goes when the driver's process ends, or earlier by
    :func:`release`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def keep_path(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the driver's process ends, as the tables of :func:`write_table` do."""
    _written[path] = spark
    return path


def release(*tables: DataFrame) -> None:
    """Deletes tables of :func:`write_table` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_weftline_path", None)
        if path in _written:
            _delete(df.sparkSession, path)
            del _written[path]


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, spark in _written.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            break
    for folder in _temporary:
        shutil.rmtree(folder, ignore_errors=True)
