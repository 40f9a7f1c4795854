"""Frames that arrive over time. An extension: each new frame gets its graph, appended to a table.

The source is a folder of frame tables; state is the checkpoint of the query, so a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import knn_graph

SCHEMA = "frame_id int, item_id long, features array<double>, label string"


def graphs_as_frames_arrive(spark: SparkSession, source: str, target: str, checkpoint: str, k: int) -> StreamingQuery:
    """Starts a query that writes the graphs of whole frames, one Parquet folder for each batch of them.

    A frame must arrive in one file, as a batch holds whole files. A batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        knn_graph(batch, k).write.mode("overwrite").parquet(f"{target}/batch={number}")

    frames = spark.readStream.schema(SCHEMA).parquet(source)
    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
