"""Text files: frames, graphs, similarities and layouts. Parquet is the first choice; these formats serve exchange.

A line's number is its item. Lines are numbered without collecting a file: rows are counted by split, and a line's number is the
count of the splits before its own plus its rank there."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_NAME = r"_(-?\d+)\.[^._]*$"


def frame_id_of(file_name: Column) -> Column:
    """The number between the last underscore and the extension of a file name; null without one."""
    found = F.regexp_extract(file_name, FRAME_NAME, 1)
    return F.when(found != "", found.cast("int"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, frame_id, line, tokens) of all non-empty lines; line counts from 0 in each file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    raw = raw.where(F.trim("value") != "")
    counts = raw.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "split", before.alias("before"))
    line = F.col("before") + F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1
    tokens = F.split(F.trim("value"), r"\s+")
    return raw.join(starts, ["file", "split"]).select("file", frame_id_of(F.col("name")).alias("frame_id"), line.cast("long").alias("line"), tokens.alias("tokens"))


def read_frames(spark: SparkSession, path: str | list[str], frame_ids: list[int] | None = None) -> DataFrame:
    """Frames from files <name>_<id>.txt: numbers split by white space, the last token being the label."""
    rows = numbered_lines(spark, path)
    if frame_ids is not None:
        rows = rows.where(F.col("frame_id").isin(frame_ids))
    values = F.transform(F.slice("tokens", F.lit(1), F.size("tokens") - 1), lambda t: t.cast("double"))
    return rows.select("frame_id", F.col("line").alias("item_id"), values.alias("features"), F.element_at("tokens", -1).alias("label"))


def _written(lines: DataFrame, path: str) -> None:
    """One folder a frame (or pair), its lines in order by ``at``: sorted ranges, so no single task writes a large frame."""
    keys = [c for c in lines.columns if c not in ("at", "value")]
    lines.repartitionByRange(*keys, "at").sortWithinPartitions(*keys, "at").drop("at").write.mode("overwrite").partitionBy(*keys).text(path)


def write_frames(frames: DataFrame, path: str) -> None:
    numbers = F.array_join(F.transform("features", lambda x: F.format_string("%.16f", x)), "\t")
    _written(frames.select("frame_id", F.col("item_id").alias("at"), F.concat_ws("\t", numbers, "label").alias("value")), path)


def read_written_frames(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_frames` wrote; items are numbered by line."""
    rows = _partitioned(spark, path, ["frame_id"])
    values = F.transform(F.slice("tokens", F.lit(1), F.size("tokens") - 1), lambda t: t.cast("double"))
    return rows.select("frame_id", F.col("line").alias("item_id"), values.alias("features"), F.element_at("tokens", -1).alias("label"))


def write_layouts(layout: DataFrame, path: str) -> None:
    """Lines of y0, y1 with 16 decimals, and the label."""
    line = F.concat_ws("\t", F.format_string("%.16f", "y0"), F.format_string("%.16f", "y1"), "label")
    _written(layout.select("frame_id", F.col("item_id").alias("at"), line.alias("value")), path)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_layouts` wrote; items are numbered by line, the label is the last token."""
    rows = _partitioned(spark, path, ["frame_id"])
    return rows.select("frame_id", F.col("line").alias("item_id"), *(F.get("tokens", F.lit(i)).cast("double").alias(f"y{i}") for i in (0, 1)), F.element_at("tokens", -1).alias("label"))


def _partitioned(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Numbered lines of the folders that :func:`_written` made; the parts' names give the order of their lines."""
    raw = spark.read.text(path).select(*keys, "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    counts = raw.groupBy(*keys, "file", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "file", "split", before.alias("before"))
    line = F.col("before") + F.row_number().over(Window.partitionBy(*keys, "file", "split").orderBy("at")) - 1
    return raw.join(starts, [*keys, "file", "split"]).select(*keys, line.cast("long").alias("line"), F.split(F.trim("value"), r"\s+").alias("tokens"))


def write_graph(links: DataFrame, items: DataFrame, path: str) -> None:
    """A first line with the number of items, then each item with its neighbours and their distances by rank."""
    listed = links.groupBy("frame_id", F.col("src").alias("at")).agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("to"))
    text = F.concat_ws(" ", F.col("at").cast("string"), F.array_join(F.transform("to", lambda t: F.concat_ws(" ", t["dst"].cast("string"), t["dist"].cast("string"))), " "))
    sizes = items.groupBy("frame_id").agg(F.count("*").cast("string").alias("value")).select("frame_id", F.lit(-1).cast("long").alias("at"), "value")
    _written(sizes.union(listed.select("frame_id", "at", text.alias("value"))), path)


def read_graph(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(frame_id, src, dst, rank, dist); with ``k``, a line with another number of tokens than 2k + 1 raises an error."""
    rows = _partitioned(spark, path, ["frame_id"]).where("line > 0")
    if k is not None:
        rows = rows.where(F.when(F.size("tokens") == 2 * k + 1, True).otherwise(F.raise_error(F.lit("a graph line has the wrong number of tokens")).cast("boolean")))
    pairs = F.transform(F.sequence(F.lit(1), F.floor((F.size("tokens") - 1) / 2).cast("int")), lambda r: F.struct(r.alias("rank"), F.get("tokens", 2 * r - 1).cast("long").alias("dst"), F.get("tokens", 2 * r).cast("double").alias("dist")))
    rows = rows.where(F.size("tokens") >= 3).select("frame_id", F.get("tokens", F.lit(0)).cast("long").alias("src"), F.explode(pairs).alias("p"))
    return rows.select("frame_id", "src", "p.dst", "p.rank", "p.dist")


def write_similarities(sims: DataFrame, path: str) -> None:
    _written(sims.select("frame_a", "frame_b", F.col("item_id").alias("at"), F.concat_ws("\t", F.col("item_id").cast("string"), F.col("sim").cast("string")).alias("value")), path)


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("frame_a", "frame_b", F.split("value", "\t").alias("t")).select("frame_a", "frame_b", F.get("t", F.lit(0)).cast("long").alias("item_id"), F.get("t", F.lit(1)).cast("double").alias("sim"))


def write_info(info: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(info, f)
