"""Frames: (frame_id, item_id, features array<double>, label). Scaling, centroids, and frames made from others.

Generators return new frames; all randomness comes from hashes of a seed and the item, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import normal, uniform


def from_vectors(vectors: DataFrame, frame_id: int = 0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A frame from a table of vectors; rows without an id or a vector are no items."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return rows.select(F.lit(frame_id).alias("frame_id"), F.col(id_col).cast("long").alias("item_id"), F.col(vector_col).cast("array<double>").alias("features"), F.col(label_col).cast("string").alias("label"))


def with_features(frames: DataFrame, features: Column) -> DataFrame:
    return frames.select("frame_id", "item_id", features.alias("features"), "label")


def as_frame(frames: DataFrame, frame_id: int) -> DataFrame:
    return frames.withColumn("frame_id", F.lit(frame_id))


def minmax_scaled(frames: DataFrame) -> DataFrame:
    """All cells of a frame scaled by that frame's least and greatest cell; a constant frame becomes all null."""
    range_ = frames.groupBy("frame_id").agg(F.min(F.array_min("features")).alias("lo"), F.max(F.array_max("features")).alias("hi"))
    # one row a frame
    return frames.join(F.broadcast(range_), "frame_id").select("frame_id", "item_id", F.transform("features", lambda x: F.try_divide(x - F.col("lo"), F.col("hi") - F.col("lo"))).alias("features"), "label")


def centroids(frames: DataFrame) -> DataFrame:
    """(frame_id, label, centroid): the mean vector of each label. Sums are partial by position, never whole groups."""
    cells = frames.select("frame_id", "label", F.posexplode("features").alias("pos", "x")).groupBy("frame_id", "label", "pos").agg(F.avg("x").alias("x"))
    return cells.groupBy("frame_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("centroid"))


def with_label(frames: DataFrame, labels: list[str]) -> DataFrame:
    return frames.where(F.col("label").isin(labels))


def without(frames: DataFrame, ids: DataFrame) -> DataFrame:
    """The items whose id is not among ``ids``."""
    return frames.join(ids.select("item_id").distinct(), "item_id", "left_anti")


def _only(labels: list[str], changed: Column) -> Column:
    return F.when(F.col("label").isin(labels), changed).otherwise(F.col("features"))


def _moved(offset: Column) -> Column:
    return F.transform("features", lambda x: x + offset)


def _jittered(seed: str, most: float) -> Column:
    return F.transform("features", lambda x, i: x + (uniform(seed, F.col("item_id"), i) * 2 - 1) * most)


def _shared(seed: str, most: float) -> Column:
    """One random offset for each dimension, the same for every item."""
    return F.transform("features", lambda x, i: x + (uniform(seed, i) * 2 - 1) * most)


def gaussian_clusters(spark: SparkSession, n: int, clusters: int, dim: int, spread: float, variance: float, seed: str, means: list[list[float]] | None = None, frame_id: int = 0) -> DataFrame:
    """n items in equal clusters around uniform means in [-spread, spread]^dim or the given ones, in a hashed order."""
    if n % clusters:
        raise ValueError("the clusters must have equal sizes")
    rows = spark.range(n).select(F.col("id"), F.floor(F.col("id") / (n // clusters)).cast("long").alias("c"))
    if means:
        table = F.array(*(F.array(*map(F.lit, map(float, m))) for m in means))
        mean = lambda i: F.get(F.get(table, F.col("c").cast("int")), i)
    else:
        mean = lambda i: (uniform(f"{seed}:mean", F.col("c"), i) * 2 - 1) * spread
    features = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: mean(i) + normal(seed, F.col("id"), i) * variance**0.5)
    return rows.select(F.lit(frame_id).alias("frame_id"), F.col("id").alias("item_id"), features.alias("features"), F.col("c").cast("string").alias("label"))


def lowest(rows: DataFrame, by: list[str], quotas: DataFrame, seed: str) -> DataFrame:
    """Adds ``low``: true for as many rows of each group ``by`` as ``quotas`` (some of these columns, quota) tells, in the order of
    a seeded hash of the item. The boundary is found by counts of hash ranges, and only a range's rows are ranked."""
    u = uniform(seed, F.col("item_id"))
    rows = rows.withColumn("u", u).withColumn("part", F.floor(u * 1024).cast("int"))
    counts = rows.groupBy(*by, "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*by).orderBy("part")) - F.col("c")
    counts = counts.select(*by, "part", before.alias("before")).join(quotas, [c for c in quotas.columns if c != "quota"])
    rank = F.row_number().over(Window.partitionBy(*by, "part").orderBy("u", "item_id"))
    return rows.join(counts, [*by, "part"]).withColumn("low", F.col("before") + rank <= F.col("quota")).drop("u", "part", "before", "quota")


def keep_split(frames: DataFrame, keep: float, seed: str) -> DataFrame:
    """Adds ``kept``: true for the floor(keep * n) items of a frame that a seeded hash puts first."""
    quotas = frames.groupBy("frame_id").agg(F.floor(F.count("*") * keep).alias("quota"))
    return lowest(frames, ["frame_id"], quotas, seed).select("frame_id", "item_id", "features", "label", F.col("low").alias("kept"))


def disturb(frames: DataFrame, most: float, hard: bool, seed: str) -> DataFrame:
    """Every item moved by its own random offset, or (``hard``) by ``most`` in every dimension."""
    return with_features(frames, _moved(F.lit(most)) if hard else _jittered(seed, most))


def disturb_label(frames: DataFrame, label: str, most: float, hard: bool, seed: str) -> DataFrame:
    return with_features(frames, _only([label], _moved(F.lit(most)) if hard else _jittered(seed, most)))


def translate(frames: DataFrame, labels: list[str], most: float, hard: bool, seed: str) -> DataFrame:
    """The items of the labels moved by one shared offset."""
    return with_features(frames, _only(labels, _moved(F.lit(most)) if hard else _shared(seed, most)))


def disturb_subsets(frames: DataFrame, labels: list[str], keep: float, most: float, hard: bool, seed: str) -> DataFrame:
    """Of each listed label the same number of hashed items, (1 - keep) * n / labels, moved by an offset its label shares."""
    quotas = frames.groupBy("frame_id").agg(F.floor(F.count("*") * (1 - keep) / len(labels)).alias("quota"))
    listed = frames.where(F.col("label").isin(labels)).select("frame_id", "item_id", "label")
    chosen = lowest(listed, ["frame_id", "label"], quotas, seed).where("low").select("frame_id", "item_id", F.lit(True).alias("hit"))
    sign = F.when(uniform(f"{seed}:sign", F.col("label")) < 0.5, -1.0).otherwise(1.0)
    moved = F.transform("features", lambda x: x + sign * most) if hard else F.transform("features", lambda x, i: x + (uniform(f"{seed}:offset", F.col("label"), i) * 2 - 1) * most)
    return frames.join(chosen, ["frame_id", "item_id"], "left").select("frame_id", "item_id", F.when(F.col("hit"), moved).otherwise(F.col("features")).alias("features"), "label")


def shift_all(frames: DataFrame, most: float, hard: bool, seed: str) -> DataFrame:
    sign = F.when(uniform(f"{seed}:sign") < 0.5, -1.0).otherwise(1.0)
    return with_features(frames, _moved(sign * most) if hard else _shared(seed, most))


def add_noise(frames: DataFrame, ids: DataFrame, most: float, seed: str) -> DataFrame:
    """The items whose (frame_id, item_id) is among ``ids`` get their own uniform noise."""
    hit = ids.select("frame_id", "item_id").distinct().withColumn("hit", F.lit(True))
    return frames.join(hit, ["frame_id", "item_id"], "left").select("frame_id", "item_id", F.when(F.col("hit"), _jittered(seed, most)).otherwise(F.col("features")).alias("features"), "label")


def overlap(frames: DataFrame, labels: list[str], means: DataFrame | None = None) -> DataFrame:
    """The listed clusters moved so that their means (given, or their centroids) coincide at the mean of the means."""
    means = (means if means is not None else centroids(frames)).where(F.col("label").isin(labels))
    cells = means.select("frame_id", F.posexplode("centroid").alias("pos", "x")).groupBy("frame_id", "pos").agg(F.avg("x").alias("x"))
    middle = cells.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("middle"))
    shift = means.join(middle, "frame_id").select("frame_id", "label", F.zip_with("middle", "centroid", lambda m, c: m - c).alias("shift"))
    # a row for each listed label
    return frames.join(F.broadcast(shift), ["frame_id", "label"], "left").select("frame_id", "item_id", F.when(F.col("shift").isNotNull(), F.zip_with("features", "shift", lambda x, s: x + s)).otherwise(F.col("features")).alias("features"), "label")


def scale_cluster(frames: DataFrame, labels: list[str], factor: float = 0.25, center: list[float] | None = None) -> DataFrame:
    """The listed clusters scaled about their centroids and put at ``center``, or left where they are."""
    c = centroids(frames.where(F.col("label").isin(labels)))
    goal = F.array(*map(F.lit, map(float, center))) if center else F.col("centroid")
    moved = F.zip_with(goal, F.zip_with("features", "centroid", lambda x, m: (x - m) * factor), lambda g, d: g + d)
    return frames.join(F.broadcast(c), ["frame_id", "label"], "left").select("frame_id", "item_id", F.when(F.col("centroid").isNotNull(), moved).otherwise(F.col("features")).alias("features"), "label")


def split_cluster(frames: DataFrame, label: str, offset: float, seed: str) -> DataFrame:
    """Two hashed halves of a cluster moved by minus and by plus the offset in every dimension; an odd item goes with the second."""
    listed = frames.where(F.col("label") == label).select("frame_id", "item_id")
    quotas = listed.groupBy("frame_id").agg(F.floor(F.count("*") / 2).alias("quota"))
    half = lowest(listed, ["frame_id"], quotas, seed)
    moved = F.when(F.col("low"), _moved(F.lit(-offset))).when(~F.col("low"), _moved(F.lit(offset))).otherwise(F.col("features"))
    return frames.join(half, ["frame_id", "item_id"], "left").select("frame_id", "item_id", moved.alias("features"), "label")


def first_dimensions(frames: DataFrame, dims: int | dict[int, int]) -> DataFrame:
    """The first numbers of every vector; ``dims`` for all frames, or for each (others stay whole)."""
    if isinstance(dims, int):
        return with_features(frames, F.slice("features", 1, dims))
    table = F.create_map(*(F.lit(x) for kv in dims.items() for x in kv)) if dims else F.create_map()
    return with_features(frames, F.slice("features", F.lit(1), F.coalesce(F.try_element_at(table, F.col("frame_id")), F.size("features")))) if dims else frames


def projected(frames: DataFrame, dims: int, turn: bool = False) -> DataFrame:
    """The first principal components of all items together. With as many as the frame has dimensions the projection would
    only turn the frame, which no distance notices, so the frame itself is returned unless ``turn`` is set."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = frames.agg(F.max(F.size("features"))).first()[0]
    if width is None or dims >= width and not turn:
        return frames
    rows = frames.withColumn("v", array_to_vector("features"))
    model = PCA(k=min(dims, width), inputCol="v", outputCol="w").fit(rows)
    return model.transform(rows).select("frame_id", "item_id", vector_to_array("w").alias("features"), "label")
