"""Connected components by alternating star operations, for links of any number and of any skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import release, write_table


def _step(edges: DataFrame, by: list[str]) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.select(*by, "a", "b").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    least = write_table(both.groupBy(*by, "a").agg(F.least("a", F.min("b")).alias("m")), "least")
    large = both.where("b > a").join(least, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    large = write_table(large.distinct(), "large")
    low = write_table(large.groupBy(*by, "a").agg(F.min("b").alias("m")), "low")
    ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
    out = write_table(large.join(low, [*by, "a"]).select(*by, ends).select(*by, "e.*").where("a > b").distinct(), "stars")
    release(least, large, low)
    return out


def _state(edges: DataFrame, by: list[str]) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, by: list[str] | None = None, rounds: int = 60) -> DataFrame:
    """Rows (by..., id, component) for every id in a link (by..., a, b) to another; component is the smallest id that links
    reach within the same values of ``by``.

    Large-star and small-star steps alternate until nothing changes, and never make more edges than there were links.
    Minima are partial aggregates and the joins are plain ones of written tables, which adaptive execution splits where
    one id has very many links. Null ids and self links are left out; repeated links don't matter."""
    by = by or []
    edges = links.where("a is not null and b is not null and a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = write_table(edges.distinct(), "stars")
    before = _state(edges, by)
    for _ in range(rounds if before[0] else 0):
        after = _step(edges, by)
        release(edges)
        edges, now = after, _state(after, by)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(*by, F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(*by, F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
