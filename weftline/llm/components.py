"""Components of links between document or vector ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stars


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) of links (a, b); see :func:`weftline.operators.stars.components`."""
    return stars.components(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
