"""Vector kernels and distances as Column builders over array<double>, and hash-based random numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l1_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def rbf(a: Column, b: Column, delta: float = 1.0) -> Column:
    return F.exp(-squared_l2(a, b) / (2 * delta * delta))


def laplacian(a: Column, b: Column, delta: float = 1.0) -> Column:
    return F.exp(-l1_distance(a, b) / delta)


KERNELS: dict[str, Callable[..., Column]] = {"cosine": cosine, "rbf": rbf, "laplacian": laplacian}


def kernel(kind: str, a: Column, b: Column) -> Column:
    """Vectors of unequal length raise an error at run time."""
    checked = F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
    return KERNELS[kind](checked, b)


def l1_normalised(a: Column) -> Column:
    """Divided by its sum, unless that is 0."""
    total = _sum(a)
    return F.when(total != 0, F.transform(a, lambda x: x / total)).otherwise(a)


def argsort(a: Column) -> Column:
    """The positions of the values in rising order, equal ones by position."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def uniform(seed: str, *parts: Column) -> Column:
    """A number of [0, 1) that only the seed and the parts decide."""
    text = F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def normal(seed: str, *parts: Column) -> Column:
    """A standard normal number by Box and Muller's transform of two uniform ones."""
    u, v = uniform(f"{seed}:u", *parts), uniform(f"{seed}:v", *parts)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(6.283185307179586) * v)
