"""Mixing sources to target weights by subset-sum budget fitting.

Targets fill up by weight, none above a multiple of its source. A source is taken whole as often as its target holds
it; the rest is fitted exactly: documents are counted by length, every length gives its share, and a bounded knapsack over
the counts left closes the remaining budget. Which documents of a length are taken is decided by a seeded hash."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Words of budget that the knapsack closes; what lies above is taken by shares of the counts.
KNAPSACK = 1 << 16
#: Bits of the seeded hash that name its range, so that no length is ranked in one task; the hash has 63 in all.
SPREAD = 10
LOW = 63 - SPREAD
LAST = 2**63 - 1
#: Bytes of the plan, which has a row for each length of each source, up to which it is broadcast.
BROADCAST = 16 << 20


def n_words(text: Column) -> Column:
    """Words are runs of anything but ASCII white space."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), "\t\n\x0b\x0c\r ", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of all sizes by weight; none above ``most`` times its size, the excess goes to the others by weight."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(over)]
    return out


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length make the greatest sum that does not exceed the budget; a bit stands for a sum that can be made."""
    full, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for size in sorted(counts):
        left, lot = min(counts[size], budget // size), 1
        while left > 0:
            n = min(lot, left)
            steps.append((size, n, reach))
            reach = (reach | reach << size * n) & full
            left, lot = left - n, lot * 2
        if reach >> budget & 1:
            break
    out, at = {}, reach.bit_length() - 1
    for size, n, before in reversed(steps):
        if not before >> at & 1:
            out[size] = out.get(size, 0) + n
            at -= size * n
    return out


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sizes come as near below the budget as can be."""
    total = sum(s * n for s, n in counts.items())
    budget = min(max(budget, 0), total)
    share = max(0, budget - KNAPSACK // 2) / total if total else 0
    took = {s: int(n * share) for s, n in counts.items()}
    rest = budget - sum(s * n for s, n in took.items())
    for s in sorted(counts, reverse=True):
        if rest <= KNAPSACK:
            break
        n = min(counts[s] - took[s], (rest - KNAPSACK // 2) // s)
        took[s], rest = took[s] + n, rest - s * n
    more = knapsack({s: n - took[s] for s, n in counts.items() if n > took[s] and s <= rest}, min(rest, total))
    return {s: n + more.get(s, 0) for s, n in took.items()}


def _fitter(name: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(s): int(n) for s, n in zip(rows["size"], rows["n"], strict=True) if s > 0}
        whole, goal = sum(s * n for s, n in counts.items()), float(rows["target"].iloc[0])
        times = min(MOST, int(goal // whole)) if whole else 0
        budget = round(goal) - times * whole if times < MOST else 0
        extra = fit(counts, budget)
        sizes = rows["size"].astype("int64")
        return pd.DataFrame({name: rows[name], "size": sizes, "n": rows["n"], "times": np.int32(times), "extra": [extra.get(int(s), 0) for s in sizes]})

    return run


def mixed(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as the struct ``row``, with size, source_size, target and times: how often the mix takes the row.

    Sources stand in code point order, null last; ``weights`` repeat over them. A document is taken at most three times;
    one of size 0 is never taken. Of a length that is taken in part go exactly as many rows as its share says, by a seeded
    hash of the whole row; of rows that are equal throughout, as null or repeated ids may make them, some go and some
    stay. Reruns and other partitions give the same rows; an empty table gives none. The sources' sums go to the driver,
    a row each."""
    spark = docs.sparkSession
    names = docs.columns
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(*hashed)).bitwiseAND(F.lit(LAST))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), key.alias("k"), size.cast("long").alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("number"))
    keyed = materialize(keyed.withColumn("part", F.shiftright("h", LOW).cast("int")), "keyed")
    counts = materialize(keyed.groupBy("k", "size", "part").agg(F.count("*").alias("n")), "counts")
    sums = [(r["k"], int(r["s"])) for r in counts.groupBy("k").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()]
    sums.sort(key=lambda r: (r[0] == "n", r[0]))
    goal = targets([s for _, s in sums], [float(weights[i % len(weights)]) for i in range(len(sums))])
    goals = spark.createDataFrame([(k, s, t) for (k, s), t in zip(sums, goal, strict=True)], "k string, source_size long, target double")
    lengths = counts.groupBy("k", "size").agg(F.sum("n").alias("n")).join(F.broadcast(goals), "k")
    fitted = materialize(lengths.select("k", "size", "n", "target").groupBy("k").applyInPandas(_fitter("k"), "k string, size long, n long, times int, extra long"), "fitted")
    plan = lengths.select("k", "size", "source_size", "target").join(fitted.select("k", "size", "times", "extra"), ["k", "size"]).join(_cuts(keyed, counts, fitted), ["k", "size"], "left")
    plan = materialize(plan.withColumnRenamed("size", "length"), "plan")
    plan_bytes = plan.agg(F.sum(F.octet_length("k") + 64)).first()[0] or 0
    dealt = keyed.join(F.broadcast(plan) if plan_bytes <= BROADCAST else plan, (keyed["k"] == plan["k"]) & (keyed["size"] == plan["length"]))
    below = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("number") <= F.col("cut_number")))
    times = F.when(F.col("size") > 0, F.col("times") + F.coalesce(below, F.lit(False)).cast("int")).otherwise(0)
    return dealt.select("row", "size", "source_size", "target", times.alias("times"))


def _cuts(keyed: DataFrame, counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """(k, size, cut_h, cut_number): up to where a length's rows are taken once more, by (h, number); lengths without such are absent.

    Counts of hash ranges tell the range in which the cut lies, counts of that range's hashes the hash. Where only some of the
    rows of one hash are to go, which are equal rows, their counts by the task that numbered them tell the task."""
    upto = F.sum("n").over(Window.partitionBy("k", "size").orderBy("part"))
    parts = counts.select("k", "size", "part", "n", (upto - F.col("n")).alias("before")).join(fitted.where("extra > 0").select("k", "size", "extra"), ["k", "size"])
    last = parts.where("before < extra").groupBy("k", "size").agg(F.max_by(F.struct("part", "n", (F.col("extra") - F.col("before")).alias("take")), "part").alias("p")).select("k", "size", "p.*")
    last = materialize(last, "last")
    low = F.shiftleft(F.col("part").cast("long"), LOW)
    whole = last.where("take >= n").select("k", "size", (low + F.lit(2**LOW - 1)).alias("cut_h"), F.lit(LAST).alias("cut_number"))
    hashes = keyed.join(last.where("take < n").select("k", "size", "part", "take"), ["k", "size", "part"]).groupBy("k", "size", "h").agg(F.count("*").alias("n"), F.first("take").alias("take"))
    found = hashes.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "size").orderBy("h"))).where("upto >= take")
    found = found.groupBy("k", "size").agg(F.min_by(F.struct("h", "upto", (F.col("take") - F.col("upto") + F.col("n")).alias("take")), "h").alias("c"), F.first("take").alias("goal"))
    found = materialize(found.select("k", "size", "c.h", (F.col("c.upto") == F.col("goal")).alias("all"), "c.take"), "hashes")
    out = whole.union(found.where("all").select("k", "size", F.col("h").alias("cut_h"), F.lit(LAST)))
    some = found.where("not all").select("k", "size", "h", "take")
    if some.isEmpty():
        return out
    equal = materialize(keyed.select("k", "size", "h", "number", F.shiftright("number", 33).alias("task")).join(F.broadcast(some), ["k", "size", "h"]), "equal")  # one row a length
    tasks = equal.groupBy("k", "size", "h", "task").agg(F.count("*").alias("n"), F.first("take").alias("take"))
    tasks = tasks.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "size").orderBy("task"))).where("upto >= take")
    task = tasks.groupBy("k", "size", "h").agg(F.min_by(F.struct("task", (F.col("take") - F.col("upto") + F.col("n")).alias("nth")), "task").alias("t")).select("k", "size", "h", "t.*")
    inside = equal.join(task, ["k", "size", "h", "task"])
    at = inside.withColumn("at", F.row_number().over(Window.partitionBy("k", "size", "task").orderBy("number"))).where("at = nth")
    return out.union(at.select("k", "size", F.col("h"), F.col("number")))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, every row as often as the mix takes it."""
    taken = mixed(docs, n_words(F.col("text")), **options).where("times > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    return mixed(docs, F.col("words")).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
