"""Resharding by minimum-cost flow: from the bytes of the old shards and the capacities of the new ones, the block transfers
that move the fewest bytes; then only the affected files are written anew.

Documents lie in files by shard, and in blocks by a hash of their text, so equal texts share a block. The flow is solved
between shards; its amounts are then filled with whole blocks, largest first. A text whose copies outweigh a whole shard
cannot stay together under equal sizes; it alone is cut, by row, while the other texts of its block stay as they are."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..plans.storage import keep_path, shared_dir
from .common import materialize, spare, table

SHARDS, BLOCKS = 8, 8192
#: Pieces that a text heavier than a shard, or a block of many such bytes, is cut into for each shard that it fills.
PIECES = 16
#: Rows that one task numbers, at most; fewer where that leaves less than so many tasks.
RUN, TASKS, LEAST_RUN = 50_000, 4096, 200
#: A block above this part of a shard is placed before the flow, which then deals out the room that is left.
BIG = 0.05


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Amounts from each supply to each demand of least total cost, by successive shortest paths; the sums are equal."""
    m, n = len(supply), len(demand)
    flow, out, need = [[0] * n for _ in range(m)], list(supply), list(demand)
    while any(out) and any(need):
        far, via = [0.0 if out[i] else float("inf") for i in range(m)] + [float("inf")] * n, [-1] * (m + n)
        for _ in range(m + n):
            changed = False
            for i in range(m):
                for j in range(n):
                    if far[i] + cost[i][j] < far[m + j] - 1e-12:
                        far[m + j], via[m + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[m + j] - cost[i][j] < far[i] - 1e-12:
                        far[i], via[i], changed = far[m + j] - cost[i][j], m + j, True
            if not changed:
                break
        end = min((j for j in range(n) if need[j]), key=lambda j: far[m + j])
        path, at = [m + end], m + end
        while via[at] >= 0:
            at = via[at]
            path.append(at)
        path.reverse()
        amount = min(out[path[0]], need[end], *(flow[path[k + 1]][path[k] - m] for k in range(len(path) - 1) if path[k] >= m))
        for a, b in zip(path, path[1:], strict=False):
            if a < m:
                flow[a][b - m] += amount
            else:
                flow[b][a - m] -= amount
        out[path[0]] -= amount
        need[end] -= amount
    return flow


def capacities(total: int, shares: list[float]) -> list[int]:
    """Whole bytes by share that add up to the total."""
    out, done, weight = [], 0, 0.0
    for s in shares:
        weight += s
        upto = round(total * weight / sum(shares))
        out.append(upto - done)
        done = upto
    return out


def assign(blocks: list[tuple[int, int, int]], capacity: list[int]) -> tuple[dict[int, int], list[list[int]]]:
    """The new shard of each block (number, old shard, bytes), and the flow between old and new shards that it fills.

    Big blocks come first: each stays where it fits, else it goes where most room is. The flow deals out the others."""
    n = len(capacity)
    olds = max([o for _, o, _ in blocks], default=0) + 1
    where, load, room = {}, [0] * n, list(capacity)
    limit = BIG * max(capacity, default=0)
    for number, old, size in sorted((b for b in blocks if b[2] > limit), key=lambda b: (-b[2], b[0])):
        j = old if old < n and room[old] >= size else max(range(n), key=lambda x: (room[x], x == old, -x))
        where[number], load[j], room[j] = j, load[j] + size, room[j] - size
    small = [b for b in blocks if b[0] not in where]
    have = [0] * max(olds, 1)
    for _, o, size in small:
        have[o] += size
    left = [float(max(r, 0)) for r in room]
    flow = min_cost_flow(have, capacities(sum(have), left if any(left) else [1.0] * n), [[0.0 if i == j else 1.0 for j in range(n)] for i in range(len(have))])
    for i in range(len(have)):
        want = {j: flow[i][j] for j in range(n)}
        stay = i if i < n else None
        mine = sorted((b for b in small if b[1] == i), key=lambda b: (-b[2], b[0]))
        for number, _, size in mine:
            # what moves away is filled exactly as far as whole blocks allow; what is left stays or goes where most room is
            fits = [j for j in want if j != stay and want[j] >= size]
            j = stay if stay is not None and (not fits or size > max(want[x] for x in fits)) else max(fits or want, key=lambda x: (want[x], -x))
            if stay is not None and fits and size <= want[stay] and want[stay] >= max(want[x] for x in fits):
                j = stay
            where[number], want[j], load[j] = j, want[j] - size, load[j] + size
    _level(small, where, load, capacity)
    return where, flow


def _level(blocks: list[tuple[int, int, int]], where: dict[int, int], load: list[int], capacity: list[int], steps: int = 20_000) -> None:
    """Moves blocks from the shard most above its capacity to the one most below, while that levels them."""
    held: dict[int, list[tuple[int, int]]] = {j: [] for j in range(len(capacity))}
    for number, _, size in blocks:
        held[where[number]].append((size, number))
    for _ in range(steps):
        over = [load[j] - capacity[j] for j in range(len(capacity))]
        a, b = max(range(len(over)), key=lambda j: over[j]), min(range(len(over)), key=lambda j: over[j])
        gap = over[a] - over[b]
        best = max(((s, x) for s, x in held[a] if 0 < s < gap), key=lambda p: (min(p[0], gap - p[0]), -p[1]), default=None)
        if best is None or min(best[0], gap - best[0]) < 1:
            break
        held[a].remove(best)
        held[b].append(best)
        where[best[1]] = b
        load[a], load[b] = load[a] - best[0], load[b] + best[0]


@dataclass(frozen=True)
class Store:
    """Documents in files below path/<shard>=<n>, each row with a number of its own; the names don't clash with columns."""

    path: str
    schema: StructType
    shard: str
    number: str
    blocks: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields]).add(self.number, LongType()).add(self.shard, IntegerType())).parquet(self.path)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.option("compression", "zstd").partitionBy(self.shard).parquet(path)


@dataclass
class Plan:
    """Where each piece (block, cut) goes, and how rows tell their cut: light[block] cuts by text, heavy[text's hash] = (first
    cut, cuts) by row; runs[block]: parts that are numbered apart."""

    where: dict[tuple[int, int], int]
    moves: list[tuple[int, int, int, int]] = field(default_factory=list)  # block, cut, old shard, bytes
    light: dict[int, int] = field(default_factory=dict)
    heavy: dict[int, tuple[int, int]] = field(default_factory=dict)
    runs: dict[int, int] = field(default_factory=dict)

    def affected(self) -> list[int]:
        """Shards that rows leave or enter."""
        return sorted({s for block, cut, old, _ in self.moves if self.where[block, cut] != old for s in (old, self.where[block, cut])})


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def lay_out(docs: DataFrame, path: str, shards: int = SHARDS, blocks: int = BLOCKS) -> Store:
    """Writes ``docs``, all columns as they are, into ``shards`` shards: a text's block modulo their number."""
    names = docs.columns
    shard, number = spare("shard", names), spare("row_number", names)
    store = Store(path, docs.schema, shard, number, blocks)
    at = F.pmod(F.pmod(F.xxhash64(_text(docs)), F.lit(blocks)), F.lit(shards)).cast("int")
    store._write(docs.select("*", F.monotonically_increasing_id().alias(number), at.alias(shard)), path)
    return store


def _keyed(store: Store, rows: DataFrame) -> DataFrame:
    text = _text(rows)
    h = F.xxhash64(text)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"), F.pmod(h, F.lit(store.blocks)).cast("int").alias("block"), F.col(store.number).alias("number"), F.col(store.shard).alias("shard"))


def _with_cuts(spark: SparkSession, keyed: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``cut`` and ``run``. The tables joined have a row for each block and one for each text heavier than a shard."""
    rules = spark.createDataFrame([(b, plan.light.get(b, 1), n) for b, n in plan.runs.items()], "block int, cuts int, runs int")
    out = keyed.join(F.broadcast(rules), "block", "left")
    cut = F.pmod(F.shiftrightunsigned("h", 32), F.coalesce("cuts", F.lit(1))).cast("int")
    spread = F.xxhash64(F.lit("part"), "doc_id", "number")
    if plan.heavy:
        heavy = spark.createDataFrame([(h, first, n) for h, (first, n) in plan.heavy.items()], "h long, first int, pieces int")
        out = out.join(F.broadcast(heavy), "h", "left")
        cut = F.coalesce(F.col("first") + F.pmod(spread, F.col("pieces")).cast("int"), cut)
    return out.withColumn("cut", cut).withColumn("run", F.pmod(F.shiftrightunsigned(spread, 20), F.coalesce("runs", F.lit(1))).cast("int"))


def plan_for(spark: SparkSession, store: Store, shares: list[float] | None = None) -> Plan:
    """The transfers that bring the shards to ``shares`` of all bytes (UTF-8 of the text, plus 1).

    The driver gets the sizes of at most ``blocks`` blocks, of the texts heavier than a shard, and of their pieces."""
    shares = shares or [1.0] * SHARDS
    keyed = _keyed(store, store.read(spark)).select("doc_id", "size", "h", "block", "number", "shard")
    sums = [(r["block"], r["shard"], r["b"], r["n"]) for r in keyed.groupBy("block", "shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()]
    size: dict[int, int] = {}
    count: dict[int, int] = {}
    for block, _, b, n in sums:
        size[block], count[block] = size.get(block, 0) + b, count.get(block, 0) + n
    capacity = capacities(sum(size.values()), shares)
    limit = max([c for c in capacity if c], default=1)
    run = min(RUN, max(LEAST_RUN, sum(count.values()) // TASKS))
    plan = Plan({}, runs={block: -(-n // run) for block, n in count.items()})
    over = sorted(block for block, b in size.items() if b > limit)
    pieces = [(block, 0, old, b) for block, old, b, _ in sums]
    if over:
        inside = keyed.where(F.col("block").isin(over))
        big = inside.groupBy("block", "h").agg(F.sum("size").alias("b")).where(F.col("b") > limit).orderBy("h").collect()
        plan.heavy = {r["h"]: (1_000_000 * (i + 1), PIECES * -(-r["b"] // limit)) for i, r in enumerate(big)}
        for block in over:
            rest = size[block] - sum(r["b"] for r in big if r["block"] == block)
            if rest > limit:
                plan.light[block] = PIECES * -(-rest // limit)
        cut = _with_cuts(spark, inside, plan).groupBy("block", "cut", "shard").agg(F.sum("size").alias("b")).collect()
        pieces = [p for p in pieces if p[0] not in set(over)] + [(r["block"], r["cut"], r["shard"], r["b"]) for r in cut]
    pieces.sort()
    # a piece that earlier transfers left in several shards counts for the one that holds most of it
    home: dict[tuple[int, int], tuple[int, int]] = {}
    total: dict[tuple[int, int], int] = {}
    for block, c, old, b in pieces:
        home[block, c] = max(home.get((block, c), (0, 0)), (b, -old))
        total[block, c] = total.get((block, c), 0) + b
    names = sorted(home)
    where, _ = assign([(i, -home[p][1], total[p]) for i, p in enumerate(names)], capacity)
    plan.where, plan.moves = {p: where[i] for i, p in enumerate(names)}, pieces
    return plan


def rewrite(spark: SparkSession, store: Store, plan: Plan) -> list[int]:
    """Writes the files of those shards anew that rows leave or enter, and returns their numbers.

    All rows are kept, whatever their ids. New files are written aside and then take the place of the old ones; a shard that
    ends empty has none. Other shards' files are not touched."""
    affected = plan.affected()
    if not affected:
        return affected
    rows = store.read(spark).where(F.col(store.shard).isin(affected))
    names = [f.name for f in store.schema.fields] + [store.number]
    goes = spark.createDataFrame([(b, c, s) for (b, c), s in plan.where.items()], "block int, cut int, goes int")
    moved = _with_cuts(spark, _beside(store, rows, names), plan).join(F.broadcast(goes), ["block", "cut"])
    out = moved.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)), F.col("goes").alias(store.shard))
    aside, old = f"{store.path}/_next-{uuid.uuid4().hex}", f"{store.path}/_old-{uuid.uuid4().hex}"
    store._write(out, aside)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(store.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(old))
    for s in affected:
        here = path(f"{store.path}/{store.shard}={s}")
        if fs.exists(here):
            fs.rename(here, path(f"{old}/{store.shard}={s}"))
        fresh = path(f"{aside}/{store.shard}={s}")
        if fs.exists(fresh):
            fs.rename(fresh, here)
    fs.delete(path(old), True)
    fs.delete(path(aside), True)
    return affected


def _beside(store: Store, rows: DataFrame, names: list[str]) -> DataFrame:
    """The whole row as a struct, beside what tells its piece."""
    h = F.xxhash64(_text(rows))
    return rows.select(F.struct(*(rows[c].alias(f"c{i}") for i, c in enumerate(names))).alias("row"), h.alias("h"), F.pmod(h, F.lit(store.blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col(store.number).alias("number"))


def numbered(spark: SparkSession, store: Store, plan: Plan) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row as it lies now; slots count from 0 without gaps in each shard."""
    rows = _with_cuts(spark, _keyed(store, store.read(spark)), plan).select("doc_id", "size", "text_crc32", "number", "shard", "block", "cut", "run")
    rows = materialize(rows, "placed")
    part = ["shard", "block", "cut", "run"]
    counts = rows.groupBy(*part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block", "cut", "run").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(counts.select(*part, F.coalesce(before, F.lit(0)).alias("start")), "starts")
    at = F.row_number().over(Window.partitionBy(*part).orderBy("doc_id", "number")) - 1
    out = rows.withColumn("at", at).join(F.broadcast(starts) if starts.count() <= 200_000 else starts, part)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def reshard(docs: DataFrame, shares: list[float] | None = None, blocks: int = BLOCKS, old_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``, as it lies in the files after the transfers.

    The bytes (UTF-8 of the text, plus 1) of the new shards come as near to their shares as whole blocks allow. Equal texts
    share a shard unless one text's copies outweigh a whole shard. Slots count from 0 without gaps in each shard, by
    block and doc_id. A null text is the empty one; ids may repeat or be null, and columns may have any names; an
    empty table gives no rows."""
    spark = docs.sparkSession
    store = lay_out(docs, keep_path(spark, f"{shared_dir(spark)}/weftline-shards-{uuid.uuid4().hex}"), old_shards, blocks)
    plan = plan_for(spark, store, shares)
    rewrite(spark, store, plan)
    return numbered(spark, store, plan)


def op8_resharding(spark, sf_dir: str) -> DataFrame:
    got = reshard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
