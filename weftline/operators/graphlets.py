"""Graphlets of 3 to 5 nodes: exact counts, enumeration, types, and each item's frequency distribution.

Sets grow by joins: every connected set of k nodes holds a connected one of k - 1. Types come from the sorted degrees
within a set; two signatures stand for two types each, which the sum over edges of the ends' degrees' product parts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import write_table
from . import profiles
from .graph import both_ways, components, degrees
from .walks import LANE, LANES, Lanes

#: Sorted degrees within a graphlet, its type; 12223 is 15 and 22233 is 19 unless their sum is that of PARTED.
TYPES = {
    "112": 0, "222": 1,
    "1122": 2, "1113": 3, "2222": 4, "1223": 5, "2233": 6, "3333": 7,
    "11222": 8, "11123": 9, "11114": 10, "11233": 11, "12223": 15, "11224": 13, "22222": 14, "12234": 16, "22224": 17,
    "12333": 18, "22233": 19, "22244": 21, "13334": 22, "22334": 23, "23333": 24, "23344": 25, "33334": 26, "33444": 27, "44444": 28,
}
#: Signature, sum over edges of the product of the ends' degrees, type.
PARTED = [("12223", 24, 12), ("22233", 37, 20)]
N_TYPES = 29
#: Above this many paths of two links (the sum of all degrees squared), which the counting task holds, a frame is sampled instead.
MOST_SETS = 10**9


#: Items for which a component's walk gets a further task, and its tasks at most; together they are as long as one would be.
WALK, MOST_WALKS = 1024, 16
#: Numbers of components that share a task if they are smaller.
TOGETHER = 4096


def adjacency(edges: DataFrame) -> DataFrame:
    """(frame_id, item_id, near): the sorted neighbours."""
    return both_ways(edges).groupBy("frame_id", F.col("u").alias("item_id")).agg(F.array_sort(F.collect_list("v")).alias("near"))


def typed_connected_sets(edges: DataFrame, largest: int = 5) -> DataFrame:
    """(frame_id, nodes, gtype): every connected set of 3 to ``largest`` items, once, its nodes sorted, with its type.

    A set carries its inner edges and the items around it, so it grows by one join with the newcomer's neighbours, and its
    type follows without another."""
    near = write_table(adjacency(edges), "near")
    of = lambda x: near.select("frame_id", F.col("item_id").alias(x), F.col("near").alias(f"near_{x}"))
    nodes = F.array("u", "v")
    sets = edges.join(of("u"), ["frame_id", "u"]).join(of("v"), ["frame_id", "v"])
    sets = sets.select("frame_id", nodes.alias("nodes"), F.array(F.struct("u", "v")).alias("inner"), F.array_except(F.array_union("near_u", "near_v"), nodes).alias("around"))
    out = None
    for size in range(3, largest + 1):
        grown = sets.select("*", F.explode("around").alias("item_id")).join(near, ["frame_id", "item_id"])
        new = F.array_sort(F.concat("nodes", F.array("item_id")))
        inner = F.concat("inner", F.transform(F.array_intersect("near", "nodes"), lambda n: F.struct(n.alias("u"), F.col("item_id").alias("v"))))
        grown = grown.select("frame_id", new.alias("nodes"), inner.alias("inner"), F.array_except(F.array_union("around", "near"), new).alias("around"))
        if size < largest:
            sets = write_table(grown.dropDuplicates(["frame_id", "nodes"]), "sets")
            typed = sets.select("frame_id", "nodes", _type_of("nodes", "inner").alias("gtype"))
        else:
            typed = grown.select("frame_id", "nodes", _type_of("nodes", "inner").alias("gtype")).distinct()
        out = typed if out is None else out.union(typed)
    return out


def connected_sets(edges: DataFrame, largest: int = 5) -> DataFrame:
    """(frame_id, nodes): every connected set of 3 to ``largest`` items, once, its nodes sorted."""
    return typed_connected_sets(edges, largest).select("frame_id", "nodes")


def _type_of(nodes: str, inner: str) -> Column:
    """The type of a set with its inner edges (u, v)."""
    degree = lambda n: F.size(F.filter(inner, lambda e: (e["u"] == n) | (e["v"] == n)))
    signature = F.array_join(F.array_sort(F.transform(nodes, lambda n: degree(n).cast("string"))), "")
    products = F.aggregate(inner, F.lit(0), lambda a, e: a + degree(e["u"]) * degree(e["v"]))
    return F.get(F.transform(F.array(signature), lambda s: graphlet_type(s, products)), F.lit(0))


def graphlet_type(signature: Column, products: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    out = F.try_element_at(table, signature)
    for sig, total, kind in PARTED:
        out = F.when((signature == sig) & (products == total), F.lit(kind)).otherwise(out)
    return out


def type_within_size(gtype: Column) -> Column:
    """Types numbered from 0 within graphlets of 3, of 4 and of 5 nodes."""
    return F.when(gtype < 2, gtype).when(gtype < 8, gtype - 2).otherwise(gtype - 8)


def typed_sets(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame_id, nodes, gtype) of connected sets."""
    near = adjacency(edges)
    inside = sets.select("frame_id", "nodes", F.explode("nodes").alias("item_id")).join(near, ["frame_id", "item_id"])
    inside = inside.select("frame_id", "nodes", F.struct("item_id", F.array_intersect("near", "nodes").alias("in")).alias("m"))
    rows = inside.groupBy("frame_id", "nodes").agg(F.collect_list("m").alias("m"))
    signature = F.array_join(F.array_sort(F.transform("m", lambda x: F.size(x["in"]).cast("string"))), "")
    # each edge is seen from both ends
    degree = lambda n: F.aggregate("m", F.lit(0), lambda a, y: a + F.when(y["item_id"] == n, F.size(y["in"])).otherwise(0))
    products = F.aggregate("m", F.lit(0), lambda a, x: a + F.size(x["in"]) * F.aggregate(x["in"], F.lit(0), lambda b, n: b + degree(n)))
    parted = F.when(F.col("signature").isin([s for s, _, _ in PARTED]), (products / 2).cast("int")).otherwise(0)
    return rows.select("frame_id", "nodes", "m", signature.alias("signature")).select("frame_id", "nodes", graphlet_type(F.col("signature"), parted).alias("gtype"))


def type_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("frame_id", "gtype").agg(F.count("*").alias("n"))


def item_counts(typed: DataFrame) -> DataFrame:
    """(frame_id, item_id, gtype, cnt): in how many graphlets of a type an item takes part."""
    return typed.select("frame_id", F.explode("nodes").alias("item_id"), "gtype").groupBy("frame_id", "item_id", "gtype").agg(F.count("*").alias("cnt"))


def exact_counts(edges: DataFrame) -> DataFrame:
    """(frame_id, item_id, gtype, cnt) as :func:`item_counts` of all connected sets, without listing sets: see
    :mod:`weftline.operators.profiles`. One task holds a frame's edges and paths of two links; ValueError if these are too many."""
    for r in degrees(edges).groupBy("frame_id").agg(F.sum(F.col("degree") * F.col("degree")).alias("n")).collect():  # a row a frame
        if r["n"] > MOST_SETS:
            raise ValueError(f"frame {r['frame_id']} has {r['n']} paths of two links; use sampled_counts")
    return edges.select("frame_id", "u", "v").groupBy("frame_id").applyInArrow(_count, "frame_id int, item_id long, gtype int, cnt long")


def _count(rows: pa.Table) -> pa.Table:
    u, v = (rows.column(c).to_numpy() for c in "uv")
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    counts = profiles.item_counts(len(ids), at[: len(u)].astype(np.int64), at[len(u) :].astype(np.int64), _shape, _joined)
    hits = [(kind, np.flatnonzero(x), x) for kind, x in sorted(counts.items())]
    item, kinds = np.concatenate([ids[i] for _, i, _ in hits]), np.concatenate([np.full(len(i), k, np.int32) for k, i, _ in hits])
    frame = pa.array(np.full(len(item), rows.column("frame_id")[0].as_py(), np.int32))
    return pa.table({"frame_id": frame, "item_id": pa.array(item), "gtype": pa.array(kinds), "cnt": pa.array(np.concatenate([x[i] for _, i, x in hits]))})


def type_totals(counts: DataFrame) -> DataFrame:
    """(frame_id, gtype, n) of item counts, as :func:`type_counts` of the sets: a graphlet counts once for each of its nodes."""
    nodes = "CASE WHEN gtype < 2 THEN 3 WHEN gtype < 8 THEN 4 ELSE 5 END"
    return counts.groupBy("frame_id", "gtype").agg(F.sum("cnt").alias("n")).select("frame_id", "gtype", F.expr(f"n div ({nodes})").alias("n"))


def layered(counts: DataFrame, layers: DataFrame, levels: int | None = None) -> DataFrame:
    """(frame_id, item_id, layer, gtype, x): counts summed over each breadth-first layer of an item, as shares of the layer's sum."""
    sums = layers.join(counts, ["frame_id", "item_id"]).groupBy("frame_id", F.col("seed").alias("item_id"), "layer", "gtype").agg(F.sum("cnt").alias("cnt"))
    total = sums.groupBy("frame_id", "item_id", "layer").agg(F.sum("cnt").alias("total"))
    return sums.join(total, ["frame_id", "item_id", "layer"]).select("frame_id", "item_id", "layer", "gtype", (F.col("cnt") / F.col("total")).alias("x"))


def dense(features: DataFrame, levels: int = 1) -> DataFrame:
    """(frame_id, item_id, vector): the shares as one array of 29 numbers a layer."""
    at = (F.col("layer") * N_TYPES + F.col("gtype")).cast("int")
    rows = features.groupBy("frame_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "x"))).alias("m"))
    return rows.select("frame_id", "item_id", F.transform(F.sequence(F.lit(0), F.lit(N_TYPES * levels - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def _shape(nodes: frozenset[int], near: dict[int, set[int]]) -> int:
    degree = {n: len(near[n] & nodes) for n in nodes}
    signature = "".join(map(str, sorted(degree.values())))
    products = sum(degree[a] * degree[b] for a in nodes for b in near[a] & nodes) // 2
    return next((kind for s, total, kind in PARTED if (s, total) == (signature, products)), TYPES[signature])


def _joined(nodes: frozenset[int], near: dict[int, set[int]]) -> bool:
    todo, seen = [next(iter(nodes))], set()
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += near[n] & nodes - seen
    return len(seen) == len(nodes)


def _moves(nodes: frozenset[int], near: dict[int, set[int]]) -> list[frozenset[int]]:
    """Sets one step away: a node dropped, swapped or added, each by each neighbour of what stays; 3 to 5 nodes, connected.

    A swap may bring the dropped node back, and then the walk stays where it is."""
    out = []
    for gone in sorted(nodes):
        core = nodes - {gone}
        whole = _joined(core, near)
        if whole and len(core) >= 3:
            out.append(core)
        around = set().union(*(near[n] for n in core)) - core
        out += [s for n in sorted(around) if _joined(s := core | {n}, near)]
    if len(nodes) < 5:
        out += [nodes | {n} for n in sorted(set().union(*(near[n] for n in nodes)) - nodes)]
    return out


class _Steps:
    """The same sets in the same order as :func:`_moves`, counted without building them: where what stays is whole, each item
    around it fits; where it isn't, only items that all its pieces have around them."""

    def __init__(self, nodes: frozenset[int], near: dict[int, set[int]]):
        self.nodes, self.kinds = nodes, []
        for gone in sorted(nodes):
            core = nodes - {gone}
            pieces = _pieces(core, near)
            if len(pieces) == 1 and len(core) >= 3:
                self.kinds.append((1, core, None))
            fits = set.intersection(*(set().union(*(near[n] for n in piece)) for piece in pieces)) - core
            self.kinds.append((len(fits), core, fits))
        if len(nodes) < 5:
            fits = set().union(*(near[n] for n in nodes)) - nodes
            self.kinds.append((len(fits), nodes, fits))
        self.count = sum(k[0] for k in self.kinds)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, at: int) -> frozenset[int]:
        for n, core, fits in self.kinds:
            if at < n:
                return core if fits is None else core | {sorted(fits)[at]}
            at -= n
        raise IndexError(at)


def _pieces(nodes: frozenset[int], near: dict[int, set[int]]) -> list[set[int]]:
    """The nodes by the pieces that edges among them make."""
    out, left = [], set(nodes)
    while left:
        piece, todo = set(), [left.pop()]
        while todo:
            n = todo.pop()
            piece.add(n)
            new = near[n] & left if len(near[n]) < len(left) else left & near[n]
            left -= new
            todo += new
        out.append(piece)
    return out


def _first(at: int, near: Callable[[int], list[int]]) -> list[int]:
    """The item and its nearest by links, 4 in all if there are as many."""
    reached, k = [at], 0
    while len(reached) < 4 and k < len(reached):
        reached += [n for n in near(reached[k]) if n not in reached][: 4 - len(reached)]
        k += 1
    return reached


def _walk(seed: int, steps: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frame, alone, part, walk, walks = (int(rows[c].iloc[0]) for c in ("frame_id", "alone", "part", "walk", "walks"))
        ids, ends = np.unique(rows[["u", "v"]].to_numpy(), return_inverse=True)
        u, v = ends.reshape(-1, 2).T.astype(np.int64)
        both = np.sort(np.concatenate([u * len(ids) + v, v * len(ids) + u]))
        at, col = np.searchsorted(both, np.arange(len(ids) + 1) * len(ids)), both % len(ids)
        of = np.zeros(len(ids), np.int64)
        of[u] = of[v] = rows["component"].to_numpy()
        order = np.argsort(of, kind="stable")
        lengths, sets = [], []
        for items in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            share, total = items[walk * len(items) // walks : (walk + 1) * len(items) // walks], steps * len(items)
            total = total * (walk + 1) // walks - total * walk // walks
            lanes = max(1, min(LANES, len(share) // LANE))
            for k in range(lanes if len(items) >= 3 else 0):
                sets.append(_first(int(share[k * len(share) // lanes]), lambda n: col[at[n] : at[n + 1]].tolist()))
                lengths.append(total * (k + 1) // lanes - total * k // lanes)
        far = np.argsort(-np.array(lengths, np.int64), kind="stable")
        counts = np.zeros((len(ids), N_TYPES), np.int64)
        if len(far):
            rng = np.random.default_rng([seed, frame, abs(part), int(alone), walk])
            counts = Lanes(len(ids), u, v, [sets[k] for k in far], _shape).walk(np.array(lengths, np.int64)[far], N_TYPES, rng)
        item, kind = np.nonzero(counts)
        return pd.DataFrame({"frame_id": np.full(len(item), frame, np.int32), "item_id": ids[item].astype(np.int64), "gtype": kind.astype(np.int32), "cnt": counts[item, kind]})

    return run


def sampled_counts(edges: DataFrame, steps: int = 1000, seed: int = 0) -> DataFrame:
    """Item counts along Metropolis-Hastings walks over the graphlets of each component, together ``steps`` times its items long.

    The walks' law is uniform over connected sets of 3 to 5 nodes. A component's length is shared by walks that start at items
    spread over it, LANE items or more each (see :class:`weftline.operators.walks.Lanes`); those of a large component by several
    tasks, each with the component's edges, while small components of near numbers share one."""
    member = components(edges)
    walks = F.greatest(F.lit(1), F.least(F.lit(MOST_WALKS), F.expr(f"count(1) div {WALK}"))).cast("int")
    part = F.when(F.count("*") >= WALK, F.col("component")).otherwise(F.expr(f"component div {TOGETHER}"))
    sizes = member.groupBy("frame_id", "component").agg(walks.alias("walks"), part.alias("part"), (F.count("*") >= WALK).alias("alone"))
    rows = edges.join(member.withColumnRenamed("item_id", "u"), ["frame_id", "u"]).select("frame_id", "component", "u", "v").where("u <> v").distinct()
    rows = rows.join(sizes, ["frame_id", "component"]).select("*", F.explode(F.sequence(F.lit(0), F.col("walks") - 1)).alias("walk"))
    # by number, or the few bytes of all walks would be put in one task
    rows = rows.repartition(8 * edges.sparkSession.sparkContext.defaultParallelism, "frame_id", "alone", "part", "walk")
    walked = rows.groupBy("frame_id", "alone", "part", "walk").applyInPandas(_walk(seed, steps), "frame_id int, item_id long, gtype int, cnt long")
    return walked.groupBy("frame_id", "item_id", "gtype").agg(F.sum("cnt").alias("cnt"))
