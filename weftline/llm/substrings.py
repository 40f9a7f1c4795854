"""Substring deduplication on a De Bruijn graph of token windows.

A window of 13 words is an edge between two nodes, the 12 words that it begins and ends with. An edge can repeat only if its
minimizer does, the least hash of the shorter runs of words in it; so minimizers are joined first, a fifth of the edges,
and the edges of repeated ones after them. The join gives each repeated edge its source: the smallest document and the
place where it stands there, which is the edge's name from then on. A document's edges with consecutive names in one cell of
its source are a piece, with a cryptographic digest of its words; pieces are the rows that the graph is compacted from.

Compaction runs in Spark joins: pieces of one cell merge, are cut where some document turns off to another name, and the parts
are linked where they touch or where a document goes from one to the other. A link between a part with one way out and one
with one way in doesn't branch; along such links parts grow to paths by joins of doubling reach. The pieces of a document that
follow one path become one span, and the words under spans go. Before that, every piece is looked up at its source's
coordinates and compared by its digest, so no word goes on the strength of a hash table's key.

Documents travel in blocks. A block sends each distinct hash once to the bucket that its leading bits name, so a passage that
very many documents share costs one entry a block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _blocks, _pack, _planes, _unpack, _unplanes
from .common import buckets_for, dealt, free_shuffles, materialize, release, replayable, texts, tune
from .textkernel import SPACED, U, Hasher, buffers, mix, words

WINDOW, RUN = 13, 5
#: Places of a source that one piece stays within.
CELL = 512
#: Bytes of text in a block, but for a block of one longer text.
BLOCK = 4 << 20
#: Pieces of one source that one row asks it for, and rows of a table up to which it is broadcast.
ASKS, FEW = 200, 100_000
TEXT, MINIMIZERS, EDGES = 0, 1, 2


def _planes8(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).reshape(-1)


def _unplanes8(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted hashes as planes of their differences."""
    return _planes8(np.diff(x, prepend=U(0)))


def _unsteps(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(_unplanes8(raw), dtype=np.uint64)


class Block:
    """The words of some documents and, once indexed, their edges and minimizers; ids of None take no part in edges."""

    def __init__(self, keys: list[int | None], data: np.ndarray, offs: np.ndarray) -> None:
        self.keys = keys
        # a line end behind each text, so that white space stands behind every word
        self.data, offs = np.insert(data, offs[1:], 10), offs + np.arange(len(offs))
        self.starts, self.ends, self.row = words(self.data, offs, SPACED)
        self.first = np.searchsorted(self.row, np.arange(len(keys) + 1))  # of each document's words

    def index(self, window: int, run: int) -> Block:
        hasher = Hasher()
        h = hasher.words(self.data, self.starts, self.ends)
        n = max(0, len(self.row) - window + 1)
        known = np.array([k is not None for k in self.keys], bool)
        ok = (self.row[:n] == self.row[window - 1 :]) & known[self.row[:n]] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(ok)  # the words at which an edge begins
        # 96 bits name an edge
        self.edge = hasher.windows(h, window)[self.at] if n else np.zeros(0, np.uint64)
        self.check = (Hasher(7).windows(h, window)[self.at] >> U(32)).astype(np.uint32) if n else np.zeros(0, np.uint32)
        runs = hasher.windows(h, run)
        least = runs[:n].copy() if n else runs[:0]
        for j in range(1, window - run + 1):
            np.minimum(least, runs[j : j + n], out=least)
        self.minimizer = mix(least[self.at], 9)  # least ones lie low: mixed, they spread over the buckets
        self.doc = np.array([-1 if k is None else k for k in self.keys], np.int64)[self.row[self.at]] if len(self.keys) else np.zeros(0, np.int64)
        return self

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space behind each, and where each begins there; one place more at the end."""
        inside = SPACED[self.data]
        inside[self.ends] = True
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts + 1, out=at[1:])
        raw = self.data[inside]
        raw[at[1:] - 1] = 32
        return raw, at

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ones, and whether two documents of the block hold it."""
        order = np.argsort(self.minimizer, kind="stable")
        m, d = self.minimizer[order], self.doc[order]
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return m, np.zeros(0, bool)
        return m[at], np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)

    def sources(self, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the edges whose minimizer is among ``repeated`` (sorted): their numbers, the distinct edge of each, and the
        distinct edges with the smallest document and place in this block."""
        spot = np.minimum(np.searchsorted(repeated, self.minimizer), max(len(repeated) - 1, 0))
        use = np.flatnonzero(repeated[spot] == self.minimizer) if len(repeated) else np.zeros(0, np.int64)
        place = self.at[use] - self.first[self.row[self.at[use]]]
        order, new = _ranked(self.edge[use], self.check[use], self.doc[use], place)
        which = np.empty(len(use), np.int64)
        which[order] = np.cumsum(new) - 1
        lead = order[new]
        return use, which, self.edge[use][lead], self.check[use][lead], self.doc[use][lead], place[lead]


def _ranked(edge: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by edge, document and place, and where in it an edge is met first."""
    order = np.lexsort((place, doc, check, edge))
    e, c = edge[order], check[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (c[1:] != c[:-1])
    return order, new


def _slices(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """The range of the sorted hashes that each bucket gets."""
    to = sorted_hashes // U(2**64 // buckets + 1)
    edge = np.searchsorted(to, np.arange(buckets + 1).astype(np.uint64))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), int(edge[b]), int(edge[b + 1])


def _emit_minimizers(most: int, buckets: int, window: int, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (key, text) in _blocks(batches, most):
            m, many = Block(key.to_pylist(), *buffers(text)).index(window, run).minimizers()
            for b, lo, hi in _slices(m, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block]), pa.array([_pack(_steps(m[lo:hi]), np.packbits(many[lo:hi]))], pa.binary())], names=["bucket", "block", "data"])

    return go


def _join_minimizers(group: pa.Table) -> pa.Table:
    """Tells each block which of its minimizers two documents hold, here or there."""
    got = [_unpack(x.as_py(), "u1", "u1") for x in group.column("data")]
    hashes = [_unsteps(h) for h, _ in got]
    many = [np.unpackbits(m, count=len(h)).astype(bool) for (_, m), h in zip(got, hashes, strict=True)]
    everything, back, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    repeated = count > 1
    repeated[back[np.concatenate(many)]] = True
    out = [_pack(_steps(h[r])) for h, r in zip(hashes, np.split(repeated[back], np.cumsum([len(h) for h in hashes])[:-1]), strict=True)]
    return pa.table({"block": group.column("block"), "kind": pa.array([MINIMIZERS] * len(out), pa.int32()), "bucket": group.column("bucket"), "keys": pa.nulls(len(out), pa.list_(pa.int64())), "data": pa.array(out, pa.binary())})


def _texts(most: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (key, text) in _blocks(batches, most):
            data, offs = buffers(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([TEXT], pa.int32()), pa.array([0], pa.int32()), pa.array([key.to_pylist()], pa.list_(pa.int64())), pa.array([_pack(offs.astype("<i8"), data)], pa.binary())],
                names=["block", "kind", "bucket", "keys", "data"],
            )

    return go


def _opened(group: pa.Table) -> tuple[Block, np.ndarray, dict[int, bytes]]:
    """A block, its repeated minimizers in order, and the edges' replies by bucket."""
    kinds, buckets, data = group.column("kind").to_pylist(), group.column("bucket").to_pylist(), group.column("data")
    (main,) = (i for i, k in enumerate(kinds) if k == TEXT)
    offs, text = _unpack(data[main].as_py(), "<i8", "u1")
    found = sorted((buckets[i], i) for i, k in enumerate(kinds) if k == MINIMIZERS)
    repeated = [_unsteps(_unpack(data[i].as_py(), "u1")[0]) for _, i in found]
    replies = {buckets[i]: data[i].as_py() for i, k in enumerate(kinds) if k == EDGES}
    return Block(group.column("keys")[main].as_py(), text, offs), np.concatenate(repeated) if repeated else np.zeros(0, np.uint64), replies


def _emit_edges(buckets: int, window: int, run: int):
    def go(group: pa.Table) -> pa.Table:
        block, repeated, _ = _opened(group)
        _, _, edge, check, doc, place = block.index(window, run).sources(repeated)
        to, data = [], []
        for b, lo, hi in _slices(edge, buckets):
            to.append(b)
            data.append(_pack(_steps(edge[lo:hi]), _planes(check[lo:hi]), _planes8(doc[lo:hi]), _planes(place[lo:hi])))
        return pa.table({"bucket": pa.array(to, pa.int32()), "block": pa.array([group.column("block")[0].as_py()] * len(to), pa.int64()), "data": pa.array(data, pa.binary())})

    return go


def _join_edges(group: pa.Table) -> pa.Table:
    """Tells each block the source of those of its edges that begin in a smaller document elsewhere."""
    got = [_unpack(x.as_py(), "u1", "u1", "u1", "u1") for x in group.column("data")]
    sizes = [len(h) // 8 for h, *_ in got]
    edge = np.concatenate([_unsteps(h) for h, *_ in got])
    check = np.concatenate([_unplanes(c) for _, c, _, _ in got])
    doc = np.concatenate([_unplanes8(d).view(np.int64) for _, _, d, _ in got])
    place = np.concatenate([_unplanes(p) for _, _, _, p in got])
    order, new = _ranked(edge, check, doc, place)
    lead = np.empty(len(edge), np.int64)
    lead[order] = order[new][np.cumsum(new) - 1]
    out = []
    for at in np.split(np.arange(len(edge)), np.cumsum(sizes)[:-1]):
        less = doc[lead[at]] < doc[at]
        out.append(_pack(np.packbits(less), _planes8(doc[lead[at[less]]]), _planes(place[lead[at[less]]])))
    return pa.table({"block": group.column("block"), "kind": pa.array([EDGES] * len(out), pa.int32()), "bucket": group.column("bucket"), "keys": pa.nulls(len(out), pa.list_(pa.int64())), "data": pa.array(out, pa.binary())})


PIECE = "block long, row int, start long, n long, source_id long, lo long, digest binary, from_id long, from_place long"


def _emit_pieces(buckets: int, window: int, run: int, cell: int):
    def go(group: pa.Table) -> pa.Table:
        """Pieces of a block's documents: n edges from word ``start`` on, named from (source_id, lo) on. from: what would follow
        the edge before, where a document turns off from it to this piece."""
        block, repeated, replies = _opened(group)
        use, which, edge, _, doc, place = block.index(window, run).sources(repeated)
        doc, place = doc.copy(), place.copy()
        for b, lo, hi in _slices(edge, buckets):
            bits, d, p = _unpack(replies[b], "u1", "u1", "u1")
            at = lo + np.flatnonzero(np.unpackbits(bits, count=hi - lo))
            doc[at], place[at] = _unplanes8(d).view(np.int64), _unplanes(p)
        source, there, begins = doc[which], place[which], block.at[use]
        copied = source < block.doc[use]
        source, there, begins = source[copied], there[copied], begins[copied]
        row = block.row[begins]
        touches, follows = np.zeros(len(begins), bool), np.zeros(len(begins), bool)
        touches[1:] = (begins[1:] == begins[:-1] + 1) & (row[1:] == row[:-1])
        follows[1:] = touches[1:] & (source[1:] == source[:-1]) & (there[1:] == there[:-1] + 1)
        heads = np.flatnonzero(~(follows & (there % cell != 0)))
        n = np.diff(np.append(heads, len(begins)))
        raw, at = block.joined()
        mine, begin = memoryview(raw), begins[heads]
        digest = [_digest(mine[a : b - 1]) for a, b in zip(at[begin].tolist(), at[begin + n + window - 1].tolist(), strict=True)]
        turns = touches[heads] & ~follows[heads]
        before = np.maximum(heads - 1, 0)
        optional = lambda x: pa.array(x, pa.int64(), mask=~turns)
        return pa.table({
            "block": pa.array(np.full(len(heads), group.column("block")[0].as_py(), np.int64)), "row": pa.array(row[heads].astype(np.int32)), "start": pa.array(begin - block.first[row[heads]]), "n": pa.array(n.astype(np.int64)),
            "source_id": pa.array(source[heads]), "lo": pa.array(there[heads].astype(np.int64)), "digest": pa.array(digest, pa.binary()), "from_id": optional(source[before]), "from_place": optional(there[before].astype(np.int64) + 1),
        })

    return go


def _digest(raw) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _held(window: int):
    """Of the pieces (lo, n, digest) that are asked of a text, those that it holds."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"source_id": [], "lo": [], "n": [], "digest": []}
            last, raw, at = None, None, None
            for i in range(batch.num_rows):
                text = batch.column(1).slice(i, 1)
                if last is None or text != last:
                    raw, at = Block([0], *buffers(text)).joined()
                    last = text
                mine = memoryview(raw)
                for ask in batch.column(2)[i].as_py():
                    lo, hi = ask["lo"], ask["lo"] + ask["n"] + window - 1
                    if hi < len(at) and _digest(mine[at[lo] : at[hi] - 1]) == ask["digest"]:
                        for k, v in (("source_id", batch.column(0)[i].as_py()), ("lo", lo), ("n", ask["n"]), ("digest", ask["digest"])):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.binary() if k == "digest" else pa.int64()) for k in out], names=list(out))

    return go


def unheld(pieces: DataFrame, docs: DataFrame, window: int = WINDOW) -> int:
    """How many distinct pieces no document of their source's id holds at their place."""
    asked = materialize(pieces.select("source_id", "lo", "n", "digest").distinct(), "asked")
    # only sources that are asked for more have parts, so these are a two-hundredth of the pieces at most
    many = materialize(asked.groupBy("source_id").agg(F.ceil(F.count("*") / ASKS).alias("parts")).where("parts > 1"), "many")
    parted = asked.join(F.broadcast(many) if many.count() <= FEW else many, "source_id", "left").withColumn("part", F.pmod(F.xxhash64("lo", "n", "digest"), F.coalesce("parts", F.lit(1))))
    asks = materialize(parted.groupBy("source_id", "part").agg(F.collect_list(F.struct("lo", "n", "digest")).alias("asks")).drop("part"), "asks")
    ids = asks.select(F.col("source_id").alias("doc_id")).distinct()
    sources = docs.where("doc_id is not null").join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_semi")
    found = sources.join(asks, F.col("doc_id") == F.col("source_id")).select("doc_id", "text", "asks").mapInArrow(_held(window), "source_id long, lo long, n long, digest binary")
    out = asked.count() - found.distinct().count()
    release(asked, many, asks)
    return out


def paths(pieces: DataFrame, cell: int = CELL) -> DataFrame:
    """(source_id, cell, lo, hi, path_id, path_lo, offset): parts of the graph, with the path that they lie on and how far along.

    The edges from lo to hi (not included) of a source belong to one part if no document turns off between them or comes in.
    A path runs over parts from one to the next while the one has no other way out and the next no other way in, and is named
    after its first edge. Parts that go round in a circle stay single."""
    spans = pieces.select("source_id", "lo", (F.col("lo") + F.col("n")).alias("hi"), F.floor(F.col("lo") / cell).alias("cell")).distinct()
    turns = materialize(pieces.where("from_id is not null").select("from_id", "from_place", F.col("source_id").alias("to_id"), F.col("lo").alias("to_place")).distinct(), "turns")
    # what overlaps or touches within a cell is one part, a cell's places at most
    inside = Window.partitionBy("source_id", "cell").orderBy("lo", "hi")
    begins = F.coalesce(F.col("lo") > F.max("hi").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = spans.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(inside)).groupBy("source_id", "cell", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cuts = turns.select(F.col("from_id").alias("source_id"), F.col("from_place").alias("cut")).union(turns.select("to_id", "to_place")).distinct().withColumn("cell", F.floor(F.col("cut") / cell))
    cuts = cuts.groupBy("source_id", "cell").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    ends = F.concat(F.array("lo"), F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: (c > F.col("lo")) & (c < F.col("hi"))), F.array("hi"))
    cut = merged.join(cuts, ["source_id", "cell"], "left").select("source_id", "cell", ends.alias("ends"))
    cut = cut.select("source_id", "cell", F.explode(F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.struct(F.element_at("ends", i).alias("lo"), F.element_at("ends", i + 1).alias("hi")))).alias("p"))
    parts = materialize(cut.select("source_id", "cell", "p.lo", "p.hi"), "parts")
    tails, starts = parts.select(F.col("source_id").alias("a_id"), F.col("lo").alias("a_lo"), "hi"), parts.select(F.col("source_id").alias("b_id"), F.col("lo").alias("b_lo"))
    on = tails.join(starts, (F.col("a_id") == F.col("b_id")) & (F.col("hi") == F.col("b_lo")))
    off = tails.join(turns, (F.col("a_id") == F.col("from_id")) & (F.col("hi") == F.col("from_place"))).select("a_id", "a_lo", "hi", F.col("to_id").alias("b_id"), F.col("to_place").alias("b_lo"))
    links = materialize(on.select("a_id", "a_lo", "b_id", "b_lo", (F.col("hi") - F.col("a_lo")).alias("far")).union(off.select("a_id", "a_lo", "b_id", "b_lo", (F.col("hi") - F.col("a_lo")).alias("far"))).distinct(), "links")
    one_out = links.groupBy("a_id", "a_lo").count().where("count = 1").drop("count")
    one_in = links.groupBy("b_id", "b_lo").count().where("count = 1").drop("count")
    chain = materialize(links.join(one_out, ["a_id", "a_lo"]).join(one_in, ["b_id", "b_lo"]).select("b_id", "b_lo", "a_id", "a_lo", "far"), "chain")
    release(turns, links)
    growing, before = chain.count(), -1
    while growing and growing != before:  # each part knows the part that lies 1, 2, 4, ... before it, or its path's first
        more = chain.select(F.col("b_id").alias("a_id"), F.col("b_lo").alias("a_lo"), F.col("a_id").alias("c_id"), F.col("a_lo").alias("c_lo"), F.col("far").alias("on"))
        grown = chain.join(more, ["a_id", "a_lo"], "left").select("b_id", "b_lo", F.coalesce("c_id", "a_id").alias("a_id"), F.coalesce("c_lo", "a_lo").alias("a_lo"), (F.col("far") + F.coalesce("on", F.lit(0))).alias("far"), F.col("c_id").isNotNull().alias("grew"))
        grown = materialize(grown, "chain")
        release(chain)
        chain, before, growing = grown.drop("grew"), growing, grown.where("grew").count()
        chain._weftline_path = grown._weftline_path
    if growing:  # a path that ends loses some that grow in every round, so who is left goes round
        chain = chain.join(chain.select(F.col("b_id").alias("a_id"), F.col("b_lo").alias("a_lo")), ["a_id", "a_lo"], "left_anti")
    known = chain.select(F.col("b_id").alias("source_id"), F.col("b_lo").alias("lo"), F.col("a_id").alias("path_id"), F.col("a_lo").alias("path_lo"), F.col("far").alias("offset"))
    out = parts.join(known, ["source_id", "lo"], "left")
    return out.select("source_id", "cell", "lo", "hi", F.coalesce("path_id", "source_id").alias("path_id"), F.coalesce("path_lo", "lo").alias("path_lo"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


SPAN = "struct<start:long,n:long,source_id:long,source_start:long,path_id:long,path_start:long>"


def _spans(pieces: DataFrame, graph: DataFrame, window: int, cell: int) -> DataFrame:
    """(block, row, span): the pieces of a document that follow one path without a gap, as words."""
    distinct = pieces.select("source_id", "lo", "n", F.floor(F.col("lo") / cell).alias("cell")).distinct()
    part = graph.select("source_id", "cell", F.col("lo").alias("part_lo"), F.col("hi").alias("part_hi"), "path_id", "path_lo", "offset")
    met = distinct.join(part, ["source_id", "cell"]).where("part_lo < lo + n and part_hi > lo")
    first = F.greatest("lo", "part_lo")
    met = met.select("source_id", "lo", "n", F.struct(first.alias("at"), (F.least(F.col("lo") + F.col("n"), F.col("part_hi")) - first).alias("n"), "path_id", "path_lo", (F.col("offset") + first - F.col("part_lo")).alias("along")).alias("m"))
    met = materialize(met.groupBy("source_id", "lo", "n").agg(F.collect_list("m").alias("ms")), "met")
    cut = pieces.join(met, ["source_id", "lo", "n"]).select("block", "row", "start", "source_id", "lo", F.explode("ms").alias("m"))
    cut = cut.select("block", "row", (F.col("start") + F.col("m.at") - F.col("lo")).alias("start"), F.col("m.n").alias("n"), "source_id", F.col("m.at").alias("source_start"), "m.path_id", "m.path_lo", "m.along")
    order = Window.partitionBy("block", "row").orderBy("start")
    same = lambda c, more: F.lag(c).over(order) + more == F.col(c)
    gap = F.lag("n").over(order)
    goes = (F.lag("path_id").over(order) == F.col("path_id")) & (F.lag("path_lo").over(order) == F.col("path_lo")) & same("start", gap) & same("along", gap)
    numbered = cut.withColumn("new", (~F.coalesce(goes, F.lit(False))).cast("int")).withColumn("span", F.sum("new").over(order))
    lead = lambda c: F.min_by(c, "start").alias(c)
    whole = numbered.groupBy("block", "row", "span").agg(F.min("start").alias("start"), (F.sum("n") + window - 1).alias("n"), lead("source_id"), lead("source_start"), lead("path_id"), (F.min("path_lo") + F.lit(0)).alias("path_start"))
    return materialize(whole.select("block", "row", "start", "n", "source_id", "source_start", "path_id", "path_start"), "spans")


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents without the words under their spans."""
    block, _, _ = _opened(left)
    order = np.lexsort((right.column("start").to_numpy(), right.column("row").to_numpy())) if right.num_rows else np.zeros(0, np.int64)
    right = right.take(pa.array(order))
    row, start, n = (right.column(c).to_numpy().astype(np.int64) for c in ("row", "start", "n"))
    cover = np.zeros(len(block.row) + 1, np.int64)
    begin = block.first[row] + start
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + n, -1)
    kept = np.cumsum(cover[:-1]) == 0
    raw, at = block.joined()
    size = np.diff(at)
    bytes_kept = np.repeat(kept, size)
    # no space behind a document's last word
    upto = np.append(0, np.cumsum(kept))
    number = upto[block.first]
    left_over = np.flatnonzero(kept)
    last = left_over[number[1:][number[1:] > number[:-1]] - 1]
    bytes_kept[at[last + 1] - 1] = False
    text_at = np.append(0, np.cumsum(bytes_kept))[at[block.first]]
    text = pa.LargeStringArray.from_buffers(len(block.keys), pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(raw[bytes_kept]))
    spans = pa.StructArray.from_arrays([right.column(c).combine_chunks() for c in ("start", "n", "source_id", "source_start", "path_id", "path_start")], ["start", "n", "source_id", "source_start", "path_id", "path_start"])
    per = np.searchsorted(row, np.arange(len(block.keys) + 1)).astype(np.int32)
    n_words = np.diff(block.first).astype(np.int64)
    return pa.table({"doc_id": pa.array(block.keys, pa.int64()), "n_words": pa.array(n_words), "n_removed": pa.array(n_words - np.diff(number)), "kept": text.cast(pa.string()), "spans": pa.ListArray.from_arrays(pa.array(per), spans)})


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN, cell: int = CELL, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words left, one space between), spans.

    A word goes if a window over it also begins in a document of smaller doc_id; windows are judged on the input. spans
    are the stretches of a document that follow one path of the compacted graph, of whatever length, with the source of
    their first word and the path. Rows that share a doc_id don't remove each other; a row without one loses nothing and
    removes nothing. A null text has no words; texts of fewer words than a window lose nothing; an empty table gives no
    rows. A piece whose source doesn't hold its words raises an error."""
    spark = docs.sparkSession
    tune(spark)
    docs = replayable(texts(docs), "texts")
    buckets = buckets or buckets_for(docs)
    columns, bundle = "block long, kind int, bucket int, keys array<long>, data binary", "bucket int, block long, data binary"
    repeated = materialize(dealt(docs.mapInArrow(_emit_minimizers(block, buckets, window, run), bundle), "bucket", buckets).groupBy("bucket").applyInArrow(_join_minimizers, columns), "minimizers")
    free_shuffles(spark)
    blocks = docs.mapInArrow(_texts(block), columns)
    known = blocks.union(repeated)
    edges = dealt(known, "block", buckets).groupBy("block").applyInArrow(_emit_edges(buckets, window, run), bundle)
    replies = materialize(dealt(edges, "bucket", buckets).groupBy("bucket").applyInArrow(_join_edges, columns), "edges")
    free_shuffles(spark)
    pieces = materialize(dealt(known.union(replies), "block", buckets).groupBy("block").applyInArrow(_emit_pieces(buckets, window, run, cell), PIECE), "pieces")
    release(repeated, replies)
    free_shuffles(spark)
    wrong = unheld(pieces, docs, window)
    if wrong:
        raise RuntimeError(f"{wrong} pieces differ from their source: two windows share a hash")
    spans = _spans(pieces, materialize(paths(pieces, cell), "paths"), window, cell)
    free_shuffles(spark)
    return dealt(blocks, "block", buckets).groupBy("block").cogroup(dealt(spans, "block", buckets).groupBy("block")).applyInArrow(_finish, f"doc_id long, n_words long, n_removed long, kept string, spans array<{SPAN}>")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
