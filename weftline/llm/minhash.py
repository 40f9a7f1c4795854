"""MinHash near-duplicate detection with DartMinHash signatures.

Each element of a weighted set owns a region [0, weight) x [0, infinity). Hashed darts fall on it as a Poisson process
that only the element decides; a dart's second coordinate is its rank. A signature throws the darts of all the set's
regions below a rank that yields about k ln k + 2k of them, deals them over k coordinates by a hash, and keeps the
earliest at each. Two sets then agree at a coordinate with the probability of their weighted Jaccard similarity, and a
set of n elements costs O(n + k log k), not O(n k).

Signatures are cut into bands. Texts of the same words are one vertex from the start, by a cryptographic digest of their
words. Members of a bucket are compared whole with one of them, another in each round; then pairs that share a bucket but
not yet a component are compared too, so no link that the bands offer is lost, and a group of near copies costs a star,
not all its pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, give_back, materialize, release, spare, table, texts, tune
from .components import components
from .textkernel import ALNUM, U, Hasher, buffers, lists, mix, ranges, words

SHINGLE, THRESHOLD, ROWS, BANDS = 5, 0.8, 5, 25
#: Bits of a set's parity map; see :func:`_near`.
BITS = 512
#: Bytes of a broadcast row of 64 bits, and of all of them up to which they are broadcast: 130 million rows or more.
WORD_BYTES, BROADCAST = 32, 64 << 20
#: A bucket of more members than this is dealt into blocks of about so many, and pairs are formed block by block.
WIDE = 4096


def normalised(text: Column) -> Column:
    return F.lower(text)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Signatures (n_rows, k) of weighted sets given as (row, element, weight > 0); a row without elements gets zeros."""
    cells = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(row)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    width = np.minimum(weight[at] - cell, 1.0)
    unit_row, seed = row[at], mix(element[at] ^ mix(cell.astype(np.uint64), 11), 12)
    total = np.bincount(row, weight, n_rows)
    out, left, reach = np.zeros((n_rows, k), np.uint64), np.flatnonzero(total > 0), k * np.log(k) + 2.0 * k
    while len(left):
        slot = np.full(n_rows, -1)
        slot[left] = np.arange(len(left))
        use = slot[unit_row] >= 0
        r, s, w = slot[unit_row[use]], seed[use], width[use]
        limit, rank, m = (reach / total[left])[r], np.zeros(len(r)), 0
        keys, ranks, values = [], [], []
        while len(r):
            m += 1
            d = mix(s, 100 + m)
            rank = rank - np.log(_uniform(mix(d, 1)))
            go = rank < limit
            if not go.all():
                r, s, w, limit, rank, d = r[go], s[go], w[go], limit[go], rank[go], d[go]
            hit = slice(None) if (w >= 1).all() else _uniform(mix(d, 2)) <= w
            value = mix(d, 3)[hit]
            keys.append(r[hit] * k + (value % U(k)).astype(np.int64))
            ranks.append(rank[hit])
            values.append(value)
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(-np.concatenate(ranks), kind="stable")
        got, kept = np.zeros(len(left) * k, bool), np.zeros(len(left) * k, np.uint64)
        kept[key[order]] = value[order]  # the earliest is written last
        got[key] = True
        full = got.reshape(-1, k).all(axis=1)
        out[left[full]] = kept.reshape(-1, k)[full]
        left, reach = left[~full], reach * 2
    return out


def shingles(hasher: Hasher, data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle, count), sorted. A text of fewer words than a shingle is one shingle of all its words."""
    starts, ends, row = words(data, offs, ALNUM)
    h = hasher.words(data, starts, ends)
    w = hasher.windows(h, size)
    ok = row[: len(w)] == row[size - 1 :] if len(w) else np.empty(0, bool)
    rows, sh = row[: len(w)][ok], w[ok]
    counts = np.bincount(row, minlength=len(offs) - 1)
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        if len(few):
            first = np.searchsorted(row, few)
            acc = mix(np.full(len(few), n, np.uint64), 77)
            for j in range(n):
                acc = acc * hasher.step + h[first + j]
            rows, sh = np.concatenate([rows, few]), np.concatenate([sh, mix(acc, 78)])
    order = np.lexsort((sh, rows))
    rows, sh = rows[order], sh[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (sh[1:] != sh[:-1])
    at = np.flatnonzero(new)
    return rows[at], sh[at], np.diff(np.append(at, len(rows)))


def digests(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text two numbers, the digest of its words with a space between."""
    _, ends, row = words(data, offs, ALNUM)
    inside = ALNUM[data]
    upto = np.append(0, np.cumsum(inside))
    size = upto[offs[1:]] - upto[offs[:-1]]
    last = np.zeros(len(data), bool)
    last[ends - 1] = True
    at = np.flatnonzero(inside)
    raw = np.insert(data[at], np.flatnonzero(last[at]) + 1, 32)
    edge = np.zeros(len(offs), np.int64)
    np.cumsum(size + np.bincount(row, minlength=len(offs) - 1), out=edge[1:])
    mine = memoryview(raw)
    got = b"".join(hashlib.blake2b(mine[a:b], digest_size=16).digest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    return np.frombuffer(got, np.int64).reshape(-1, 2)


def parity(row: np.ndarray, element: np.ndarray, count: np.ndarray | None, n_rows: int) -> np.ndarray:
    """For each set (or bag, each copy of an element apart) whether an odd number of elements falls on each of BITS places."""
    if count is not None:
        at = np.repeat(np.arange(len(row)), count)
        copy = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        row, element = row[at], element[at] ^ mix(copy.astype(np.uint64), 41)
    odd = np.bincount(row * BITS + (mix(element, 42) % U(BITS)).astype(np.int64), minlength=n_rows * BITS) & 1
    return np.packbits(odd.astype(bool).reshape(n_rows, BITS), axis=1).view(np.int64)


def _sketch(size: int, k: int, per_band: int, counted: bool):
    bands = k // per_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for lo, hi in ranges(offs):
                n = hi - lo
                row, sh, cnt = shingles(hasher, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size)
                weight = cnt.astype(np.float64) if counted else np.ones(len(row))
                same = digests(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                sig = dart_minhash(row, sh, weight, n, k)
                per = np.bincount(row, weight, n)
                has = per > 0
                key = np.empty((n, bands), np.uint64)
                for b in range(bands):
                    acc = np.full(n, b, np.uint64)
                    for j in range(per_band):
                        acc = mix(acc ^ sig[:, b * per_band + j], 31)
                    key[:, b] = acc
                odd = parity(row, sh, cnt if counted else None, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(per.astype(np.int64)), lists(np.where(has, bands, 0), pa.array(key[has].reshape(-1).view(np.int64))), lists(np.full(n, BITS // 64), pa.array(odd.reshape(-1)))],
                    names=["doc_id", "d1", "d2", "n", "bands", "parity"],
                )
        give_back()

    return run


def sketches(docs: DataFrame, size: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, counted: bool = False) -> DataFrame:
    """doc_id; d1, d2: a digest of the words; n: the weight of their shingles; bands: one key for each band (none for a text
    without words); parity: the set's parity map."""
    tune(docs.sparkSession)
    return texts(docs).select("doc_id", normalised(F.col("text")).alias("text")).mapInArrow(_sketch(size, rows * bands, rows, counted), "doc_id long, d1 long, d2 long, n long, bands array<long>, parity array<long>")


def _sets(size: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for lo, hi in ranges(offs):
                row, sh, cnt = shingles(hasher, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                raw = [_pack(sh[a:b], cnt[a:b] if counted else None) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(raw, pa.binary())], names=["doc_id", "shingles"])
        give_back()

    return run


def _pack(sh: np.ndarray, cnt: np.ndarray | None) -> bytes:
    return sh.tobytes() if cnt is None else sh.tobytes() + cnt.astype("<u4").tobytes()


def _unpack(raw: bytes, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    n = len(raw) // (12 if counted else 8)
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, "<u4", n, n * 8).astype(np.float64) if counted else None


def _compare(threshold: float, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, left = None, None
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                raw = xs[i].as_py()
                if raw != last:
                    last, left = raw, _unpack(raw, counted)
                (p, pw), (q, qw) = left, _unpack(ys[i].as_py(), counted)
                both = np.concatenate([p, q])
                if counted:
                    w = np.concatenate([pw, qw])
                    order = np.argsort(both, kind="stable")
                    both, w = both[order], w[order]
                    twin = np.flatnonzero(both[1:] == both[:-1])
                    common = np.minimum(w[twin], w[twin + 1]).sum()
                    total = w.sum()
                else:
                    both.sort(kind="stable")
                    common, total = int((both[1:] == both[:-1]).sum()), len(both)
                keep.append(common >= threshold * (total - common) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
        give_back()

    return run


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float, size: int, counted: bool) -> DataFrame:
    """Those pairs (a, b) of document ids whose shingle sets reach the threshold, compared whole."""
    spark = docs.sparkSession
    need = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "need")
    few = need.count()
    base = texts(docs)
    base = base.join(F.broadcast(need) if few <= 500_000 else need, "doc_id", "left_semi")
    tune(spark)
    sets = base.select("doc_id", normalised(F.col("text")).alias("text")).mapInArrow(_sets(size, counted), "doc_id long, shingles binary")
    sets = materialize(sets, "sets")
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    out = materialize(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_compare(threshold, counted), "a long, b long"), "verified")
    release(need, sets)
    return out


def _fits(threshold: float) -> Column:
    """Sets whose sizes differ by more than the threshold allows can't reach it."""
    return F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9


def _near(threshold: float) -> Column:
    """No pair that reaches the threshold fails this: a bit differs only where some element lies in just one of the sets."""
    differ = F.lit(0)
    for i in range(BITS // 64):
        differ = differ + F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i]))
    return differ <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6


def _across(members: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one bucket whose ends lie in different components. A wide bucket is dealt into blocks, and each meets each.

    members: (key, a, comp, c) of all buckets that hold more than one component, c being the bucket's size."""
    members = members.withColumn("blocks", F.ceil(F.col("c") / WIDE)).join(vertices.select("a", "n", "parity"), "a").withColumn("block", F.pmod(F.xxhash64("a"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    x = members.select("key", F.col("block").alias("i"), every.alias("j"), "a", "n", "parity", "comp").toDF("key", "i", "j", "a", "n_a", "parity_a", "comp_a")
    y = members.select("key", every.alias("i"), F.col("block").alias("j"), "a", "n", "parity", "comp").toDF("key", "i", "j", "b", "n_b", "parity_b", "comp_b")
    pairs = x.join(y, ["key", "i", "j"]).where((F.col("comp_a") < F.col("comp_b")) & _fits(threshold) & _near(threshold))
    return materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "across")


def _open(inside: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The members (key, a, comp, c, crossing) of buckets that still hold more than one component; crossing: pairs between them."""
    members = inside.withColumn("comp", F.col("a")) if comp is None else inside.join(comp.withColumnRenamed("id", "a"), "a", "left").select("key", "a", F.coalesce("component", "a").alias("comp"))
    members = materialize(members, "members")
    sizes = members.groupBy("key", "comp").count().groupBy("key").agg(F.sum("count").alias("c"), F.sum(F.col("count") * F.col("count")).alias("squares"), F.count("*").alias("parts"))
    sizes = materialize(sizes.where("parts > 1").select("key", "c", ((F.col("c") * F.col("c") - F.col("squares")) / 2).alias("crossing")), "sizes")
    out = materialize(members.join(sizes, "key").select("key", "a", "comp", "c", "crossing"), "open")
    release(members, sizes)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, counted: bool = False, rounds: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the smallest doc_id that links reach), kept (doc_id = class_id).

    A link joins two texts whose sets (or, ``counted``, bags) of ``size`` consecutive words reach the Jaccard
    similarity ``threshold``; words are runs of letters and digits in lower case. A text of fewer words is one shingle
    of them all. Texts without words, empty and null ones too, equal each other. Rows that share a doc_id are one
    document; a row without one has no class and is kept. An empty table gives no rows. Texts are taken whole.
    With 25 bands of 5 a pair at 0.8 is found with probability 0.99995, and more at every higher similarity.

    In up to ``rounds`` rounds the members of a bucket are compared with one of them, another each round, until few pairs
    are left or a round leaves more than half of them; what then lies in different components of one bucket is compared pair by pair."""
    base = materialize(sketches(docs, size, rows, bands, counted), "sketches")
    known = base.where("doc_id is not null")
    groups = materialize(known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("a"), F.min_by(F.struct("bands", "parity"), "doc_id").alias("s")).select("d1", "d2", "n", "a", "s.*"), "groups")
    vertices = groups.select("a", "n", "bands", "parity")
    keyed = vertices.select(F.explode("bands").alias("key"), "a")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared")
    inside = materialize(keyed.join(shared.hint("merge"), "key"), "inside")  # a table that follows the input is not for broadcasting
    free_shuffles(docs.sparkSession)
    links, comp, before = None, None, float("inf")
    for turn in range(rounds + 1):
        members = _open(inside, comp)
        n, crossing = members.agg(F.count("*"), F.sum(F.col("crossing") / F.col("c"))).first()
        if not n:
            break
        # further hubs pay while each halves what is left
        last, before = turn == rounds or crossing <= 2 * n or crossing > before / 2, crossing
        if last:
            pairs = _across(members, vertices, threshold)
        else:
            hub = F.struct(F.col("a").alias("b"), F.col("comp").alias("comp_b"))
            hubs = materialize(members.groupBy("key").agg(F.min_by(hub, F.xxhash64("a", F.lit(turn)) if turn else F.col("a")).alias("hub")).select("key", "hub.*"), "hubs")
            star = members.join(hubs, "key").where(F.col("comp") != F.col("comp_b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            of = lambda x: vertices.select(F.col("a").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
            star = star.join(of("a"), "a").join(of("b"), "b").where(_fits(threshold) & _near(threshold))
            pairs = materialize(star.select("a", "b"), "star")
        found = _verified(pairs, docs, threshold, size, counted)
        links = found if links is None else materialize(links.union(found), "links")
        release(pairs, members)
        comp = materialize(components(links), "comp")
        if last:
            break
    if comp is None:
        classes = groups.select("d1", "d2", "n", F.col("a").alias("class_id"))
    else:
        classes = groups.join(comp.withColumnRenamed("id", "a"), "a", "left").select("d1", "d2", "n", F.coalesce("component", "a").alias("class_id"))
    classes = materialize(classes, "classes")
    release(groups, shared, inside, *(t for t in (links, comp) if t is not None))
    out = known.join(classes, ["d1", "d2", "n"]).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    return out.union(base.where("doc_id is null").select("doc_id", F.lit(None).cast("long"), F.lit(True)))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class of :func:`near_duplicates` the row of the smallest doc_id stays.

    Every row is a document of its own here, whatever its id: of rows equal throughout one stays, rows without an id come
    last, and rows of different texts that share an id don't touch each other."""
    number = spare("row_number", docs.columns)
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), **options)
    known = rows.select(F.col(number).alias("r"), F.col("doc_id").cast("long").alias("d")).join(classes.select(F.col("doc_id").alias("r"), "class_id"), "r")
    order = F.struct(F.col("d").isNull().alias("n"), "d", "r")
    first = materialize(known.groupBy("class_id").agg(F.min(order).alias("o")).select(F.col("o.r").alias(number)), "first")
    return _numbered(rows, first, number).select(*(F.col(f"`{c}`") for c in docs.columns))


def _numbered(rows: DataFrame, keep: DataFrame, number: str) -> DataFrame:
    """The ``rows`` whose number is among those of ``keep``, in which none repeats.

    Numbers of a task's rows have no gaps, so they go out as bits, 64 a row, and the texts stay where they are. Only if the
    bits take too much for that are rows and numbers joined through a shuffle."""
    word, bit = F.shiftright(number, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number).bitwiseAND(F.lit(63)).cast("int"))
    at, bits = spare("word", rows.columns), spare("bits", rows.columns)
    words = materialize(keep.groupBy(word.alias(at)).agg(F.bit_or(bit).alias(bits)), "bits")
    if words.count() * WORD_BYTES > BROADCAST:
        return rows.join(keep, number, "left_semi")
    return rows.join(F.broadcast(words), word == F.col(at)).where(F.col(bits).bitwiseAND(bit) != 0)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
