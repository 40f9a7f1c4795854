"""Byte-level BPE over a distinct-word table, and decoding through an id-to-piece join.

A word is a run of white space with the text that follows it: the pre-tokenizer never joins text to white space behind
it, so words encode alone as they do in their text. Each block of documents is split into words once; its distinct words
go, in bundles, to the bucket that their hash names. A bucket merges the bundles and encodes each distinct word once. The ids
return to the block, where the words' positions put them in order. For decoding, the ids of the block's distinct words are
joined with the id-to-piece table, whose size is the vocabulary's, and the words' positions put the pieces in order."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from itertools import chain, pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, dealt, give_back, replayable, texts, tune
from .textkernel import SLICE, Hasher, U, buffers, gather, ranges

#: Bytes of text in a block, but for a block of one longer text.
BLOCK = 8 << 20
#: Words whose texts are put together and returned at once, but for one longer text.
TOGETHER = 1 << 15
#: Elements that are picked by number at once.
PICKED = 1 << 18


def _safe() -> np.ndarray:
    out = np.zeros(256, bool)
    out[0x21:0x7F] = True
    return out


def units(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where words begin: at each text's begin, and before a space, tab or line end that follows a character which is
    surely not white space (printable ASCII, or U+00C0 to U+07FF). Elsewhere words stay longer, which is as right."""
    begins = offs[:-1][offs[:-1] < len(data)]
    safe, out = _safe(), []
    for lo in range(0, len(data), SLICE):
        part = data[max(lo - 2, 0) : lo + SLICE]  # with the two bytes before
        blank = (part == 32) | (part == 10) | (part == 9) | (part == 13)
        sure = safe[part]
        sure[1:] |= (part[1:] >= 0x80) & (part[1:] < 0xC0) & (part[:-1] >= 0xC3) & (part[:-1] <= 0xDF)
        here, head = np.zeros(len(part), bool), lo - max(lo - 2, 0)
        here[1:] = blank[1:] & sure[:-1]
        here[begins[slice(*np.searchsorted(begins, [lo, lo + SLICE]))] - lo + head] = True
        out.append(np.flatnonzero(here[head:]).astype(np.int32) + lo)
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any type as one compressed run of bytes."""
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _planes(x: np.ndarray) -> np.ndarray:
    """Four-byte numbers by byte planes, which compress better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).reshape(-1)


def _unplanes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def _unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<u8", n, 8), 8 * (n + 1), []
    for t, size in zip(types, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
        at += size
    return out


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.Array]]]:
    """Numbers and columns of consecutive rows; the same for every run over the same rows."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        offs = buffers(batch.column(1))[1]
        lo = 0
        while lo < batch.num_rows:
            room = most - size
            hi = int(np.searchsorted(offs, offs[lo] + room, side="right")) - 1
            if hi <= lo and not held:
                hi = lo + 1
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
            if hi < batch.num_rows:
                yield part << 24 | seq, _columns(held)
                pa.default_memory_pool().release_unused()
                seq, held, size = seq + 1, [], 0
            lo = max(hi, lo)
    if held:
        yield part << 24 | seq, _columns(held)


def _columns(held: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)]


def _split(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, the word number at each position, and the distinct words by falling frequency."""
    data, offs = buffers(text)
    starts = units(data, offs)
    per = np.diff(np.searchsorted(starts, offs.astype(np.int32)))
    ends = np.append(starts, len(data)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(at, minlength=len(coded.dictionary)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return per, place[at], coded.dictionary.take(pa.array(order))


def _positions(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (key, text) in _blocks(batches, most):
            per, at, words = _split(text)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0], pa.int32()), pa.array([key.to_pylist()], pa.list_(pa.int64())), pa.array([_pack(per.astype("<i8"), _planes(at), np.array([len(words)], "<i8"))], pa.binary())], names=["block", "kind", "keys", "data"])
            del per, at, words
            give_back()

    return run


def _bundles(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(3)
        for block, (_, text) in _blocks(batches, most):
            words = _split(text)[2]
            for bucket, at in _dealt(hasher, words, buckets):
                data, offs = buffers(words.take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block]), pa.array([_pack(_planes(at), _planes(np.diff(offs)), data)], pa.binary())], names=["bucket", "block", "data"])
            del words
            give_back()

    return run


def _dealt(hasher: Hasher, words: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of the words that each bucket gets, in order."""
    data, offs = buffers(words)
    to = (hasher.words(data, offs[:-1], offs[1:]) % U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), order[edge[b] : edge[b + 1]]


def load(model: str):
    """The library's tokenizer of a JSON text, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(model)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _loaded() -> dict[str, object]:
    """The tokenizer that this process holds by its model. This package goes to workers by value, so that its own globals are
    new in every task; a module of Python's table stays."""
    return sys.modules.setdefault("_weftline_loaded", ModuleType("_weftline_loaded")).__dict__.setdefault("tokenizers", {})


def tokenizer(model: str):
    """What ``load`` gives, loaded once a worker: workers outlive tasks, and every load leaves memory behind in them."""
    held = _loaded()
    if model not in held:
        held.clear()
        held[model] = load(model)
    return held[model]


def drop_tokenizer() -> None:
    _loaded().clear()


def _picked(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[gather(first, counts)], in parts, so that the numbers take little beside the values."""
    ends = np.cumsum(counts)
    out, lo = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype), 0
    while lo < len(ends):
        at = int(ends[lo - 1]) if lo else 0
        hi = int(np.searchsorted(ends, at + PICKED, side="right"))
        if hi > lo:
            out[at : ends[hi - 1]] = values[gather(first[lo:hi], counts[lo:hi])]
        else:  # one run is longer
            hi = lo + 1
            out[at : ends[lo]] = values[first[lo] : first[lo] + counts[lo]]
        lo = hi
    return out


def _encoder(model):
    def run(group: pa.Table) -> pa.Table:
        tok = tokenizer(model.value)
        blocks, bundles, places = group.column("block").to_pylist(), [], []
        for raw in group.column("data"):
            where, lens, data = _unpack(raw.as_py(), "u1", "u1", "u1")
            lens = _unplanes(lens)
            places.append(where)
            ends = np.zeros(len(lens) + 1, np.int32)
            np.cumsum(lens, out=ends[1:])
            bundles.append(pa.StringArray.from_buffers(len(lens), pa.py_buffer(ends), pa.py_buffer(data.tobytes())))
        coded = pa.concat_arrays(bundles).dictionary_encode()
        at, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        counts, flat = [], []
        for lo in range(0, len(words), 2_000):
            got = [e.ids for e in tok.encode_batch_fast(words.slice(lo, 2_000).to_pylist(), add_special_tokens=False)]
            counts.append(np.array([len(ids) for ids in got], np.int64))
            flat.append(np.fromiter(chain.from_iterable(got), np.int32))
        counts, flat = np.concatenate(counts), np.concatenate(flat)
        first, out, lo = np.cumsum(counts) - counts, [], 0
        for bundle, where in zip(bundles, places, strict=True):
            mine = at[lo : lo + len(bundle)]
            lo += len(bundle)
            ids = _picked(flat, first[mine], counts[mine])
            out.append(_pack(where, _planes(counts[mine]), _planes(ids)))
        del coded, at, words, bundles, places, counts, flat, first
        give_back()
        return pa.table({"block": pa.array(blocks, pa.int64()), "data": pa.array(out, pa.binary())})

    return run


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_table(model: str) -> list[tuple[int, bytes]]:
    """The bytes of each id of the vocabulary by rising id, added tokens included."""
    spec, letters = json.loads(model), byte_letters()
    table = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    return sorted((table | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}).items())


def pieces(spark: SparkSession, model: str) -> DataFrame:
    """(id, piece)."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in piece_table(model)], "id int, piece binary")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """(key, text) of rows (key, ids): each id is joined with its piece, and the pieces are put in order by position.

    Keys are distinct; null or empty ids make the empty text; an id that the vocabulary lacks raises an error, and bytes
    that are no UTF-8 become replacement characters, as in the library."""
    spark = coded.sparkSession
    spots = coded.select("key", F.posexplode("ids").alias("pos", "id"))
    found = spots.join(F.broadcast(pieces(spark, model)), "id", "left")  # as many rows as the vocabulary
    found = found.withColumn("piece", F.when(F.col("piece").isNull(), F.raise_error(F.lit("an id has no piece")).cast("binary")).otherwise(F.col("piece")))
    rows = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda s: s["piece"]).alias("pieces"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())], names=["key", "text"])

    return coded.select("key").join(rows, "key", "left").mapInArrow(spell, "key long, text string")


def _assemble(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one block from its positions (kind 0) and its words' ids (1), a few at once."""
        drop_tokenizer()
        group = pa.Table.from_batches(list(batches))
        kinds = np.array(group.column("kind").to_pylist())
        row = lambda k: np.flatnonzero(kinds == k).tolist()
        (main,) = row(0)
        keys = group.column("keys")[main].values
        per, at, n = _unpack(group.column("data")[main].as_py(), "<i8", "u1", "<i8")
        at, n = _unplanes(at), int(n[0])
        counts, chunks = np.zeros(n, np.int64), []
        for i in row(1):
            where, got, ids = map(_unplanes, _unpack(group.column("data")[i].as_py(), "u1", "u1", "u1"))
            counts[where] = got
            chunks.append((where, got.astype(np.int64), ids))
        del group
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for where, got, ids in chunks:
            flat[gather(first[where], got)] = ids
        del chunks
        names, lens, letters = table.value
        starts = np.cumsum(lens) - lens
        spot = np.searchsorted(names, flat)
        # each distinct word is spelled once, then the words of a text are put in a row
        word_lens = np.add.reduceat(np.append(lens[spot], 0), np.append(first, len(flat)))[:n] if n else np.zeros(0, np.int64)
        spelt = _picked(letters, starts[spot], lens[spot])
        del spot
        word_first = np.cumsum(word_lens) - word_lens
        edge = np.zeros(len(per) + 1, np.int64)
        np.cumsum(per, out=edge[1:])
        for lo, hi in ranges(edge, TOGETHER):
            w, inner = at[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo]
            off = np.append(0, np.cumsum(counts[w]))[inner].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(_picked(flat, first[w], counts[w])))
            cut = np.append(0, np.cumsum(word_lens[w]))[inner].tolist()
            raw = _picked(spelt, word_first[w], word_lens[w]).tobytes()
            decoded = [raw[a:b].decode("utf-8", "replace") for a, b in pairwise(cut)]
            yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), ids, pa.array(decoded, pa.string())], names=["key", "ids", "decoded"])
            del raw, decoded, ids
        del at, flat, spelt, counts, first, word_first, word_lens, keys
        give_back()

    return run


def encode_decode(keyed: DataFrame, model: str, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """key, ids, decoded for each row (key long, text string) of ``keyed``.

    ids are those of the library's encode without special tokens added (their strings in a text still are special), decoded
    is the text of ids with special tokens kept. ``model`` is the tokenizer's JSON text, of a byte-level BPE. A null text is the
    empty one, which has no ids; keys may repeat or be null; an empty table gives no rows. Texts of any length are
    taken whole; a block holds at least one text."""
    spark = keyed.sparkSession
    tune(spark)
    keyed = replayable(keyed.select("key", F.coalesce("text", F.lit("")).alias("text")), "texts")
    buckets = buckets or buckets_for(keyed)
    held = spark.sparkContext.broadcast(model)
    bundles = keyed.mapInArrow(_bundles(block, buckets), "bucket int, block long, data binary")
    words = dealt(bundles, "bucket", buckets).groupBy("bucket").applyInArrow(_encoder(held), "block long, data binary")
    rows = keyed.mapInArrow(_positions(block), "block long, kind int, keys array<long>, data binary")
    rows = rows.union(words.select("block", F.lit(1), F.lit(None).cast("array<long>"), "data"))
    table = piece_table(model)
    names, spelled = np.array([i for i, _ in table], np.int64), [p for _, p in table]
    joined = spark.sparkContext.broadcast((names, np.array([len(p) for p in spelled], np.int64), np.frombuffer(b"".join(spelled), np.uint8)))
    return dealt(rows, "block", buckets).groupBy("block").applyInArrow(_assemble(joined), "key long, ids array<int>, decoded string")


def vocabulary(path: str | None = None) -> str:
    """The JSON text of a tokenizer file, by default the public 50k byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    coded = encode_decode(docs.select(F.col("doc_id").alias("key"), "text"), vocabulary())
    return coded.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
