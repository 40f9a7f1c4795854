import random
import types

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftline.llm import bpe

MODEL = bpe.vocabulary()
TEXTS = [
    None, "", " ", "  ", "a  b", "a\n\n b\t\tc ", "it's  we'll <|endoftext|> x<|endoftext|>  ", "é è  ü", "　 a　b c", "x\x1c y\x85 z", "日本 語  テキスト \n", "a" * 5000, "1234 5 !!  ??\r\n", "﻿ a",
    "🙂 🙂‍  🙂", "   lead", "don't’s  'S 's", "Ω  ω߿ ࠀ x", "  nbsp  ", "<|endoftext|>", "<|endof text|>",
]


def library(texts):
    tok = bpe.load(MODEL)
    ids = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return [(i, tok.decode(i, skip_special_tokens=False)) for i in ids]


@pytest.mark.parametrize("block", [1, 300, 1 << 23])
def test_equals_the_library(spark, block):
    rng = random.Random(block)
    letters = [" ", "\n", "\t", "a", "é", " ", "1", "!", "'s", "<|endoftext|>", " ", "漢", "\x1d", "\x00"]
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r["key"]: (r["ids"], r["decoded"]) for r in bpe.encode_decode(rows, MODEL, block=block).collect()}
    assert got == dict(enumerate(library(texts)))


def test_nasty_documents(nasty, no_docs):
    keyed = nasty.select(F.col("doc_id").alias("key"), "text")
    rows = keyed.collect()
    got = bpe.encode_decode(keyed, MODEL).collect()
    want = [(str(r["key"]), *w) for r, w in zip(rows, library([r["text"] for r in rows]), strict=True)]
    assert sorted((str(r["key"]), r["ids"], r["decoded"]) for r in got) == sorted(want)
    assert bpe.encode_decode(no_docs.select(F.col("doc_id").alias("key"), "text"), MODEL).count() == 0


def test_decoding_by_join(spark):
    rows = spark.createDataFrame([(i, ids) for i, (ids, _) in enumerate(library(TEXTS))] + [(90, None)], "key long, ids array<int>")
    got = {r["key"]: r["text"] for r in bpe.decode(rows, MODEL).collect()}
    assert got == {i: t for i, (_, t) in enumerate(library(TEXTS))} | {90: ""}
    half = spark.createDataFrame([(1, library(["漢"])[0][0][:1])], "key long, ids array<int>")
    assert bpe.decode(half, MODEL).first()["text"] == bpe.load(MODEL).decode(half.first()["ids"], skip_special_tokens=False)
    with pytest.raises(Exception, match="no piece"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "key long, ids array<int>"), MODEL).collect()


def test_workers_load_the_tokenizer_once(monkeypatch):
    want = [i for word in ("one", " two") for i in library([word])[0][0]]
    loads, real = [], tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", types.SimpleNamespace(from_str=lambda model: loads.append(1) or real.from_str(model)))
    data = bpe._pack(bpe._planes(np.arange(2)), bpe._planes(np.array([3, 4])), np.frombuffer(b"one two", np.uint8))
    group = pa.table({"block": pa.array([5]), "data": pa.array([data], pa.binary())})
    sent = cloudpickle.dumps(bpe._encoder(types.SimpleNamespace(value=MODEL + " ")))
    for _ in range(3):  # as many tasks of one worker
        got = cloudpickle.loads(sent)(group)
        _, counts, ids = map(bpe._unplanes, bpe._unpack(got["data"][0].as_py(), "u1", "u1", "u1"))
        assert (counts.tolist(), ids.tolist()) == ([1, 1], want)
    assert len(loads) == 1


def test_blocks_return_their_texts_a_few_at_once(spark, monkeypatch):
    monkeypatch.setattr(bpe, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"w{i % 97}" for i in range(j % 400)) for j in range(1500)] + ["y " * 100_000] + ["z"] * 5
    rows = pa.record_batch({"key": pa.array(range(len(texts))), "text": pa.array(texts)})
    (positions,) = bpe._positions(bpe.BLOCK)(iter([rows]))
    words = [bpe._encoder(types.SimpleNamespace(value=MODEL))(pa.table({"block": [b["block"][0].as_py()], "data": b["data"]})) for b in bpe._bundles(bpe.BLOCK, 8)(iter([rows]))]
    parts = [pa.record_batch({"block": w["block"].combine_chunks(), "kind": pa.array([1], pa.int32()), "keys": pa.nulls(1, pa.list_(pa.int64())), "data": w["data"].combine_chunks()}) for w in words]
    table = bpe.piece_table(MODEL)
    held = (np.array([i for i, _ in table]), np.array([len(p) for _, p in table]), np.frombuffer(b"".join(p for _, p in table), np.uint8))
    got = list(bpe._assemble(types.SimpleNamespace(value=held))(iter([parts[0], positions, *parts[1:]])))
    assert len(got) > 5
    assert all(b.num_rows == 1 or sum(len(t.split(" ")) for t in b["decoded"].to_pylist()) <= 2 * bpe.TOGETHER for b in got)
    out = pa.Table.from_batches(got).to_pylist()
    assert [(r["ids"], r["decoded"]) for r in out] == library(texts)
    assert [r["key"] for r in out] == list(range(len(texts)))


@pytest.mark.parametrize("picked", [1, 7, 1 << 18])
def test_picking_in_parts(monkeypatch, picked):
    monkeypatch.setattr(bpe, "PICKED", picked)
    rng = np.random.default_rng(picked)
    counts = rng.integers(0, 20, 50)
    first = rng.integers(0, 80, 50)
    values = rng.integers(0, 1000, 100).astype(np.int32)
    want = [x for f, c in zip(first, counts, strict=True) for x in values[f : f + c].tolist()]
    assert bpe._picked(values, first, counts).tolist() == want
    assert bpe._picked(values, first[:0], counts[:0]).tolist() == []
