import hashlib
import random
import re

import pytest

from weftline.llm import substrings


def brute(rows, n=13):
    first, words = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - n + 1) if i is not None else ():
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1) if i is not None else ():
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def found(frame):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect())


def passages(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "b", "é", "dd"]
    shared = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    some = lambda: rng.choice(shared)[rng.randrange(40) :] if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
    return [(rng.choice([*range(60), None]), rng.choice(["", "  ", "\n", " "]).join(some() for _ in range(rng.randrange(4))) if rng.random() < 0.95 else None) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 500, 1 << 23])
def test_equals_brute_force(spark, block):
    rows = passages(block)
    got = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), block=block, cell=7 if block == 500 else substrings.CELL)
    assert found(got) == brute(rows)


def test_nasty_documents(nasty, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    assert found(substrings.repeated_spans(nasty)) == brute(rows)
    assert substrings.repeated_spans(no_docs).count() == 0


def test_windows_are_judged_on_the_input(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:20])), (2, " ".join(w[10:30])), (3, " ".join(w[5:35])), (4, " ".join(w[:12]))]
    assert found(substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_paths_name_their_source(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(["x"] * 3 + w)), (2, " ".join(["y"] * 7 + w[20:90])), (3, "z")]
    spans = {r["doc_id"]: [s.asDict() for s in r["spans"]] for r in substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[1] == spans[3] == []
    (s,) = spans[2]
    assert (s["start"], s["n"], s["source_id"], s["source_start"]) == (7, 70, 1, 23)


def test_a_false_source_raises(spark, monkeypatch):
    w = [f"w{i}" for i in range(100)]
    rows = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w))], "doc_id long, text string")
    right, calls = substrings._emit_pieces, []

    def other(*args):
        """Pieces that name a place one word further on."""
        calls.append(args)
        go = right(*args)

        def shifted(group):
            import pyarrow.compute as pc

            got = go(group)
            return got.set_column(got.column_names.index("lo"), "lo", pc.add(got.column("lo"), 1))

        return shifted

    monkeypatch.setattr(substrings, "_emit_pieces", other)
    with pytest.raises(RuntimeError, match="differ from their source"):
        substrings.repeated_spans(rows)
    assert calls


def thue_morse(n):
    """Two words that meet under every sum of powers modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_a_pattern_stay_apart(spark):
    x, y = thue_morse(1024)
    tail = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([x, *tail])), (3, " ".join([y, *tail]))]
    assert found(substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_paths_end_where_texts_part(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = [(1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(a + b)), (4, " ".join(["z", *a, *c])), (5, " ".join(a + b + a))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (16, 512):
        got = {r["doc_id"]: r["spans"] for r in substrings.repeated_spans(frame, cell=cell).collect()}
        assert found(substrings.repeated_spans(frame, cell=cell)) == brute(rows)
        # what follows a branches, so the path that lies within a ends there, whatever the cells
        assert [(s["start"], s["n"], s["path_id"], s["path_start"]) for s in got[2]] == [(0, 40, 1, 0)]
        assert [(s["start"], s["n"]) for s in got[3]] == [(0, 40), (28, 52)]
        assert [(s["start"], s["n"]) for s in got[4]] == [(1, 40), (29, 52)]


def test_circles_end(spark):
    ring = [f"r{i}" for i in range(20)]
    rows = [(i, " ".join(ring * (3 + i))) for i in range(4)]
    for cell in (8, 512):
        assert found(substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell)) == brute(rows)


def test_query_columns(spark, tmp_path):
    w = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, w), (2, w)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in substrings.op6_substring_dedup(spark, str(tmp_path)).collect()}
    assert (got[2]["n_removed"], got[2]["kept_sha256"]) == (20, hashlib.sha256(b"").hexdigest())
    assert (got[1]["n_removed"], got[1]["kept_sha256"]) == (0, hashlib.sha256(w.encode()).hexdigest())
