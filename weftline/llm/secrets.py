"""Secret scans in DataFrame functions only.

Three fixed kinds come from expressions. The method adds high-entropy strings: a window slides over each candidate, the
counts of its characters change by the one that enters and the one that leaves, and the least sum of c*log2(c) seen
tells the greatest Shannon entropy. Each character class (hex, alphanumeric, base64) has its own threshold, and an
allow-list drops candidates that look like words, numbers or identifiers, and windows that touch a placeholder or sequence."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts


def any_case(word: str) -> str:
    """The expression of ``word`` with ASCII letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), f"{any_case('api')}_?{any_case('key')}"])
ASSIGN = rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Candidates of the entropy scan, the window in characters, and the entropy in bits that a window must reach.
CANDIDATE, WINDOW = "[A-Za-z0-9+/_=-]{20,}", 20
BITS = {"entropy_hex": 3.0, "entropy_alnum": 3.7, "entropy_base64": 3.85}
SHAPES = {"entropy_hex": "^[0-9a-fA-F]+$", "entropy_alnum": "^[0-9A-Za-z]+$", "entropy_base64": "^.*$"}
#: What is no secret: no digit or no letter at all, one repeated character, placeholders, sequences, UUIDs, dates, words and paths with a short number at their end.
ALLOWED = [
    "^[^0-9]*$",
    "^[^A-Za-z]*$",
    "(?i)example|sample|dummy|placeholder|changeme|redacted|xxxxx|00000|aaaaa",
    "(?i)0123456789|12345678|abcdefgh|qwertyui",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "^[A-Za-z/_+=-]*[0-9]{0,4}$",
]
#: The list of the scan itself: the SQL drops a candidate for a word or date anywhere in it, the scan only for what these leave. Dates stand with a time, words and a short number behind them.
WHOLE = [p for i, p in enumerate(ALLOWED) if i not in (2, 3, 5)] + ["^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt0-9/_+-]*+[A-Za-z/_+=-]*+[0-9]{0,4}$"]
#: What a candidate's windows must be clear of: a run of x and the delimited token around it, a date in front, placeholder words and sequences. A and 0 in a row are zero bytes in a key: they cover nothing, but lower the entropy of their windows.
COVERED = "(?i)(?<![A-Za-z0-9])[A-Za-z0-9]*?x{5}[A-Za-z0-9]*|^[0-9]{4}-[0-9]{2}-[0-9]{2}|example|sample|dummy|placeholder|changeme|redacted|0123456789|12345678|abcdefgh|qwertyui"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SCALE = 1 << 20
#: c*log2(c) in whole units, so that sums don't depend on their order.
UNITS = [0, 0, *(round(c * math.log2(c) * SCALE) for c in range(2, WINDOW + 1))]
LIMIT = {k: math.floor((math.log2(WINDOW) - b) * WINDOW * SCALE) for k, b in BITS.items()}
KINDS = ["assign", "access", "hex", *BITS]


#: Elements of an array that one fold appends to; see :func:`folded`.
LOT = 256


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(rows: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Folds an array from the left: step(carry, x) gives the next carry and an array of what x adds; all added is returned.

    Appending copies what is there, so lots of LOT elements are folded apart and flattened at the end: a text with very many
    matches then costs little more than its length."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        now, added = step(acc["carry"], x)
        return F.struct(now.alias("carry"), F.concat(acc["out"], added).alias("out"))

    def lot(done: Column, part: Column) -> Column:
        first = F.coalesce(F.get(done, F.size(done) - 1)["carry"], carry)
        return F.concat(done, F.array(F.aggregate(part, F.struct(first.alias("carry"), none.alias("out")), one)))

    def whole(rows: Column) -> Column:
        n = F.size(rows)
        lots = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / LOT).cast("int")), lambda i: F.slice(rows, i * LOT + 1, F.lit(LOT)))
        done = F.aggregate(lots, F.array().cast(f"array<struct<carry:int,out:array<{kind}>>>"), lot)
        return F.when(n > 0, F.flatten(F.transform(done, lambda d: d["out"]))).otherwise(none)

    return once(rows, whole)


def places(text: Column, pattern: Column | str, group: int = 0, measure: Callable[[Column], Column] = F.length) -> Column:
    """The leftmost non-overlapping matches: array of (start, end, value), value being the group's text.

    Places count code points, or what ``measure`` counts in the text before."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(group))
    rows = once(hits, lambda h: F.arrays_zip(h.alias("hit"), F.slice(pieces, F.lit(1), F.size(h)).alias("before"), (values if group else h).alias("value")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + measure(x["before"])
        end = start + measure(x["hit"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))

    return folded(rows, F.lit(0), step, "struct<start:int,end:int,value:string>")


def _least_units(value: Column) -> Column:
    """Over the windows of a candidate, the least sum of c*log2(c) units; counts change by two characters a step."""
    x = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    units = F.array(*map(F.lit, UNITS))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("least"), F.array().cast("array<int>").alias("window"))

    def step(a: Column, enters: Column) -> Column:
        full = F.size(a["window"]) == WINDOW
        leaves = F.when(full, F.get(a["window"], F.lit(0))).otherwise(-1)
        n_in, n_out = F.get(a["n"], enters), F.coalesce(F.get(a["n"], leaves), F.lit(0))
        # the character that leaves goes first, so no count exceeds the window
        change = F.get(units, n_in + 1) - F.get(units, n_in) + F.when(full, F.get(units, n_out - 1) - F.get(units, n_out)).otherwise(0)
        total = a["sum"] + F.when(enters == leaves, 0).otherwise(change)
        counts = F.when(enters == leaves, a["n"]).otherwise(F.transform(a["n"], lambda c, j: c + (j == enters).cast("int") - (j == leaves).cast("int")))
        window = F.concat(F.when(full, F.slice(a["window"], 2, WINDOW - 1)).otherwise(a["window"]), F.array(enters))
        least = F.when(F.size(a["window"]) >= WINDOW - 1, F.least(a["least"], total)).otherwise(a["least"])
        return F.struct(counts.alias("n"), total.alias("sum"), least.alias("least"), window.alias("window"))

    return F.aggregate(x, start, step, lambda a: a["least"])


def _entropy(text: Column) -> Column:
    """Candidates that the allow-list doesn't suppress and of which a window clear of placeholders reaches their class's threshold: (start, end, kind)."""
    found = F.filter(places(text, CANDIDATE), lambda p: ~_any(p["value"]))
    clear = lambda v: F.filter(F.split(v, COVERED, -1), lambda x: F.length(x) >= WINDOW)
    least = lambda v: F.array_min(F.transform(clear(v), _least_units))
    rated = F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), _kind(p["value"]).alias("kind"), least(p["value"]).alias("units")))
    limit = lambda k: F.when(k == "entropy_hex", LIMIT["entropy_hex"]).when(k == "entropy_alnum", LIMIT["entropy_alnum"]).otherwise(LIMIT["entropy_base64"])
    return F.filter(rated, lambda p: p["units"] <= limit(p["kind"]))


def _any(value: Column) -> Column:
    out = F.lit(False)
    for pattern in WHOLE:
        out = out | F.rlike(value, F.lit(pattern))
    return out


def _kind(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit(SHAPES["entropy_hex"])), "entropy_hex").when(F.rlike(value, F.lit(SHAPES["entropy_alnum"])), "entropy_alnum").otherwise("entropy_base64")


def with_spans(rows: DataFrame) -> DataFrame:
    """(row, text) rows with ``spans``: array of (start, order, end, kind) by start, then kind as listed in KINDS.

    Spans are whole matches in code points, end exclusive. A match whose value is too short is dropped, but what it
    took is not searched again. Added spans that lie within one of the three fixed kinds are not repeated."""
    text = F.col("text")
    no_spans = F.array().cast("array<struct<start:int,end:int,value:string>>")
    low = F.lower(text)
    keys = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    typed = lambda found, k: F.transform(found, lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index(k)).alias("order"), p["end"].alias("end"), F.lit(k).alias("kind")))
    assign = F.when(keys, F.filter(places(text, ASSIGN, 2), lambda p: F.length(p["value"]) >= 6)).otherwise(no_spans)
    access = F.when(text.contains("AKIA"), F.filter(places(text, ACCESS), lambda p: p["end"] - p["start"] >= 20)).otherwise(no_spans)
    hexes = F.when(F.rlike(text, F.lit("[0-9a-f]{24}")), F.filter(places(text, HEX), lambda p: p["end"] - p["start"] >= 24)).otherwise(no_spans)
    base = F.concat(typed(assign, "assign"), typed(access, "access"), typed(hexes, "hex"))
    rated = F.when(F.rlike(text, F.lit("[A-Za-z0-9+/_=-]{20}")), _entropy(text)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,units:int>>"))
    order = F.create_map(*(x for k in BITS for x in (F.lit(k), F.lit(KINDS.index(k)))))
    fresh = F.filter(F.col("rated"), lambda p: ~F.exists(F.col("base"), lambda b: (b["start"] <= p["start"]) & (b["end"] >= p["end"])))
    added = F.transform(fresh, lambda p: F.struct(p["start"].alias("start"), order[p["kind"]].alias("order"), p["end"].alias("end"), p["kind"].alias("kind")))
    out = rows.select("row", "text", base.alias("base"), rated.alias("rated"))
    return out.select("row", "text", F.array_sort(F.concat("base", added)).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans (see :func:`with_spans`) of every row of ``docs``, over its whole text.

    A null text is the empty one; repeated rows and ids are each scanned; an empty table gives no rows."""
    return with_spans(texts(docs).select(F.struct("doc_id").alias("row"), "text")).select("row.doc_id", "text", "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every maximal run of touching spans replaced by the mask; spans are sorted by their start."""
    far = F.lit(2**31 - 1)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        """at: the end of the spans so far, -1 before the first."""
        gap = F.substring(text, F.greatest(at, F.lit(0)) + 1, s["start"] - F.greatest(at, F.lit(0)))
        return F.greatest(at, s["end"]), F.when((s["start"] > at) & (s["end"] > s["start"]), F.array(gap, F.lit(mask))).otherwise(F.array().cast("array<string>"))

    parts = folded(spans, F.lit(-1), step, "string")
    end = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, end + 1, far)))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, with secrets masked in text and n_chars, where there is one, set anew.

    Rows without secrets, null texts too, stay as they are."""
    names = docs.columns
    found = with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    found = found.select("row", F.size("spans").alias("n"), redact(F.col("text"), F.col("spans")).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    keep = lambda c: F.col("row").getField(c)
    return found.select(*((F.when(F.col("n") > 0, new[c]).otherwise(keep(c)) if c in new else keep(c)).alias(c) for c in names))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["order"] < 3)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def spans(kind: str, pattern: str, group: int, keep: str) -> str:
        got = f"regexp_extract_all(t, {q(pattern)})"
        return f"""SELECT rid, {KINDS.index(kind) if kind in KINDS else 9} AS o, {q(kind)} AS kind, s, s + length(m) AS e, v FROM (
            SELECT rid, ms[k] AS m, vs[k] AS v, list_sum(list_transform(ps[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda p: length(p))), 0) AS s
            FROM (SELECT rid, {got} AS ms, regexp_extract_all(t, {q(pattern)}, {group}) AS vs, string_split_regex(t, {q(pattern)}) AS ps FROM d), generate_series(1, len(ms)) AS g(k)) WHERE {keep}"""

    shape = "CASE " + " ".join(f"WHEN regexp_matches(v, {q(p)}) THEN {q(k)}" for k, p in SHAPES.items()) + " END"
    allowed = " OR ".join(f"regexp_matches(v, {q(p)})" for p in ALLOWED)
    units = "[" + ", ".join(map(str, UNITS)) + "]"
    limit = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMIT.items()) + " END"
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {KINDS.index(k)}" for k in BITS) + " END"
    joined = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e){where}, '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({spans("assign", ASSIGN, 2, "length(v) >= 6")} UNION ALL {spans("access", ACCESS, 0, "length(m) >= 20")} UNION ALL {spans("hex", HEX, 0, "length(m) >= 24")}),
    cand AS (SELECT rid, s, e, v, {shape} AS kind FROM ({spans("candidate", CANDIDATE, 0, "true")}) WHERE NOT ({allowed})),
    windows AS (SELECT rid, s, e, kind, substr(v, i::INTEGER, {WINDOW}) AS w FROM cand, generate_series(1, length(v) - {WINDOW - 1}) AS g(i)),
    rated AS (SELECT rid, s, e, kind, min(list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ({units})[{WINDOW} - length(replace(w, c, '')) + 1]))) AS u FROM windows GROUP BY ALL),
    added AS (SELECT rid, {order} AS o, kind, s, e FROM rated WHERE u <= {limit} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = rated.rid AND b.s <= rated.s AND b.e >= rated.e)),
    spans AS (SELECT rid, o, kind, s, e FROM base UNION ALL SELECT * FROM added),
    sums AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, {joined(" FILTER (o < 3)")} AS base_list, {joined("")} AS list FROM spans GROUP BY rid)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base_list, '')) AS base_sha256, coalesce(list, '') AS spans FROM d LEFT JOIN sums USING (rid)"""


SQL = _sql()
