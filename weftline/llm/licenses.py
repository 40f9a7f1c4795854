"""License scans in DataFrame functions only: ordered signature rules over normalised words.

A rule has keywords, an expression, a label, a confidence and a priority (its place in the table). Only rules of which
a keyword stands in the text are tried. Of overlapping detections those that lie within another are suppressed; of equal
intervals the rule of higher priority stays."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .secrets import folded, once, places

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
PHRASE_CONFIDENCE = 0.7

#: Families: label, keyword, expressions of the name (one space between words), versions.
FAMILIES = [
    ("agpl", "affero", "(?:gnu )?affero general public license|gnu affero gpl", "1.0 3.0"),
    ("agpl", "agpl", "(?:gnu )?agpl", "1.0 3.0"),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public license", "2.0 2.1 3.0"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("gpl", "general", "(?:gnu )?general public license", "1.0 2.0 3.0"),
    ("gpl", "gpl", "(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("gfdl", "documentation", "(?:gnu )?free documentation license", "1.1 1.2 1.3"),
    ("apache", "apache", "apache (?:software )?license", "1.0 1.1 2.0"),
    ("mpl", "mozilla", "mozilla public license", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public license", "1.0 2.0"),
    ("cddl", "distribution", "common development and distribution license", "1.0 1.1"),
    ("cpl", "common", "common public license", "0.5 1.0"),
    ("eupl", "union", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("osl", "open", "open software license", "1.0 2.0 2.1 3.0"),
    ("afl", "academic", "academic free license", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", "artistic license", "1.0 2.0"),
    ("zpl", "zope", "zope public license", "1.1 2.0 2.1"),
    ("lppl", "latex", "latex project public license", "1.0 1.1 1.2 1.3"),
    ("php", "php", "php license", "3.0 3.01"),
    ("psf", "python", "python (?:software foundation )?license", "2.0"),
    ("apsl", "apple", "apple public source license", "1.0 1.1 1.2 2.0"),
    ("cecill", "cecill", "cecill(?: free software)?(?: license)?", "1.0 2.0 2.1"),
    ("ofl", "open", "(?:sil )?open font license", "1.0 1.1"),
    ("ecl", "educational", "educational community license", "1.0 2.0"),
    ("bsl", "boost", "boost software license", "1.0"),
    ("odbl", "database", "open database license", "1.0"),
    ("pddl", "dedication", "public domain dedication and license", "1.0"),
    ("cc0", "cc0", "cc0", "1.0"),
    ("cc-by-nc-sa", "cc", "(?:cc|creative commons) by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc", "(?:cc|creative commons) by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc", "(?:cc|creative commons) by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc", "(?:cc|creative commons) by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc", "(?:cc|creative commons) by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "cc", "(?:cc|creative commons) by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non(?: )?commercial share(?: )?alike(?: license)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s(?: license)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "commons", "creative commons attribution non(?: )?commercial(?: license)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "commons", "creative commons attribution share(?: )?alike(?: license)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "commons", "creative commons attribution no(?: )?deriv(?:ative)?s(?: license)?", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "commons", "creative commons attribution(?: license)?", "1.0 2.0 2.5 3.0 4.0"),
    ("bsd-2-clause", "bsd", "bsd 2 clause(?: license)?|2 clause bsd(?: license)?|simplified bsd license|freebsd license", ""),
    ("bsd-3-clause", "bsd", "bsd 3 clause(?: license)?|3 clause bsd(?: license)?|new bsd license|modified bsd license|revised bsd license", ""),
    ("bsd-4-clause", "bsd", "bsd 4 clause(?: license)?|4 clause bsd(?: license)?|original bsd license", ""),
    ("0bsd", "bsd", "bsd zero clause(?: license)?|zero clause bsd(?: license)?", ""),
    ("bsd", "bsd", "bsd (?:style )?license", ""),
    ("mit-0", "mit", "mit no attribution(?: license)?", ""),
    ("mit", "mit", "(?:the )?mit license|mit x11 license|expat license", ""),
    ("isc", "isc", "(?:the )?isc license", ""),
    ("zlib", "zlib", "zlib license|zlib libpng license", ""),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "public", "do what the fuck you want to public license", ""),
    ("ms-pl", "microsoft", "microsoft public license", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal license", ""),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", ""),
    ("postgresql", "postgresql", "postgresql license", ""),
    ("openssl", "openssl", "openssl license", ""),
    ("vim", "vim", "vim license", ""),
    ("ruby", "ruby", "ruby license", ""),
    ("public-domain", "domain", "public domain", ""),
]
#: Texts and notices with a label of their own: label, keyword, expression, confidence.
NOTICES = [
    ("all-rights-reserved", "reserved", "all rights reserved", 0.6),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 0.4),
    ("proprietary", "proprietary", "proprietary and confidential", 0.9),
    ("proprietary", "proprietary", "(?:this is )?proprietary software", 0.8),
    ("proprietary", "permission", "may not be (?:copied|reproduced|distributed|used)(?: or (?:copied|reproduced|distributed|used))? without (?:the )?(?:prior )?(?:written )?permission", 0.8),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty", 0.8),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0.95),
    ("apache-2.0", "apache", "www apache org licenses license 2 0", 0.95),
    ("gpl-3.0", "gnu", "www gnu org licenses gpl 3 0", 0.95),
    ("gpl", "gnu", "www gnu org licenses gpl", 0.8),
    ("mpl-2.0", "mozilla", "mozilla org mpl 2 0", 0.95),
    ("no-license", "license", "no license (?:is )?granted", 0.7),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 (?:the license )?you may not use this file except in compliance with the license", 0.98),
    ("apache-2.0", "apache", "you may obtain a copy of the license at https? www apache org licenses license 2 0", 0.98),
    ("gpl-2.0-or-later", "foundation", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 0.98),
    ("gpl-3.0-or-later", "foundation", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.98),
    ("lgpl-2.1-or-later", "foundation", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", 0.98),
    ("lgpl-3.0-or-later", "foundation", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.98),
    ("agpl-3.0-or-later", "foundation", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.98),
    ("gpl-2.0-only", "foundation", "gnu general public license version 2 as published by the free software foundation", 0.95),
    ("gpl-3.0-only", "foundation", "gnu general public license version 3 as published by the free software foundation", 0.95),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose", 0.6),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license", 0.85),
    ("lgpl", "gnu", "you should have received a copy of the gnu lesser general public license", 0.85),
    ("agpl", "gnu", "you should have received a copy of the gnu affero general public license", 0.85),
    ("classpath-exception", "exception", "(?:with the )?classpath exception(?: 2 0)?", 0.9),
    ("classpath-exception", "exception", "as a special exception the copyright holders? of this library give you permission to link this library with independent modules", 0.95),
    ("gcc-exception", "exception", "gcc runtime library exception", 0.9),
    ("llvm-exception", "exception", "(?:with )?llvm exceptions?", 0.9),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.98),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.95),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 0.9),
    ("bsd-3-clause", "endorse", "neither the name of (?:[a-z0-9]+ ){1,8}nor the names of (?:its|any) contributors may be used to endorse or promote products derived from this software", 0.97),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 0.97),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software", 0.9),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 0.95),
    ("zlib", "plainly", "altered source versions must be plainly marked as such", 0.9),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0", 0.98),
    ("bsl-1.0", "boost", "www boost org license 1 0 txt", 0.95),
    ("epl-2.0", "eclipse", "www eclipse org legal epl 2 0", 0.95),
    ("epl-1.0", "eclipse", "www eclipse org legal epl v10", 0.95),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 0.95),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0", 0.95),
    ("cc-by-sa-4.0", "creativecommons", "creativecommons org licenses by sa 4 0", 0.95),
    ("cc-by-nc-4.0", "creativecommons", "creativecommons org licenses by nc 4 0", 0.95),
    ("cc-by-nc-sa-4.0", "creativecommons", "creativecommons org licenses by nc sa 4 0", 0.95),
    ("cc-by-nd-4.0", "creativecommons", "creativecommons org licenses by nd 4 0", 0.95),
    ("cc-by-nc-nd-4.0", "creativecommons", "creativecommons org licenses by nc nd 4 0", 0.95),
    ("unlicense", "unlicense", "unlicense org", 0.95),
    ("mit", "opensource", "opensource org licenses mit", 0.95),
    ("bsd-3-clause", "opensource", "opensource org licenses bsd 3 clause", 0.95),
    ("bsd-2-clause", "opensource", "opensource org licenses bsd 2 clause", 0.95),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document)", 0.8),
    ("proprietary", "confidential", "confidential and proprietary(?: information)?", 0.8),
    ("non-commercial", "commercial", "(?:for )?non commercial (?:use|purposes) only", 0.7),
    ("research-only", "research", "for (?:academic |non commercial )?research (?:use|purposes) only", 0.7),
]
GRANT = "(?:(?:is )?(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?)"


def _version(v: str) -> str:
    major, minor = v.split(".")
    return f"(?:version |v)?{major}(?: {minor})?" if minor == "0" else f"(?:version |v)?{major} {minor}"


#: Families whose licences say whether later versions hold too.
LATER = ("agpl", "lgpl", "gpl", "gfdl")


def rules() -> list[tuple[str, float, str, str, str]]:
    """(label, confidence, keyword, expression, name) by priority: identifiers, granted and plain names with a version, names
    without, notices. The name stands in whatever the expression finds."""
    out = []
    labels = dict.fromkeys((label, f"{label}-{v}" if v else label) for label, _, _, versions in FAMILIES for v in (versions.split() or [""]))
    for family, label in labels:
        ident = re.sub(r"[^a-z0-9]+", " ", label)
        for more, words in (("-or-later", " or later"), ("-only", " only"), ("", "")) if family in LATER else (("", ""),):
            out.append((label + more, 1.0, "spdx", f"spdx license identifier {ident}{words}", "spdx license identifier"))
    for granted, confidence in ((GRANT, 0.95), ("", 0.85)):
        for label, keyword, name, versions in FAMILIES:
            for v in versions.split():
                out.append((f"{label}-{v}", confidence, keyword, f"{granted}(?:{name}) {_version(v)}", name))
                if label in LATER:
                    out.append((f"{label}-{v}-or-later", confidence, keyword, f"{granted}(?:{name}) {_version(v)} or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", name))
                    out.append((f"{label}-{v}-only", confidence, keyword, f"{granted}(?:{name}) {_version(v)} only", name))
    for granted, confidence in ((GRANT, 0.8), ("", 0.6)):
        for label, keyword, name, _ in FAMILIES:
            out.append((label, confidence, keyword, f"{granted}(?:{name})", name))
    return out + [(label, confidence, keyword, text, text) for label, keyword, text, confidence in NOTICES]


def spaced(expression: str) -> str:
    """The expression over words that stand with a space on either side of each: single spaces become two."""
    return " " + expression.replace(" ", "  ") + " "


def _whole(expression: str) -> str:
    return " (?:" + spaced(expression)[1:-1] + ") "


RULES = [(label, confidence, f" {keyword} ", _whole(expression)) for label, confidence, keyword, expression, _ in rules()]


#: Keywords besides a family's own, of alternatives that don't hold it.
OTHER = {"(?:cc|creative commons) by": "commons", "freebsd license": "freebsd", "expat license": "expat"}
#: For each rule the words of which one stands in whatever its expression finds.
KEYWORDS = [[k, *(f" {other} " for part, other in OTHER.items() if spaced(part)[1:-1] in e)] for _, _, k, e in RULES]


#: The names, which stand as literals in the plan; GROUP is each rule's.
NAMES = list(dict.fromkeys(_whole(name) for *_, name in rules()))
GROUP = [NAMES.index(_whole(name)) for *_, name in rules()]


def trie(words: list[str]) -> str:
    """An expression of the given words that shares their beginnings, so few alternatives are tried at any place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    end = "" in heads
    parts = [h + trie(rest) for h, rest in heads.items() if h]
    body = parts[0] if len(parts) == 1 and not end else f"(?:{'|'.join(parts)})" if parts else ""
    return body + ("?" if end and parts else "")


#: What a text without any keyword lacks.
ANY = f" {trie(list(dict.fromkeys([*(k.strip() for ks in KEYWORDS for k in ks), 'license'])))} "


def normalised(text: Column) -> Column:
    """Lower-case (A-Z only) words, each with one space before and one after it, and one more space at either end."""
    return F.regexp_replace(F.concat(F.lit("."), F.translate(text, UPPER, LOWER), F.lit(".")), BREAKS, "  ")


def _spaces(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(" "), F.lit("")))


def _words(value: Column) -> Column:
    """Words in a run of whole words; the one space more at the text's head doesn't count."""
    return F.floor(_spaces(value) / 2).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``base``: places (start, end, label) of the fixed phrases, ``detections``: (start, end, rule, label,
    confidence) of the rules that stay, by start; positions count words from 0.

    A null text is the empty one and has no words; repeated rows are each scanned; an empty table gives no rows."""
    p = F.col("padded")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    base_of = lambda phrase, label: F.transform(F.when(p.contains(spaced(phrase)), places(p, spaced(phrase), measure=_words)).otherwise(none), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(label).alias("label")))
    base = F.concat(*(base_of(k, v) for k, v in PHRASES.items()))
    table = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(c).alias("confidence"), F.lit(GROUP[i]).alias("group"), F.lit(e).alias("expression")) for i, (label, c, _, e) in enumerate(RULES)))

    def tried(r: Column) -> Column:
        named = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence"))
        return F.transform(places(p, r["expression"], measure=_words), named)

    # keywords first, then the name, whose expression is compiled once; rules are tried only where their name stands
    named_by = {g: dict.fromkeys(k for i, at in enumerate(GROUP) if at == g for k in KEYWORDS[i]) for g in range(len(NAMES))}
    held = lambda g: reduce(or_, (p.contains(k) for k in named_by[g])) & p.rlike(NAMES[g])
    groups = F.filter(F.array(*(F.when(held(g), F.lit(g)) for g in range(len(NAMES)))), lambda g: g.isNotNull())
    able = lambda found: F.filter(table, lambda r: F.array_contains(found, r["group"]) & F.rlike(p, r["expression"]))
    nothing = F.array().cast("array<struct<start:int,end:int,rule:int,label:string,confidence:double>>")
    raw = F.when(p.rlike(ANY), once(groups, lambda found: F.when(F.size(found) > 0, F.flatten(F.transform(able(found), tried))).otherwise(nothing))).otherwise(nothing)
    ranked = F.array_sort(F.transform(raw, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["rule"].alias("rule"), d["label"].alias("label"), d["confidence"].alias("confidence"))))

    def sweep(reach: Column, d: Column) -> tuple[Column, Column]:
        one = F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["rule"].alias("rule"), d["label"].alias("label"), d["confidence"].alias("confidence"))
        stays = -d["back"] > reach  # those before start no later, so one that reaches as far contains it
        return F.greatest(reach, -d["back"]), F.when(stays, F.array(one)).otherwise(nothing)

    out = texts(docs).select("doc_id", normalised(F.col("text")).alias("padded"))
    out = out.select("doc_id", (_spaces(p) / 2 - 1).cast("long").alias("n_words"), base.alias("base"), ranked.alias("ranked"))
    return out.select("doc_id", "n_words", "base", folded(F.col("ranked"), F.lit(0), sweep, "struct<start:int,end:int,rule:int,label:string,confidence:double>").alias("detections"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, kept = F.col("base"), F.col("detections")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform(base, lambda b: b["start"])
    best = F.greatest(F.coalesce(F.array_max(F.transform(kept, lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size(base) > 0, F.lit(PHRASE_CONFIDENCE)).otherwise(0.0))
    of_base, of_rules = F.transform(base, lambda b: b["label"]), F.transform(kept, lambda d: d["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(of_base).alias("base_labels"),
        names(F.concat(of_base, of_rules)).alias("labels"),
        best.alias("score"),
    )


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"

    def spans(source: str, pattern: str, extra: str) -> str:
        return f"""SELECT rid, {extra}, list_sum(list_transform(ps[1:k], lambda p: {spaces("p")})) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda p: {spaces("p")})), 0) AS s, {spaces("ms[k]")} AS n
            FROM (SELECT *, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS ps FROM {source}), generate_series(1, len(ms)) AS g(k)"""

    base = " UNION ALL ".join(spans(f"(SELECT *, {q(v)} AS label FROM d)", q(spaced(k)), "label") for k, v in PHRASES.items())
    values = ", ".join(f"({i}, {q(label)}, {c}::DOUBLE, [{', '.join(map(q, KEYWORDS[i]))}], {q(e)})" for i, (label, c, _, e) in enumerate(RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace('.' || translate(coalesce(text, ''), {q(UPPER)}, {q(LOWER)}) || '.', {q(BREAKS)}, '  ', 'g') AS t FROM documents),
    rules(rule, label, confidence, keywords, expression) AS (VALUES {values}),
    base AS ({base}),
    tried AS (SELECT rid, t, rule, label, confidence, expression FROM (SELECT * FROM d WHERE regexp_matches(t, {q(ANY)})) JOIN rules ON len(list_filter(keywords, lambda k: contains(t, k))) > 0),
    raw AS ({spans("tried", "expression", "rule, label, confidence")}),
    swept AS (SELECT *, max(s + n) OVER (PARTITION BY rid ORDER BY s, s + n DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM raw),
    kept AS (SELECT * FROM swept WHERE s + n > coalesce(reach, 0)),
    b AS (SELECT rid, count(*) AS c, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM base GROUP BY rid),
    a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS names, max(confidence) AS best FROM (SELECT rid, label, {PHRASE_CONFIDENCE}::DOUBLE AS confidence FROM base UNION ALL SELECT rid, label, confidence FROM kept) GROUP BY rid)
    SELECT doc_id, {spaces("t")} - 1 AS n_words, coalesce(b.c, 0) AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(b.names, '') AS base_labels, coalesce(a.names, '') AS labels, coalesce(a.best, 0)::DOUBLE AS score
    FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""


SQL = _sql()
