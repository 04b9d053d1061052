"""Licence statements in texts by ordered signature rules, as column expressions only.

A signature is a regular expression over the words of a text in lower case, joined by single blanks.  It starts with a literal word, its
anchor.  A keyword prefilter on the raw text decides which texts are split into words at all; in these, anchors are looked up and only the
signatures of that anchor are tried on the words that follow.  Of several detections at one place the one of highest priority, then the
longest, is taken; a detection inside the interval of another of equal or higher priority is suppressed.

Four plain phrases (``BASE``) are counted besides, whatever the suppression does with them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SPAN = 16  # words a signature may cover
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of raw text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A text without any of these has no anchor that a signature could continue.
KEYWORDS = ["licen", "copyright", "spdx", "public domain", "copyleft", "all rights reserved", "as is", "warrant", "permission is hereby", "redistribut", "creative commons", "unlicense",
            "proprietary", "confidential", "wtfpl", "gpl", "bsd", "cc0"]

LIC = "licen[sc]e"
VER = "(?:version |v)?"
# Label, SPDX-like identifier in words, and the name as it is written out.
NAMES: list[tuple[str, str, str]] = [
    ("apache-1.1", "apache 1 1", f"apache (?:software )?{LIC} {VER}1 1"), ("apache-2.0", "apache 2 0", f"apache (?:software )?{LIC} {VER}2(?: 0)?"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", f"gnu general public {LIC} {VER}1"), ("gpl-2.0", "gpl 2 0(?: only| or later)?", f"gnu general public {LIC} {VER}2"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", f"gnu general public {LIC} {VER}3"), ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", f"gnu lesser general public {LIC} {VER}2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", f"gnu lesser general public {LIC} {VER}3"), ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", f"gnu library general public {LIC}(?: {VER}2)?"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", f"gnu affero general public {LIC}(?: {VER}3)?"), ("gfdl", "gfdl 1 [123]", f"gnu free documentation {LIC}"),
    ("mit", "mit", f"mit {LIC}"), ("mit-0", "mit 0", f"mit no attribution {LIC}"), ("x11", "x11", f"x11 {LIC}"), ("expat", "expat", f"expat {LIC}"),
    ("bsd-2-clause", "bsd 2 clause", f"bsd 2 clause(?: {LIC})?"), ("bsd-3-clause", "bsd 3 clause", f"bsd 3 clause(?: {LIC})?"), ("bsd-4-clause", "bsd 4 clause", f"bsd 4 clause(?: {LIC})?"),
    ("bsd-0-clause", "0bsd", f"zero clause bsd {LIC}"), ("bsd", "bsd", f"bsd {LIC}"), ("isc", "isc", f"isc {LIC}"), ("zlib", "zlib", f"zlib {LIC}"), ("boost", "bsl 1 0", f"boost software {LIC}"),
    ("mpl-1.1", "mpl 1 1", f"mozilla public {LIC} {VER}1 1"), ("mpl-2.0", "mpl 2 0", f"mozilla public {LIC}(?: {VER}2(?: 0)?)?"), ("epl-1.0", "epl 1 0", f"eclipse public {LIC} {VER}1(?: 0)?"),
    ("epl-2.0", "epl 2 0", f"eclipse public {LIC}(?: {VER}2(?: 0)?)?"), ("cddl", "cddl 1 [01]", f"common development and distribution {LIC}"), ("eupl", "eupl 1 [12]", f"european union public {LIC}"),
    ("artistic", "artistic [12] 0", f"artistic {LIC}"), ("python", "psf 2 0|python 2 0", f"python software foundation {LIC}"), ("php", "php 3 01?", f"php {LIC}"), ("ruby", "ruby", f"ruby {LIC}"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "do what the fuck you want to public licen[sc]e"), ("cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by [1-4] [05]", "cc by(?: [1-4] [05])?"), ("cc-by-sa", "cc by sa [1-4] [05]", "cc by sa(?: [1-4] [05])?"), ("cc-by-nc", "cc by nc [1-4] [05]", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd [1-4] [05]", "cc by nd(?: [1-4] [05])?"), ("cc-by-nc-sa", "cc by nc sa [1-4] [05]", "cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc-nd", "cc by nc nd [1-4] [05]", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "cc by", "creative commons attribution(?: [1-4] 0)?(?: international)?"), ("cc-by-sa", "cc by sa", "creative commons attribution share ?alike"),
    ("cc-by-nc", "cc by nc", "creative commons attribution non ?commercial"), ("odbl", "odbl 1 0", f"open (?:data commons open )?database {LIC}"), ("ofl", "ofl 1 1", f"sil open font {LIC}"),
    ("ncsa", "ncsa", f"university of illinois ncsa open source {LIC}"), ("postgresql", "postgresql", f"postgresql {LIC}"), ("openssl", "openssl", f"openssl {LIC}"), ("afl", "afl 3 0", f"academic free {LIC}"),
    ("ms-pl", "ms pl", f"microsoft public {LIC}"), ("ms-rl", "ms rl", f"microsoft reciprocal {LIC}"), ("osl", "osl 3 0", f"open software {LIC}"), ("qpl", "qpl 1 0", f"q public {LIC}"), ("busl", "busl 1 1", f"business source {LIC}"),
]
# Verbs that lead into a name, and the words between.
LEADS = ["licensed", "released", "distributed", "available", "published", "provided", "covered", "governed"]
INTO = "(?:is )?(?:under|by|with) (?:the )?(?:terms of )?(?:the )?"
# Signatures of licence texts and notices: label, expression, priority.
NOTICES: list[tuple[str, str, int]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7), ("isc", "permission to use copy modify and or distribute this software", 7),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7), ("bsd", "redistributions of source code must retain the above copyright notice", 6),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 6), ("bsd-3-clause", "neither the name of (?:\\S+ ){1,8}nor the names of", 6),
    ("apache-2.0", "you may not use this file except in compliance with the license", 7), ("apache-2.0", "unless required by applicable law or agreed to in writing software", 6),
    ("gpl", "this program is free software you can redistribute it", 6), ("gpl", "this library is free software you can redistribute it", 6), ("gpl", "free software foundation inc", 3),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", 7), ("unlicense", "this is free and unencumbered software released into the public domain", 7),
    ("public-domain", "released into the public domain", 5), ("public-domain", "dedicated to the public domain", 5), ("public-domain", "placed in the public domain", 5), ("public-domain", "public domain dedication", 4),
    ("zlib", "this software is provided as is without any express or implied warranty", 5), ("no-warranty", "without warranty of any kind", 3), ("no-warranty", "without any warranty", 3),
    ("all-rights-reserved", "all rights reserved", 2), ("proprietary", "proprietary and confidential", 4), ("proprietary", "confidential and proprietary", 4), ("copyleft", "copyleft", 1),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 2), ("gpl", "gplv1", 3), ("gpl", "gplv2", 3), ("gpl", "gplv3", 3), ("lgpl", "lgplv2", 3), ("lgpl", "lgplv3", 3), ("agpl", "agplv3", 3), ("gpl", "gnu gpl(?: v?[123])?", 4), ("lgpl", "gnu lgpl(?: v?[23])?", 4),
]


@dataclass(frozen=True)
class Rule:
    anchor: str
    pattern: str  # of the words that follow each other, the anchor first, each with a blank after it
    label: str
    priority: int
    weight: float
    base: bool = False


def _rule(label: str, pattern: str, priority: int, base: bool = False) -> Rule:
    anchor = re.match(r"[a-z0-9]+(?=$| |\(\?: )", pattern)
    if not anchor:
        raise ValueError(f"signature {pattern!r} does not start with a whole literal word")
    return Rule(anchor[0], f"^(?:{pattern}) ", label, priority, min(1.0, 0.3 + priority / 10), base)


def rules() -> list[Rule]:
    """All signatures: the base phrases, the notices, and each name by itself, after each verb, as a field and as an identifier."""
    out = [_rule(label, phrase, 5, True) for phrase, label in BASE.items()]
    out += [_rule(label, pattern, priority) for label, pattern, priority in NOTICES]
    for label, spdx, name in NAMES:
        out.append(_rule(label, name, 6 if name[0] not in "(" else 5))
        out += [_rule(label, f"{lead} {INTO}{name}", 8) for lead in LEADS]
        out += [_rule(label, f"{field} (?:is )?(?:the )?{name}", 7) for field in ("license", "licence")]
        out.append(_rule(label, f"spdx license identifier (?:{spdx})", 9))
    return out


def _rule_table(found: list[Rule]) -> Column:
    """Map from anchor to its signatures."""
    by: dict[str, list[Rule]] = {}
    for r in found:
        by.setdefault(r.anchor, []).append(r)
    parts: list[Column] = []
    for anchor, own in sorted(by.items()):
        parts += [F.lit(anchor), F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(r.base).alias("base"))
                                           for r in own])]
    return F.create_map(*parts)


def gate(text: Column) -> Column:
    """True for texts that may hold a signature: a keyword, or `cc` and `by` with nothing but separators between."""
    low = F.lower(text)
    found = F.rlike(low, F.lit(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))
    for k in KEYWORDS:
        found = F.contains(low, F.lit(k)) | found
    # phrases of several words may be parted by any separators
    return found | F.rlike(low, F.lit(r"public[\x00-\x2F\x3A-\x60\x7B-\x7F]+domain|all[\x00-\x2F\x3A-\x60\x7B-\x7F]+rights|creative[\x00-\x2F\x3A-\x60\x7B-\x7F]+commons|permission[\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:is|to)|neither[\x00-\x2F\x3A-\x60\x7B-\x7F]+the|unless[\x00-\x2F\x3A-\x60\x7B-\x7F]+required|free[\x00-\x2F\x3A-\x60\x7B-\x7F]+software"))


def scan(df: DataFrame, found: list[Rule] | None = None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row.

    Places are word numbers from 0.  A null or empty text has no words, no detections, empty label lists and score 0; repeated rows are
    scanned each; further columns are ignored.  ``detections`` lists what suppression left: start, end, label, priority.
    """
    found = found or rules()
    table = _rule_table(found)
    anchors = F.array(*[F.lit(a) for a in sorted({r.anchor for r in found})])
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.select(F.col(key).alias("doc_id"), t.alias("_text"))
    out = out.select("doc_id", F.regexp_count("_text", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate(F.col("_text")), F.col("_text")).alias("_text"))
    plain = F.trim(F.regexp_replace(F.translate("_text", UPPER, LOWER), NO_WORD, " "))
    out = out.withColumn("_words", F.when(F.col("_text").isNotNull(), F.split(plain, " ", -1)))
    places = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: F.array_contains(anchors, x["w"]))
    out = out.withColumn("_places", places)
    tails = F.transform("_places", lambda x: F.struct(x["at"].alias("at"), x["w"].alias("w"), F.concat(F.array_join(F.slice(F.col("_words"), x["at"] + 1, SPAN), " "), F.lit(" ")).alias("tail")))
    hits = F.transform(tails, lambda x: F.transform(table[x["w"]], lambda r: F.struct(
        x["at"].alias("start"), F.call_function("regexp_extract", x["tail"], r["pattern"], F.lit(0)).alias("hit"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), r["base"].alias("base"))))
    # per place: the hits, later reduced to the best
    out = out.withColumn("_hits", F.filter(F.transform(hits, lambda h: F.filter(h, lambda x: x["hit"] != "")), lambda h: F.size(h) > 0)).drop("_places", "_words", "_text")
    every = F.flatten("_hits")
    base = F.filter(every, lambda x: x["base"])
    out = out.withColumn("_base", base)
    best = F.transform("_hits", lambda h: F.array_max(F.transform(h, lambda x: F.struct(
        x["priority"].alias("priority"), (F.length(x["hit"]) - F.length(F.replace(x["hit"], F.lit(" "), F.lit("")))).alias("size"), x["label"].alias("label"), x["weight"].alias("weight"), x["start"].alias("start")))))
    out = out.withColumn("_best", best)
    # places ascend, so whatever contains a detection is among the SPAN entries before it
    left = F.filter("_best", lambda x, i: ~F.exists(
        F.when(i > 0, F.slice(F.col("_best"), F.greatest(F.lit(1), i - SPAN + 1), F.least(i, F.lit(SPAN)))).otherwise(F.slice(F.col("_best"), 1, 0)),
        lambda y: (y["start"] + y["size"] >= x["start"] + x["size"]) & (y["priority"] >= x["priority"])))
    out = out.withColumn("_left", left)
    names = lambda c: F.array_sort(F.array_distinct(c))
    base_labels, own = F.transform("_base", lambda x: x["label"]), F.transform("_left", lambda x: x["label"])
    return out.select(
        "doc_id", "n_words", F.coalesce(F.when(F.col("_base").isNotNull(), F.size("_base")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["start"])).cast("long").alias("first_word"), F.array_max(F.transform("_base", lambda x: x["start"])).cast("long").alias("last_word"),
        F.coalesce(F.array_join(names(base_labels), ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join(names(F.concat(base_labels, own)), ","), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_left", lambda x: x["weight"])), F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join(F.transform("_left", lambda x: F.concat_ws(":", x["start"], x["start"] + x["size"], x["label"], x["priority"])), ","), F.lit("")).alias("detections"))


def sql() -> str:
    """The same as SQL, without gate and anchors: every signature is tried on whole texts, and at every word of those it matches."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quote(r.pattern)}, {quote(r.label)}, {r.priority}, {r.weight!r}::DOUBLE, {r.base})" for r in rules())
    return rf"""
WITH rules(pattern, label, priority, weight, base) AS (VALUES {values}),
low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, CASE WHEN trim(regexp_replace(t, '{NO_WORD}', ' ', 'g')) = '' THEN []::VARCHAR[] ELSE string_split(trim(regexp_replace(t, '{NO_WORD}', ' ', 'g')), ' ') END AS words FROM low),
likely AS MATERIALIZED (SELECT w.doc_id, w.words, r.* FROM w, rules r WHERE regexp_matches(' ' || array_to_string(w.words, ' ') || ' ', replace(r.pattern, '^', ' '))),
h AS (SELECT doc_id, start, label, priority, weight, base, regexp_extract(array_to_string(words[start + 1:start + {SPAN}], ' ') || ' ', pattern) AS hit FROM (SELECT *, unnest(range(len(words))) AS start FROM likely)),
d AS (SELECT *, length(hit) - length(replace(hit, ' ', '')) AS size FROM h WHERE hit <> ''),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY priority DESC, size DESC, label DESC, weight DESC) = 1),
rest AS (SELECT * FROM best x WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.doc_id = x.doc_id AND y.start < x.start AND y.start >= x.start - {SPAN} AND y.start + y.size >= x.start + x.size AND y.priority >= x.priority)),
b AS (SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM d WHERE base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT doc_id, label FROM rest UNION SELECT doc_id, label FROM d WHERE base) GROUP BY doc_id),
m AS (SELECT doc_id, max(weight) AS score, string_agg(concat_ws(':', start, start + size, label, priority), ',' ORDER BY start) AS found FROM rest GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word, coalesce(b.names, '') AS base_labels, coalesce(l.names, '') AS labels,
       coalesce(m.score, 0.0)::DOUBLE AS score, coalesce(m.found, '') AS detections
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)
"""
