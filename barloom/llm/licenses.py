"""License scans with ordered signature rules (operator 7).

A keyword prefilter on the whole text decides which documents are split into words. Every rule starts
with one of a few start words, so a rule is tried only where such a word stands, on the next
``REACH`` words. Detections are sorted by (start, longest first, highest priority first); one that lies
inside an earlier detection of at least its own priority is suppressed. As that needs only the farthest
end per priority so far, one pass with a state of fixed size resolves a document of any length. There is
no shuffle: the scan is one projection.

Defined cases: null text is empty; an empty or unmatched text has no labels, score 0 and null places;
repeated rows are scanned each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import ascii_lower, bind

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Base phrases, found word by word.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
REPEATS = 4  # times that an open repetition counts towards a rule's length


@dataclass(frozen=True)
class Rule:
    """``pattern`` must match the words from the start word on, joined by single spaces, as whole words."""

    label: str
    priority: int  # 3: names one license and version, 2: names a family, 1: only hints
    start: str
    pattern: str
    score: float


#: In order: of two detections with the same place and priority the earlier rule wins.
RULES = [
    Rule("spdx-tag", 3, "spdx", "spdx license identifier [^ ]+( [0-9]+)*( (only|or later))?", 1.0),
    Rule("apache-2.0", 3, "apache", "apache( software)? license( v| version)? ?2( 0)?", 1.0),
    Rule("apache-2.0", 3, "apache", "apache 2( 0)?", 0.9),
    Rule("apache", 2, "apache", "apache( software)? license", 0.8),
    Rule("mit", 3, "mit", "mit license", 1.0),
    Rule("mit", 2, "mit", "mit licensed", 0.8),
    Rule("mit", 3, "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    Rule("isc", 3, "isc", "isc license", 1.0),
    Rule("bsd-3-clause", 3, "bsd", "bsd 3 clause( license)?", 1.0),
    Rule("bsd-2-clause", 3, "bsd", "bsd 2 clause( license)?", 1.0),
    Rule("bsd", 2, "bsd", "bsd( style)? license", 0.8),
    Rule("bsd", 2, "redistribution", "redistribution and use in source and binary forms", 0.9),
    Rule("agpl", 3, "gnu", "gnu affero general public license( v| version)?( ?3)?( 0)?", 1.0),
    Rule("lgpl", 3, "gnu", "gnu (lesser|library) general public license( v| version)?( ?[23])?( [01])?", 1.0),
    Rule("gpl-3.0", 3, "gnu", "gnu( general public license| gpl)( v| version)? ?3( 0)?", 1.0),
    Rule("gpl-2.0", 3, "gnu", "gnu( general public license| gpl)( v| version)? ?2( 0)?", 1.0),
    Rule("gpl", 2, "gnu", "gnu( general public license| gpl)", 0.8),
    Rule("gpl", 2, "general", "general public license", 0.8),
    Rule("mpl-2.0", 3, "mozilla", "mozilla public license( v| version)? ?2( 0)?", 1.0),
    Rule("mpl", 2, "mozilla", "mozilla public license", 0.8),
    Rule("epl", 2, "eclipse", "eclipse public license( v| version)?( ?[12])?( 0)?", 0.9),
    Rule("cc0", 3, "cc0", "cc0( 1 0)?( universal)?", 0.9),
    Rule("cc-by-nc-nd", 3, "cc", "cc by nc nd( [1-4] [05])?", 1.0),
    Rule("cc-by-nc-sa", 3, "cc", "cc by nc sa( [1-4] [05])?", 1.0),
    Rule("cc-by-nc", 3, "cc", "cc by nc( [1-4] [05])?", 1.0),
    Rule("cc-by-sa", 3, "cc", "cc by sa( [1-4] [05])?", 1.0),
    Rule("cc-by-nd", 3, "cc", "cc by nd( [1-4] [05])?", 1.0),
    Rule("cc-by", 2, "cc", "cc by( [1-4] [05])?", 0.8),
    Rule("cc", 1, "creative", "creative commons( attribution)?( (share ?alike|non ?commercial|no ?derivatives))*( license)?", 0.6),
    Rule("public-domain", 2, "public", "public domain", 0.5),
    Rule("unlicense", 3, "unlicense", "unlicense", 0.8),
    Rule("proprietary", 2, "proprietary", "proprietary and confidential", 0.8),
    Rule("reserved", 2, "all", "all rights reserved", 0.8),
    Rule("license-mention", 1, "licensed", "licensed under( the| a)?( terms of)?( the)?( [^ ]+){1,3}", 0.3),
    Rule("license-mention", 1, "released", "released under( the| a)?( terms of)?( the)?( [^ ]+){1,2} licen[cs]e", 0.3),
]


def longest(pattern: str) -> int:
    """Words that a pattern can span at most (all branches counted)."""

    def spaces(p: str) -> int:
        return p.count(" ") - p.count("[^ ]")

    repeated = re.findall(r"(\((?:[^()]|\([^()]*\))*\))(?:\*|\{\d,(\d)\})", pattern)
    return 1 + spaces(pattern) + sum(spaces(g) * (int(n or REPEATS) - 1) for g, n in repeated)


def opening(pattern: str) -> str:
    """The whole words that every match of a pattern begins with."""
    plain = re.match(r"[a-z0-9 ]*", pattern)[0]
    return plain if plain == pattern or pattern[len(plain):].startswith("( ") else plain.rpartition(" ")[0]


REACH = max(longest(r.pattern) for r in RULES)  # words that a rule can span
#: A text (words joined by single spaces) without any of these matches neither a base phrase nor a rule.
PREFILTER = "(^| )(" + "|".join(sorted({opening(r.pattern) for r in RULES} | set(PHRASES))) + ")"


def _ends(pattern: str) -> str:
    return f"^({pattern})(?= |$)"


def _detections(w: Column) -> Column:
    """Sorted detections of an array of words, each (start, end, priority, rule number)."""
    starts = sorted({r.start for r in RULES})

    def at(word: Column, i: Column) -> Column:
        return F.when(word.isin(starts), F.struct(i.alias("i"), word.alias("word"), F.array_join(F.slice(w, i + 1, F.lit(REACH)), " ").alias("ahead")))

    def tried(hit: Column) -> Column:
        found = []
        for k, r in enumerate(RULES):
            text = F.regexp_extract(hit.ahead, _ends(r.pattern), 1)
            n = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
            found.append(F.when((hit.word == r.start) & (text != ""), F.struct(
                hit.i.alias("first"), (-(hit.i + n)).alias("neg_end"), F.lit(-r.priority).alias("neg_priority"), F.lit(k).alias("rule"))))
        return F.array_compact(F.array(*found))

    hits = F.array_compact(F.transform(w, at))
    return F.array_sort(F.flatten(F.transform(hits, tried)))


def _resolve(found: Column) -> Column:
    """(bit mask of the labels, best score) of the detections that no other one contains."""
    zero = F.struct(*[F.lit(0).alias(f"end{p}") for p in (1, 2, 3)], F.lit(0).cast("long").alias("mask"), F.lit(0.0).alias("score"))
    labels = rule_labels()
    bits = F.array(*[F.lit(1 << labels.index(r.label)).cast("long") for r in RULES])
    scores = F.array(*[F.lit(r.score) for r in RULES])

    def step(a: Column, d: Column) -> Column:
        end, level = -d.neg_end, -d.neg_priority
        covered = (a.end3 >= end) | ((level <= 2) & (a.end2 >= end)) | ((level <= 1) & (a.end1 >= end))
        ends = [F.when(level == p, F.greatest(a[f"end{p}"], end)).otherwise(a[f"end{p}"]).alias(f"end{p}") for p in (1, 2, 3)]
        return F.struct(*ends, F.when(covered, a["mask"]).otherwise(a["mask"].bitwiseOR(F.get(bits, d.rule))).alias("mask"),
                        F.when(covered, a["score"]).otherwise(F.greatest(a["score"], F.get(scores, d.rule))).alias("score"))

    return F.aggregate(found, zero, step, lambda a: F.struct(a["mask"].alias("mask"), a["score"].alias("score")))


def rule_labels() -> list[str]:
    return sorted({r.label for r in RULES})


def _places(w: Column) -> Column:
    """Places of the base phrases as (word number, label)."""

    def at(word: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<i:int,label:string>")
        for phrase, label in PHRASES.items():
            head, *rest = phrase.split(" ")
            match = word == head
            for k, x in enumerate(rest, 1):
                match = match & F.coalesce(F.get(w, i + k) == x, F.lit(False))
            out = F.when(match, F.struct(i.alias("i"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.array_compact(F.transform(w, at))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    low = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    plain = docs.select("doc_id", F.trim(F.regexp_replace(low, NOT_WORD, " ")).alias("_plain"))
    n_words = F.when(F.col("_plain") == "", 0).otherwise(F.length("_plain") - F.length(F.replace(F.col("_plain"), F.lit(" "), F.lit(""))) + 1).cast("long")
    gated = F.when(F.col("_plain").rlike(PREFILTER), F.split("_plain", " ")).otherwise(F.array().cast("array<string>"))
    split = plain.select("doc_id", n_words.alias("n_words"), gated.alias("_w"))
    found = split.select("doc_id", "n_words", bind(F.col("_w"), _places).alias("_base"), bind(bind(F.col("_w"), _detections), _resolve).alias("_out"))
    labels = rule_labels()
    own = F.array_compact(F.array(*[F.when(F.col("_out.mask").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(x)) for k, x in enumerate(labels)]))
    base = F.array_distinct(F.transform("_base", lambda x: x.label))
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x.i)).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x.i)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.col("_out.score").alias("score"))


def oracle_sql() -> str:
    """The same result by joins: every pair of detections is compared."""
    rules = ", ".join(f"({k}, '{r.label}', {r.priority}, '{r.start}', '{_ends(r.pattern).replace('(?= |$)', '( |$)')}', {r.score})" for k, r in enumerate(RULES))
    base = " UNION ALL ".join(
        f"SELECT rid, i, '{label}' AS label FROM w WHERE " + " AND ".join(f"coalesce(ws[i + {k + 1}] = '{x}', false)" for k, x in enumerate(phrase.split(" ")))
        for phrase, label in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
       trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) AS plain FROM documents),
a AS (SELECT rid, doc_id, CASE WHEN plain = '' THEN []::VARCHAR[] ELSE string_split(plain, ' ') END AS ws FROM d),
w AS (SELECT rid, ws, unnest(range(len(ws))) AS i FROM a),
base AS ({base}),
rules(k, label, priority, word, rx, points) AS (VALUES {rules}),
found AS (SELECT rid, i AS s, i + length(m) - length(replace(m, ' ', '')) + 1 AS e, label, priority, k, points
          FROM (SELECT rid, i, label, priority, k, points, regexp_extract(array_to_string(ws[i + 1 : i + {REACH}], ' '), rx, 1) AS m
                FROM w JOIN rules ON ws[i + 1] = word) WHERE m <> ''),
kept AS (SELECT * FROM found a WHERE NOT EXISTS (
          SELECT 1 FROM found b WHERE b.rid = a.rid AND b.s <= a.s AND b.e >= a.e AND b.priority >= a.priority
            AND (b.s < a.s OR b.e > a.e OR b.priority > a.priority OR b.k < a.k))),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS ls FROM base GROUP BY rid),
o AS (SELECT rid, list(DISTINCT label) AS ls, max(points) AS score FROM kept GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b.ls, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(o.ls, [])))), ','), '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM a LEFT JOIN b USING (rid) LEFT JOIN o USING (rid)"""
