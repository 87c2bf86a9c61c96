"""Quality rules with adaptive thresholds (operator 10).

Each document gets a few integer measures. Per (lang, source) a quantile sketch of each measure gives
robust fences, so a source full of tables or of short words sets its own limits. A sketch is a table of
(bucket, count) rows over log-linear buckets of at most 1/16 relative width: sketches merge by adding
counts, so they are built by one partial aggregation whatever the skew, and they never depend on the
partitioning. Everything is DataFrame code; the only row-wise loops are array functions inside a row.

Defined cases: null or blank text has no words and fails the base rule; null lang and null source are
groups of their own; repeated rows are judged alike, each for itself; an empty table gives no rows;
further columns are kept by ``filter_documents``, whatever their names, and ignored by ``verdicts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.text import BLANKS, bind, packed, unpacked, words
from barloom.session import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: measure -> (least distance of a fence from its quartile, is there a lower fence too)
MEASURES = {
    "symbol_rate": (150, False),  # symbols per 1000 words
    "dup_line_rate": (300, False),  # repeated lines per 1000 words
    "repeat_rate": (350, False),  # words in repeated 3-word windows per 1000 words
    "word_length": (40, True),  # tenths of a character
}
FENCE_SPREADS = 6  # distance of a fence from its quartile in interquartile ranges


def _repeat_words(w: Column) -> Column:
    """Words lying in 3-word windows that occur at least twice in the array."""

    def windows(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))
        triples = F.zip_with(pairs, F.slice(h, F.lit(3), F.size(h)), lambda ab, c: F.xxhash64(ab, c))
        return F.slice(triples, F.lit(1), F.size(h) - 2)

    def has_twins(t: Column) -> Column:
        return F.size(F.array_distinct(t)) < F.size(t)

    def covered(t: Column) -> Column:
        by_hash = F.array_sort(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            like_next = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.struct(a.i.alias("i"), a.h.eqNullSafe(b.h).alias("same")))
            return bind(like_next, lambda e: F.zip_with(
                e, F.concat(F.array(F.lit(False)), F.transform(e, lambda x: x.same)),
                lambda x, before: F.when(x.same | before, x.i)))

        starts = F.array_sort(F.array_compact(bind(by_hash, repeated)))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a.n)

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    count = bind(bind(hashes, windows), lambda t: F.when(has_twins(t), covered(t)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(count)


def with_measures(docs: DataFrame) -> DataFrame:
    """The given rows with one struct column ``_m`` of counts and measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    first = docs.withColumn("_w", words(F.col("text"))).withColumn("_lines", lines)
    n = F.size("_w").cast("long")
    counts = first.withColumn("_c", F.struct(
        n.alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"))).drop("_w", "_lines")
    c = F.col("_c")
    per = F.greatest(c.n_words, F.lit(1))

    def rate(x: Column, unit: int) -> Column:
        return F.floor(x * unit / per).cast("long")

    failed = (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > MAX_REPEAT_PERCENT * c.n_words)
    return counts.withColumn("_m", F.struct(
        "_c.*", failed.alias("base_failed"), rate(c.n_symbols, 1000).alias("symbol_rate"), rate(c.n_dup_lines, 1000).alias("dup_line_rate"),
        rate(c.n_repeat_words, 1000).alias("repeat_rate"), rate(c.word_chars, 10).alias("word_length"))).drop("_c")


def bucket(v: Column) -> Column:
    """Log-linear bucket of a non-negative long: exact below 32, then 16 buckets per power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (shift * 16 + F.call_function("shiftright", v, shift)).cast("int")


def bucket_top(b: Column) -> Column:
    """Largest value of a bucket."""
    shift = F.greatest(F.floor(b / 16).cast("int") - 1, F.lit(0))
    low = F.when(b < 32, b.cast("long")).otherwise((b % 16 + 16).cast("long"))
    return F.call_function("shiftleft", low + 1, shift) - 1


def sketch(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mergeable quantile sketch of ``value`` per group: rows (by…, bucket, n). Adding n merges sketches."""
    return rows.groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    """One row per group with the named quantiles, each the top of its bucket. A group has under 1,000 buckets."""
    w = Window.partitionBy(*by)
    up = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = sketches.withColumn("_at", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(w))
    return cum.groupBy(*by).agg(*[F.min(F.when(F.col("_at") >= F.col("_all") * q, bucket_top(F.col("bucket")))).alias(name) for name, q in points.items()])


def thresholds(measured: DataFrame) -> DataFrame:
    """Fences per (lang, source): one row with low_… and high_… of every measure, from documents that pass the base rule."""
    long = measured.where(~F.col("_m.base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_m.{m}").alias("v")) for m in MEASURES])).alias("x")
    ).select("lang", "source", "x.measure", "x.v")
    by = ["lang", "source", "measure"]
    q = quantiles(sketch(long, by, "v"), by, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    margin = F.create_map(*[F.lit(x) for m, (least, _) in MEASURES.items() for x in (m, least)])[F.col("measure")]
    far = F.greatest(FENCE_SPREADS * spread, margin.cast("long"))
    cols = []
    for m, (_, two_sided) in MEASURES.items():
        here = F.col("measure") == m
        cols.append(F.max(F.when(here, F.col("q3") + far)).alias(f"high_{m}"))
        if two_sided:
            cols.append(F.max(F.when(here, F.col("q1") - far)).alias(f"low_{m}"))
    return q.groupBy("lang", "source").agg(*cols)


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` with ``_kept``: false if the base rule fails or a measure lies beyond a fence of its group.

    A group without a fence (none of its documents passed the base rule) has none to break.
    """
    f = fences.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[c for c in fences.columns if c not in ("lang", "source")])
    joined = measured.join(f, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    bad = F.col("_m.base_failed")
    for m, (_, two_sided) in MEASURES.items():
        bad = bad | F.coalesce(F.col(f"_m.{m}") > F.col(f"high_{m}"), F.lit(False))
        if two_sided:
            bad = bad | F.coalesce(F.col(f"_m.{m}") < F.col(f"low_{m}"), F.lit(False))
    return joined.withColumn("_kept", ~bad).drop("_l", "_s", *[c for c in f.columns if c not in ("_l", "_s")])


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept."""
    measured = materialize(with_measures(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    fences = materialize(thresholds(measured), "fences")
    return judge(measured, fences).select(
        "doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", "_m.base_failed", F.col("_kept").alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with their own columns. The measures are computed once, in one written copy of the rows."""
    measured = materialize(with_measures(packed(docs, "text", "lang", "source")).drop("text"), "quality")
    fences = materialize(thresholds(measured), "fences")
    return unpacked(judge(measured, fences).where("_kept"), docs.columns)


def oracle_sql() -> str:
    """The verdicts in SQL: the same buckets and fences from window sums."""
    shift = "greatest(length(bin({v})) - 5, 0)"
    rates = {"symbol_rate": "n_symbols * 1000", "dup_line_rate": "n_dup_lines * 1000", "repeat_rate": "n_repeat_words * 1000", "word_length": "word_chars * 10"}
    per = ", ".join(f"CAST({x} // greatest(n_words, 1) AS BIGINT) AS {m}" for m, x in rates.items())
    cases = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v, {least} AS least FROM r WHERE NOT base_failed" for m, (least, _) in MEASURES.items())
    bad = " OR ".join(
        f"coalesce((SELECT r.{m} > f.q3 + far{f' OR r.{m} < f.q1 - far' if two else ''} FROM f WHERE f.measure = '{m}' "
        "AND f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source), false)" for m, (_, two) in MEASURES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
t AS (SELECT rid, i, (ws[i], ws[i + 1], ws[i + 2]) AS tri FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
u AS (SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM t) WHERE c > 1) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(u.n, 0) AS n_repeat_words
      FROM w LEFT JOIN u USING (rid)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {per} FROM c),
x AS (SELECT lang, source, measure, least, {shift.format(v="v")} * 16 + (v >> {shift.format(v="v")}) AS b, count(*) AS n FROM ({cases}) GROUP BY ALL),
y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS whole,
             CASE WHEN b < 32 THEN b ELSE ((b % 16 + 17) << CAST(b // 16 - 1 AS INT)) - 1 END AS top FROM x),
q AS (SELECT lang, source, measure, least, min(top) FILTER (upto >= whole * 0.25) AS q1, min(top) FILTER (upto >= whole * 0.75) AS q3 FROM y GROUP BY ALL),
f AS (SELECT *, greatest({FENCE_SPREADS} * (q3 - q1), least) AS far FROM q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {bad}) AS kept FROM r"""
