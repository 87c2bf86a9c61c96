"""Divergence audit of sources (operator 13).

Every text is lower-cased and cut into terms by one ``bytes.translate`` and ``bytes.split``; a Counter per document gives frequencies and, by its
keys, in how many documents a term is. A task adds them up per (lang, source, term) before anything is shuffled, so a
source or a term with a third of all rows is a few rows a task.

A language keeps the terms of at least ``min_docs`` of its documents. Each source's terms have smoothed shares p, in integers. The
divergence of a source from another one, or of a term's share from the language's, is (p - q)^2 / q, rounded down.

The sum over all kept terms for a pair of sources is sparse: it starts from the value of a term that neither source has, times the number of terms,
and is corrected by the terms that one of them has (a histogram of its shares, so each distinct share counts once) and by those that both
have. The last come from one row per term with the sources that have it; a task adds up the corrections of its rows by pair of
sources before they leave it, so no pair of rows is ever emitted and the shuffle carries at most one row per pair and batch. All arithmetic is exact: decimals
where a product may pass 64 bits, integers elsewhere.

A row per term holds at most one entry per source of its language, and the result itself has a row for each pair of a language's sources.

Defined cases: null text, lang and source are empty strings; a source without terms is a group with all counts 0; a language without kept terms gives its
pairs the value 0 and no term rows; a language with one source has no pair rows; repeated rows are documents of their own; an empty table gives
no rows; texts of any length are read whole, in pieces; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import bags
from barloom.session import materialize

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
_HELD = 200_000  # entries that a task adds up before it hands them on
_CELLS = 1 << 20  # pairs worked on at once
_TERM_BYTES = bags.table(string.ascii_lowercase.encode())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): how often a term is in a group's texts and in how many of them. The empty term marks every group, also one without terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def rows() -> pa.RecordBatch:
            cols = [[], [], [], [], []]
            for (lang, source), (counts, docs_with) in held.items():
                for c, values in zip(cols, ([lang] * len(counts), [source] * len(counts), counts, counts.values(), map(docs_with.get, counts))):
                    c.extend(values)
            held.clear()
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            arrays[2] = arrays[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "d"])

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                counts, docs_with = held.setdefault((lang.as_py(), source.as_py()), (Counter({b"": 0}), Counter({b"": 0})))
                size -= len(counts)
                own: Counter = Counter()
                for some in bags.words(text.as_py(), _TERM_BYTES):
                    own.update(some)
                counts.update(own)
                docs_with.update(own.keys())
                size += len(counts)
                if size > _HELD:
                    yield rows()
                    size = 0
        yield rows()

    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = plain.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(count: str, total: str) -> str:
    """SQL of the smoothed share of a count: decimals, as the product may pass 64 bits."""
    return f"1 + (cast({UNIT} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0))) div cast({total} as decimal(19, 0))"


def _gap(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, head) of the kept terms in the groups that have them; ``head`` marks one row per (lang, term)."""
    w = Window.partitionBy("lang", "term")
    return counts.where("term <> ''").select(
        "lang", "source", "term", "n", F.sum("d").over(w).alias("_docs"), F.sum("n").over(w).alias("lang_n"),
        (F.row_number().over(w.orderBy("source")) == 1).alias("head")).where(F.col("_docs") >= min_docs).drop("_docs")


def groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(gid, lang, source, total, lang_total, v, z) of every group: sums of its and its language's counts with one added for each of ``v`` terms; ``z`` is its share of a term that it has not."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    whole = kept.groupBy("lang").agg(F.count_if("head").alias("v"), F.sum("n").alias("lang_n"))
    rows = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    sized = rows.select("lang", "source", "v", F.expr("n + v").alias("total"), F.expr("lang_n + v").alias("lang_total"))
    return sized.withColumn("z", F.expr(f"if(v > 0, {_share('0', 'total')}, null)")).withColumn("gid", F.monotonically_increasing_id())


def term_gaps(shares: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): a group's terms with a share above the language's, the ``top`` largest values."""
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return above.withColumn("rank", rank).where(F.col("rank") <= top)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, s): corrections for terms that groups a and b both have, added up over the batch."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        gid, p, z = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        ids, code = np.unique(gid, return_inverse=True)
        sizes = np.diff(lists.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (x - y) ** 2 // y

        for k in np.unique(sizes[sizes > 1]).tolist():
            rows = starts[sizes == k][:, None] + np.arange(k)
            left = max(1, min(k, _CELLS // k))  # entries of a row set against all of it at once
            step = max(1, _CELLS // (left * k))
            for r in range(0, len(rows), step):
                at = rows[r:r + step]
                for c in range(0, k, left):
                    a, b = at[:, c:c + left, None], at[:, None, :]
                    value = gap(p[a], p[b]) - gap(p[a], z[b]) - gap(z[a], p[b]) + gap(z[a], z[b])
                    key, back = np.unique(np.r_[keys, (code[a] * len(ids) + code[b]).ravel()], return_inverse=True)
                    sums, new = np.zeros(len(key), np.int64), np.r_[sums, value.ravel()]
                    np.add.at(sums, back, new)
                    keys = key
        yield pa.RecordBatch.from_arrays([pa.array(ids[keys // max(len(ids), 1)]), pa.array(ids[keys % max(len(ids), 1)]), pa.array(sums)], names=["a", "b", "s"])


def pair_gaps(shares: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each group against each other source of its language, all of them."""
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "z")).alias("l")).select("l")
    both = lists.mapInArrow(_shared, "a long, b long, s long").groupBy("a", "b").agg(F.sum("s").alias("s"))
    shape = shares.groupBy("gid", "p").agg(F.count(F.lit(1)).alias("c")).groupBy("gid").agg(F.collect_list(F.struct("p", "c")).alias("h"))
    whole = group.join(shape, "gid", "left").select("gid", "lang", "source", "v", "z", F.coalesce("h", F.expr("cast(array() as array<struct<p: bigint, c: bigint>>)")).alias("h"))
    one = whole.select(F.col("gid").alias("a"), "lang", "source", "v", F.col("z").alias("za"), F.col("h").alias("ha"))
    other = whole.select(F.col("gid").alias("b"), "lang", F.col("source").alias("item"), F.col("z").alias("zb"), F.col("h").alias("hb"))
    pairs = one.join(other, "lang").where("a <> b").join(both, ["a", "b"], "left")
    none = _gap("za", "zb")
    value = f"""v * ({none}) + coalesce(s, 0)
        + aggregate(ha, 0L, (t, x) -> t + x.c * ({_gap("x.p", "zb")} - {none}))
        + aggregate(hb, 0L, (t, x) -> t + x.c * ({_gap("za", "x.p")} - {none}))"""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "item"))
    return pairs.select("a", "lang", "source", "item", F.expr(f"if(v > 0, {value}, 0L)").alias("value")).withColumn("rank", rank).drop("a")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for all other sources and ``term`` rows for the most telling terms of every group."""
    counts = materialize(term_counts(docs), "term-counts")
    kept = materialize(kept_terms(counts, min_docs), "kept-terms")
    group = materialize(groups(counts, kept), "groups")
    shares = kept.join(group, ["lang", "source"]).select(
        "lang", "source", "gid", "term", "z", F.expr(_share("n", "total")).alias("p"), F.expr(_share("lang_n", "lang_total")).alias("q"))
    parts = [df.withColumn("part", F.lit(part)) for part, df in (("pair", pair_gaps(shares, group)), ("term", term_gaps(shares, top)))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def oracle_sql() -> str:
    """The audit with every term set against every source."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY w.lang, source, term),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s
      ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p,
             1 + ({UNIT}::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
