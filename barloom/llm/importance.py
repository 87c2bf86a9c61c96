"""Importance resampling towards a target distribution (operator 12).

A document is a bag of hashed runs of words. A bucket's gain is the scaled log ratio of its share in the target and in
the corpus, and a document's weight is the sum of its features' gains, read from one array. Adding noise drawn from the document's id
makes the highest scores a draw without replacement in proportion to the weights.

The cutoff is found on the numbers themselves: the scores are written once, and repeated jobs count exactly how many lie on the better
side of a few probes, each job cutting the interval of possible cutoffs by ``PROBES`` + 1. If the score of the last place is tied, the same
search goes on over the tied documents' ids, and over row numbers where a document is there several times. Only counts
reach the driver. The drawn rows are dealt by ranges of (score, doc_id) and numbered inside each range; a range's first rank is the
number of rows in the ranges before it. So there is no global sort in one task, no row is ranked that is not drawn, and copies
or ties of any number are spread.

The driver holds two counts and one gain per bucket, a number that is a parameter, not a property of the data.

Defined cases: null and empty texts have no features and the weight 0; a null doc_id hashes like an empty one and is the last of its ties; repeated
rows are scored and drawn each for itself; without eligible documents, or with an empty table, nothing is drawn; an empty target counts no feature;
texts of any length are read whole, in pieces; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import bags
from barloom.session import materialize

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
PROBES = 15
RANGE_ROWS = 100_000  # drawn rows numbered in one range
_LAST_ID = (1 << 63) - 1
_WORD_BYTES = bags.table((string.ascii_lowercase + string.digits).encode())


def features(data: bytes, longest: int) -> Iterator[list[bytes]]:
    """All runs of 1 to ``longest`` words of a text, joined by blanks; the first list of a piece holds its words."""
    before: list[bytes] = []
    for own in bags.words(data, _WORD_BYTES):
        yield own
        if longest > 1:
            run = before + own
            for k in range(2, longest + 1):
                first = max(0, len(before) - k + 1)  # runs that end before this piece were given already
                yield [b" ".join(x) for x in zip(*(run[first + i:] for i in range(k)))]
            before = run[max(0, len(run) - longest + 1):]


def _buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts; a task adds up its texts in one array before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                for some in features(text.as_py() or b"", longest):
                    seen.update(some)
                if len(seen) > 500_000:
                    np.add.at(total, _buckets(list(seen), buckets), list(seen.values()))
                    seen.clear()
            np.add.at(total, _buckets(list(seen), buckets), np.array(list(seen.values()), np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, in thousandths of the log ratio with one added to each count."""
    both = []
    for rows in (docs, target):
        counts = [0] * buckets
        for r in bucket_counts(rows, longest, buckets).collect():  # at most one row per bucket
            counts[r.bucket] = r.n
        both.append(counts)
    (own, wanted), (s_all, t_all) = both, map(sum, both)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + float(buckets)) / ((s + 1.0) * (t_all + float(buckets))))) for s, t in zip(own, wanted)]


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, a function of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], longest: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = dict()  # gains of words met, a bounded cache

        def weigh(some: list[bytes]) -> int:
            total = 0
            for word, n in Counter(some).items():
                g = value.get(word)
                if g is None:
                    g = gain[zlib.crc32(word) % buckets]
                    if len(value) < 500_000:
                        value[word] = g
                total += n * g
            return total

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                n_words = n_features = weight = 0
                data = text.as_py() or b""
                for i, some in enumerate(features(data, longest)):
                    n_words += len(some) if i % longest == 0 else 0
                    n_features += len(some)
                    weight += weigh(some)
                doc_id = doc_id.as_py()
                rows.append((doc_id, n_words, n_features, weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5,
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long")


def cutoff(rows: DataFrame, key: Column, wanted: int) -> tuple[int, int, int]:
    """The smallest value v of an integer key that at least ``wanted`` rows (1 or more) do not exceed, and how many rows are below and up to v."""
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
    low, high, below, upto = ends.low, ends.high, 0, ends.n
    while low < high:
        probes = sorted({low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1)})
        counts = rows.agg(*[F.count_if(key <= F.lit(p)).alias(f"c{i}") for i, p in enumerate(probes)]).first()
        for p, n in zip(probes, counts):
            if n >= wanted:
                high, upto = p, n
                break
            low, below = p + 1, n
    return low, below, upto


def drawn(rows: DataFrame, n: int) -> Column:
    """Which rows of a written table (score, doc_id, row) are the ``n`` best: one condition on the three."""
    score, key = -F.col("score"), F.coalesce(F.col("doc_id"), F.lit(_LAST_ID))
    at, below, upto = cutoff(rows, score, n)
    if upto == n:
        return score <= F.lit(at)
    ties, n = rows.where(score == F.lit(at)), n - below
    first, below, upto = cutoff(ties, key, n)
    inside = key <= F.lit(first)
    if upto > n:
        last = cutoff(ties.where(key == F.lit(first)), F.col("row"), n - below)[0]
        inside = (key < F.lit(first)) | (key == F.lit(first)) & (F.col("row") <= F.lit(last))
    return (score < F.lit(at)) | (score == F.lit(at)) & inside


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` drawn rows with their ``rank`` by descending score, then doc_id."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "drawn")
    # one row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("inside", inside).join(starts, "part").withColumn("rank", (F.col("before") + F.col("inside")).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = 1,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    ``percent`` of the documents with at least ``min_words`` words are drawn, rounded down.
    """
    scores = scored(docs, gains(docs, target, longest, buckets), longest, seed).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(scores, "scores")
    able = F.col("n_words") >= min_words
    n = percent * rows.where(able).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if n == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    taken = able & drawn(rows.where(able), n)
    rest = rows.where(~taken).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked(rows.where(taken), n).select(*out, "rank").unionByName(rest)


def oracle_sql() -> str:
    """The draw of single words in SQL, with the checksum written out over the bytes of distinct words."""
    step = "xor(CASE WHEN {c} & 1 = 1 THEN 3988292384 ELSE 0 END, {c} >> 1)"
    entry = "SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, " + step.format(c="c") + ", k + 1 FROM t WHERE k < 8"
    return f"""
WITH RECURSIVE t AS ({entry}),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(word))),
                     lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT)),
                lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
      FROM (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM b)), crc),
s AS (SELECT bucket, count(*) AS n FROM w JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (word) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM g)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s.n + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain
         FROM s LEFT JOIN g USING (bucket), a),
f AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS weight FROM w JOIN v USING (word) JOIN gain USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, coalesce(f.n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN f USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (rid)"""
