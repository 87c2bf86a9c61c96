"""Removal of repeated byte strings (operator 4), exact, by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting all suffixes
would move every byte position; here only anchors move. The anchor of a window (a string of ``length`` bytes)
is the leftmost of its q-grams with the least hash, so equal windows have equal anchors at equal offsets, and
consecutive windows mostly share theirs: a *run* is a maximal row of windows with one anchor.

1. Initial buckets: runs by the q-gram at their anchor. Buckets with one run are settled (nothing repeats).
2. A bucket is refined by the identifier of the whole string a run covers. Equal strings settle all their
   windows as repeated; only one member of each such class goes on, to stand for it in the next rounds.
3. What is left is refined by identifiers at later offsets: the windows of a run in blocks of ``BLOCK``
   offsets. The part that all windows of a block share tells which blocks can still repeat (the others are
   settled as single), the whole part tells which repeat altogether.
4. The rest is refined window by window.

Each round is a partial aggregation on (bucket, identifier) and a join back, so a bucket with a third of all
rows is combined map-side and split by AQE in the join. For that both sides of a join must come from a shuffle of the join itself,
hence the aggregates are stored first. Identifiers are 64-bit hashes inside 64-bit
buckets. Python only computes hashes of whole Arrow batches, in chunks of bounded size.

Defined cases: null text is empty, has no bytes and the hash of no bytes; texts under ``length`` bytes are kept whole;
repeated rows remove each other; rows are told apart by a hash of (doc_id, text), so null and
repeated doc_id are fine; an empty table gives no rows; further columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.rolling import Rolling, mix, sliding_min, utf8
from barloom.llm.text import packed, unpacked
from barloom.session import materialize

LENGTH = 200
BLOCK = 16
CHUNK = 1 << 20  # windows hashed at once
_POSITION_BITS = 21  # a chunk and a window fit


def _gram(length: int) -> int:
    """Length of the anchor's q-gram: long enough to be rare, short enough that runs are long."""
    return max(1, length * 2 // 5)


def _rollers(length: int) -> tuple[Rolling, Rolling]:
    size = CHUNK + 2 * length
    return Rolling(11, size), Rolling(23, size)


def _runs_of(data: np.ndarray, offsets: np.ndarray, length: int, rollers) -> Iterator[dict[str, np.ndarray]]:
    """Runs of all rows in one byte array: row, start, n windows, anchor offset, bucket, whole."""
    q, (first, second) = _gram(length), rollers
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        x = data[at:at + CHUNK + length - 1]
        n = len(x) - length + 1
        if n <= 0:
            return
        sums = first.sums(x)
        grams = mix((sums[q:] - sums[:-q]) * first.down[: len(x) - q + 1])
        keys = (grams & ~np.uint64((1 << _POSITION_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(keys, length - q + 1) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        starts = np.arange(at, at + n)
        row = np.searchsorted(offsets, starts, side="right") - 1
        inside = starts + length <= offsets[row + 1]
        new = np.ones(n + 1, dtype=bool)
        new[1:-1] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | ~inside[1:]
        edges = np.flatnonzero(new)
        begin, end = edges[:-1], edges[1:]
        ok = inside[begin]
        begin, end = begin[ok], end[ok]
        yield {"row": row[begin], "start": starts[begin] - offsets[row[begin]], "n": end - begin, "o": anchor[begin] - begin,
               "bucket": grams[anchor[begin]], "whole": second.hashes(second.sums(x), begin, end + length - 1)}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def find_runs(rows: DataFrame, length: int) -> DataFrame:
    """All runs of (key, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rollers = _rollers(length)
        for b in batches:
            data, offsets = utf8(b.column("text"))
            keys = b.column("key").to_numpy(zero_copy_only=False)
            for r in _runs_of(data, offsets, length, rollers):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[r["row"]]), pa.array(r["start"].astype(np.int32)), pa.array(r["n"].astype(np.int16)), pa.array(r["o"].astype(np.int16)),
                     _signed(r["bucket"]), _signed(r["whole"])], names=["key", "start", "n", "o", "bucket", "whole"])

    return rows.mapInArrow(run, "key long, start int, n short, o short, bucket long, whole long")


def _blocks_of(text: bytes, runs: list[dict], length: int, rollers) -> list[tuple]:
    """Blocks of the given runs of one text: (bucket, j, core, hull, start, first offset, windows)."""
    second = rollers[1]
    out = []
    for r in runs:
        start, n, o = r["start"], r["n"], r["o"]
        x = np.frombuffer(text, dtype=np.uint8, count=n + length - 1, offset=start)
        sums = second.sums(x)
        s = np.arange(n)
        windows = second.hashes(sums, s, s + length).view(np.int64)
        j = (o - s) // BLOCK
        edge = np.flatnonzero(np.diff(j)) + 1
        begin, end = np.r_[0, edge], np.r_[edge, n]
        low = o - (j[begin] * BLOCK + BLOCK - 1)  # start of the block's first window, also where the run lacks it
        core = second.hashes(sums, low + BLOCK - 1, low + length).view(np.int64)
        hull = second.hashes(sums, begin, end + length - 1).view(np.int64)
        for k in range(len(begin)):
            full = end[k] - begin[k] == BLOCK
            out.append((r["bucket"], int(j[begin[k]]), int(core[k]), int(hull[k]) if full else None, int(start + begin[k]), int(o - begin[k]), windows[begin[k]:end[k]]))
    return out


BLOCK_SCHEMA = "key long, bucket long, j short, core long, hull long, start int, o short, windows array<long>"


def find_blocks(texts: DataFrame, length: int) -> DataFrame:
    """Blocks of (key, text, runs) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rollers = _rollers(length)
        types = [pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.list_(pa.int64())]
        names = ["key", "bucket", "j", "core", "hull", "start", "o", "windows"]
        for b in batches:
            for key, text, runs in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()), b.column("runs")):
                text, runs = text.as_py(), runs.as_py()
                for k in range(0, len(runs), 4096):
                    found = _blocks_of(text, runs[k:k + 4096], length, rollers)
                    cols = [[key] * len(found), *zip(*found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    return texts.mapInArrow(run, BLOCK_SCHEMA)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def repeated_windows(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Where repeated windows start, as (key, start, n) rows of n consecutive windows. ``rows`` has key and text."""
    rows = rows.select("key", "text")
    runs = find_runs(rows, length)
    buckets = materialize(runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("bucket"), "anchors")
    shared = materialize(runs.join(buckets, "bucket"), "runs")

    classes = materialize(shared.groupBy("bucket", "whole").agg(
        F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("key", "start", "n", "o")]), "classes")
    whole = shared.join(classes.where("c > 1").select("bucket", "whole"), ["bucket", "whole"]).select("key", "start", "n")

    open_buckets = materialize(classes.where("c = 1").select("bucket").distinct(), "open")
    members = classes.join(open_buckets, "bucket", "left_semi")
    per_text = members.groupBy("key").agg(F.collect_list(F.struct("start", "n", "o", "bucket")).alias("runs"))
    # a text that stands twice gives its blocks twice, which is right: they do repeat
    blocks = materialize(find_blocks(rows.join(per_text, "key"), length), "blocks")

    by = ["bucket", "j", "core"]
    cores = materialize(blocks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_c"), F.count("hull").alias("_h"), F.min("hull").alias("_a"), F.max("hull").alias("_b")).where("_c > 1"), "cores")
    alive = materialize(blocks.join(cores, by), "alive")
    settled = (F.col("_c") == F.col("_h")) & (F.col("_a") == F.col("_b"))
    full = alive.where(settled).select("key", "start", F.size("windows").cast("short").alias("n"))
    single = alive.where(~settled).select("key", "start", "bucket", "o", F.posexplode("windows").alias("_i", "window")).select(
        "key", (F.col("start") + F.col("_i")).alias("start"), "bucket", (F.col("o") - F.col("_i")).alias("o"), "window")
    twice = materialize(single.groupBy("bucket", "o", "window").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"), "windows")
    ones = single.join(twice, ["bucket", "o", "window"]).select("key", "start", F.lit(1).cast("short").alias("n"))
    return whole.unionByName(full).unionByName(ones)


def spans(windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per key the maximal removed byte spans, in order, as arrays ``first`` and ``last`` (past the end). A text has at most one run per byte."""
    lists = windows.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n") + (length - 1)).alias("stop")))).alias("_w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            firsts, lasts = [], []
            for w in b.column("_w"):
                v = w.values.flatten()
                s, e = v[0].to_numpy(), np.maximum.accumulate(v[1].to_numpy())
                cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                firsts.append(s[cut])
                lasts.append(e[np.r_[cut[1:] - 1, len(e) - 1]])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))], names=["key", "first", "last"])

    return lists.mapInArrow(run, "key long, first array<int>, last array<int>")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = keyed(docs.select("doc_id", "text"))
    joined = rows.join(spans(repeated_windows(rows, length), length), "key", "left").select("doc_id", "text", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            out = []
            for i, (first, last) in enumerate(zip(b.column("first").to_pylist(), b.column("last").to_pylist())):
                text, sha, at = data[offsets[i]:offsets[i + 1]], hashlib.sha256(), 0
                for f, e in zip(first or (), last or ()):
                    sha.update(text[at:f])
                    at = e
                sha.update(text[at:])
                out.append((len(text), sum(last or ()) - sum(first or ()), len(first or ()), sha.hexdigest()))
            n_bytes, n_removed, n_spans, sha = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings taken out of ``text``. A character of several bytes goes only if all of them do; other columns stay."""
    rows = keyed(docs.select("doc_id", "text"))
    found = spans(repeated_windows(rows, length), length)
    own = packed(docs, "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    joined = own.join(found, "key", "left")

    @F.pandas_udf("string")
    def cut(text, first, last):
        def one(t, f, e):
            if f is None or t is None:
                return t
            raw, at, out = t.encode(), 0, []
            for a, b in zip(f, e):
                out.append(raw[at:a])
                at = b
            return b"".join([*out, raw[at:]]).decode(errors="ignore")
        return text.combine(first, lambda t, f: (t, f)).combine(last, lambda tf, e: one(*tf, e))

    text = F.when(F.col("first").isNull(), F.col("text")).otherwise(cut("text", "first", "last"))
    return unpacked(joined, docs.columns, text=text)


def oracle_sql(length: int = LENGTH) -> str:
    """The digests from all windows of all texts, written as hexadecimal digits."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS h FROM documents),
k AS (SELECT rid, s, md5(substr(h, 2 * s + 1, {2 * length})) AS m
      FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {length - 1})) AS s FROM d WHERE length(h) >= {2 * length})),
g AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY m) AS c FROM k) WHERE c > 1),
n AS (SELECT rid, s, CASE WHEN lag(s) OVER (PARTITION BY rid ORDER BY s) >= s - {length} THEN 0 ELSE 1 END AS fresh FROM g),
sp AS (SELECT rid, min(s) AS f, max(s) + {length} AS e FROM (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS i FROM n) GROUP BY rid, i),
p AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY f), 0) AS start, f AS stop FROM sp
      UNION ALL SELECT d.rid, coalesce(max(e), 0), length(any_value(h)) // 2 FROM d LEFT JOIN sp USING (rid) GROUP BY d.rid),
t AS (SELECT rid, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS kept FROM p JOIN d USING (rid) GROUP BY rid),
c AS (SELECT rid, sum(e - f) AS gone, count(*) AS spans FROM sp GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (rid) LEFT JOIN c USING (rid)"""
