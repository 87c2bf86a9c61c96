"""Near-duplicate documents by fast similarity sketching (operator 5).

The sketch of a shingle set has T coordinates. In round i every shingle is hashed to one coordinate, with values above
those of all earlier rounds, until all coordinates are filled; after T rounds the shingles go to the coordinates one
after the other, so 2T rounds always fill. A large set fills all in one round, and the share of equal
coordinates of two sketches is concentrated around the Jaccard similarity as for T independent minima. ``BANDS`` bands,
with as many coordinates as the wanted similarity allows (``band_rows``), propose candidates: a pair at just that
similarity misses all bands with a probability below 1e-6.

Sets that are equal form one class and one node. Inside a bucket (nodes that share a band; buckets with the same members count
once) no list of all pairs is made. First every node meets the bucket's hub, the node whose buckets are largest, and the links give
components. Pairs whose sketches differ in so many coordinates that the wanted similarity is five standard deviations away are left
out in the join itself; all others are compared on the full sets. A bucket whose other members still lie in several components goes on:
its members are dealt by a hash into blocks of about ``BLOCK`` shingles, every two blocks meet as one group, sets of like size and of
different components are compared in it, and it hands on only the links that join components, fewer than it has sets. So a bucket of
any size spreads over tasks of bounded size, in a fixed number of steps; nothing is lost: each pair of a bucket either meets or is
already connected. The work for sets that stay unlike grows with the square of such a bucket, that for copies and linked sets does not.

Defined cases: null, blank or empty text has no shingles and is linked with nothing (its own component); fewer words than
a shingle has are one shingle; repeated rows share a class; rows of one doc_id with different texts are one node with several
sets; a null doc_id takes no part (null component, kept); an empty table gives no rows; further columns stay in ``keep_one_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.graph import components
from barloom.llm.rolling import U, mix, shingles, utf8, word_hashes
from barloom.session import materialize

BANDS = 70
BLOCK = 1 << 19  # shingles of a bucket that are compared with as many others in one group
DEVIATIONS = 5
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
ELEMENTS = 1 << 20  # shingles sketched at once


def band_rows(percent: int) -> int:
    """Coordinates per band: one band matches with a chance of 0.19 or a little more at the wanted similarity."""
    return max(1, int(math.log(0.19) / math.log(min(percent, 99) / 100)))


def _seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Sketches of non-empty sets, one row of ``t`` values each."""
    out = np.full((len(sets), t), _EMPTY, dtype=U)
    flat = out.reshape(-1)
    seeds = _seeds(t)
    sizes = np.array([len(s) for s in sets])
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    missing = np.arange(len(sets))
    for i in range(t):
        z = mix(x ^ seeds[i])
        place = owner * t + ((z >> U(32)) * U(t) >> U(32)).astype(np.int64)
        np.minimum.at(flat, place, (U(i) << U(48)) | (mix(z) >> U(16)))
        full = (out[missing] != _EMPTY).all(axis=1)
        if full.any():
            missing = missing[~full]
            if not len(missing):
                return out
            live = np.zeros(len(sets), dtype=bool)
            live[missing] = True
            stay = live[owner]
            x, owner = x[stay], owner[stay]
    for k in missing:
        for c in np.flatnonzero(out[k] == _EMPTY):
            z = mix(sets[k] ^ seeds[t + c])
            out[k, c] = (U(t + c) << U(48)) | (mix(z).min() >> U(16))
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates, the band's number included."""
    n, t = values.shape
    bands = t // rows
    v = values.reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (n, bands))
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + v[:, :, r])
    return key


def bits(values: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, as rows of signed 64-bit words."""
    pair = np.stack([values & U(1), values >> U(1) & U(1)], axis=2).reshape(len(values), -1)
    packed = np.packbits(pair.astype(np.uint8), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.int64)


def most_differences(t: int, percent: int) -> int:
    """Differing coordinates, as far as two bits show them, beyond which two sets are not that similar."""
    p = (1 - percent / 100) * 3 / 4
    return math.ceil(t * p + DEVIATIONS * math.sqrt(t * p * (1 - p)))


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    row, h = word_hashes(data, offsets)
    cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
    return [shingles(h[cut[i]:cut[i + 1]], size) for i in range(batch.num_rows)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds few megabytes of text, or one long text."""
    for b in batches:
        _, offsets = utf8(b.column("text"))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), side="right")) - 1)
            yield b.slice(at, stop - at)
            at = stop


def find_sketches(docs: DataFrame, size: int, rows: int) -> DataFrame:
    """(doc_id, n, s1, s2, bands, bits): set size, 128-bit identity of the set, band keys and sketch bits (of no use without shingles)."""
    words = -(-rows * BANDS // 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = _sets(b, size)
            n = np.array([len(s) for s in sets])
            keys, marks = np.zeros((len(sets), BANDS), dtype=U), np.zeros((len(sets), words), dtype=np.int64)
            some = np.flatnonzero(n)
            at = 0
            while at < len(some):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(n[some[at:]]), ELEMENTS, side="right")) + at)
                part = some[at:stop]
                values = sketch([sets[k] for k in part], rows * BANDS)
                keys[part], marks[part] = band_keys(values, rows), bits(values)
                at = stop
            with np.errstate(over="ignore"):
                ids = [np.array([mix(s * U(m) + U(m)).sum(dtype=U) for s in sets], dtype=U).view(np.int64) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64))) for x in (keys, marks)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *map(pa.array, ids), *lists], names=["doc_id", "n", "s1", "s2", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bands array<long>, bits array<long>")


def find_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [pa.array(s.view(np.int64)) for s in _sets(b, size)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)), pa.concat_arrays(sets) if sets else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), lists], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, c) of buckets with several nodes, c of them; equal buckets once."""
    rows = nodes.select(F.explode("bands").alias("bucket"), "node")
    marks = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("c > 1")
    once = materialize(marks.groupBy("c", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "c"), "shared")
    return materialize(rows.join(once, "bucket"), "buckets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs with 100 * |A and B| >= percent * |A or B| on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b").distinct()


def _pairs(hubs: DataFrame, members: DataFrame, percent: int, t: int) -> DataFrame:
    """Distinct pairs of a hub and another member of its bucket that can be similar enough."""
    def differing(i: int) -> Column:
        x = F.get("bits", F.lit(i)).bitwiseXOR(F.get("pbits", F.lit(i)))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    differ = sum((differing(i) for i in range(-(-t // 32))), F.lit(0))
    fits = (F.col("n") * 100 >= F.col("pn") * percent) & (F.col("pn") * 100 >= F.col("n") * percent)
    joined = members.join(hubs.withColumnRenamed("bucket", "_bucket"),
                          (F.col("bucket") == F.col("_bucket")) & (F.col("node") != F.col("pivot")) & fits & (differ <= most_differences(t, percent)))
    return joined.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def joins(flat: np.ndarray, cut: np.ndarray, component: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between components that similar sets of two blocks (or of one with itself) make: a spanning forest of them.

    Set i is ``flat[cut[i]:cut[i + 1]]``. One set at a time marks its shingles, and sums of marks give its intersections with all
    sets of the other block whose size is near enough.
    """
    _, ids, times = np.unique(flat, return_inverse=True, return_counts=True)
    size, order = np.diff(cut), np.argsort(np.diff(cut), kind="stable")
    common = times[ids] > 1  # the others lie in no intersection
    at = np.r_[0, np.cumsum(common)][cut]
    shingle_ids = [ids[cut[i]:cut[i + 1]][common[cut[i]:cut[i + 1]]] for i in order]
    size, block, at = size[order], block[order], np.r_[0, np.cumsum(np.diff(at)[order])]
    names, root = np.unique(component[order], return_inverse=True)
    alone = block.min() == block.max()
    left = np.flatnonzero(block == block.min())
    right = left if alone else np.flatnonzero(block == block.max())
    other = np.concatenate([shingle_ids[j] for j in right])
    ends = np.r_[0, np.cumsum(np.diff(at)[right])]
    n, mark = size[right], np.zeros(len(times), dtype=np.int8)
    found = []
    for i in left:
        first = int(np.searchsorted(n, -(-size[i] * percent // 100)))
        stop = int(np.searchsorted(n, size[i] * 100 // percent, side="right"))
        if alone:
            first = max(first, i + 1)
        if first >= stop or (root[right[first:stop]] == root[i]).all():
            continue
        mark[shingle_ids[i]] = 1
        sums = np.r_[0, np.cumsum(mark[other[ends[first]:ends[stop]]], dtype=np.int64)]
        mark[shingle_ids[i]] = 0
        both = np.diff(sums[ends[first:stop + 1] - ends[first]])
        near = 100 * both >= percent * (size[i] + n[first:stop] - both)
        for r in np.unique(root[right[first:stop]][near]):
            if r != root[i]:
                found.append((int(names[root[i]]), int(names[r])))
                root[root == r] = root[i]
    return found


def dealt(rest: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The sets of each bucket that holds several components, once for every two blocks (low, high) that they meet in."""
    blocks = materialize(rest.groupBy("bucket").agg(
        F.ceil(F.sum("n") / block).alias("blocks"), F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("bucket", "blocks"), "blocks")
    placed = rest.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    with_sets = placed.select("bucket", "node", "component", "block", "blocks").join(sets, "node")
    met = with_sets.withColumn("_peer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select("bucket", F.least("block", "_peer").alias("low"), F.greatest("block", "_peer").alias("high"), "block", "component", "shingles")


def _across(rest: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b) links between components of one bucket; ``rest`` has bucket, node, n, component."""

    def meet(t: pa.Table) -> pa.Table:
        lists = t.column("shingles").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        flat, cut = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        block, low, high = (t.column(c).to_numpy() for c in ("block", "low", "high"))
        # two blocks of which one is empty have nothing to compare: each block also meets itself
        found = [] if low[0] < high[0] and block.min() == block.max() else joins(flat, cut, t.column("component").to_numpy(), block, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt(rest, sets, block).groupBy("bucket", "low", "high").applyInArrow(meet, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, given: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, component) of the nodes that have a link. ``nodes`` has node, n, bands and bits; ``given`` holds links known beforehand."""
    buckets = _buckets(nodes)
    rank = buckets.groupBy("node").agg(F.sum(F.log2("c")).alias("rank"))
    ranked = materialize(nodes.select("node", "n", "bits").join(rank, "node"), "ranked")
    members = materialize(buckets.select("bucket", "node").join(ranked, "node"), "members")
    # the written list has a known size: a short one is broadcast and the texts stay where they are
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(ranked.select("node").distinct(), "node")
    sets = materialize(find_sets(texts, size), "sets")

    order = Window.partitionBy("bucket").orderBy(F.desc("rank"), "node")
    hubs = materialize(members.withColumn("_i", F.row_number().over(order)).where("_i = 1").select(
        "bucket", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("bits").alias("pbits")), "hubs")
    near = _confirmed(_pairs(hubs, members, percent, BANDS * band_rows(percent)), sets, percent)
    labels = materialize(components(given.unionByName(near)), "labels")
    # a hub has met every other member of its bucket; buckets whose other members lie in several components go on
    rest = materialize(members.select("bucket", "node", "n").join(hubs.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti")
                       .join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "rest")
    across = materialize(_across(rest, sets, percent, block), "across")
    if across.isEmpty():
        return labels
    return materialize(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across)), "labels")


def cluster(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sk = materialize(find_sketches(docs, size, band_rows(percent)), "sketches")
    known = sk.where("n > 0 and doc_id is not null")
    classes = materialize(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = materialize(known.join(classes, ["s1", "s2"]).where("doc_id = node").dropDuplicates(["s1", "s2"]).select("node", "n", "bands", "bits"), "nodes")
    own = materialize(known.select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).groupBy("doc_id").agg(
        F.min("node").alias("node"), F.collect_set("node").alias("_all")), "own")
    # one doc_id with several texts joins the classes of all of them
    given = own.where(F.size("_all") > 1).select(F.col("node").alias("a"), F.explode("_all").alias("b"))
    labels = links(docs, nodes, given, size, percent)
    several = own.join(labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return (sk.select("doc_id", F.col("n").alias("n_shingles")).join(several, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are near copies of one with a smaller doc_id; of repeated rows one stays."""
    kept = cluster(docs, size, percent).where("kept").select("doc_id").distinct()
    return docs.dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def oracle_sql(size: int = 3, percent: int = 85) -> str:
    """The clusters from all pairs of documents that share a shingle."""
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - {size - 2}), lambda i: {gram})) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS d, b AS e FROM l UNION SELECT r.d, l.b FROM r JOIN l ON r.e = l.a),
c AS (SELECT d AS doc_id, min(e) AS e FROM r GROUP BY d)
SELECT doc_id, len(g) AS n_shingles, least(doc_id, coalesce(e, doc_id)) AS component_id, doc_id <= coalesce(e, doc_id) AS kept FROM s LEFT JOIN c USING (doc_id)"""
