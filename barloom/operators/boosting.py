"""Boosted regression trees for many groups of rows at once (walk-forward folds, or one group for a single model).

Every model is fitted on all of its rows. Trees are grown on histograms: a feature is cut once into at most ``BINS`` bins of about equal weight, and for a
squared error a tree needs no more of the rows that share all bins (a cell) than their number and the sum of their labels. ``fit_upto`` therefore

* counts the rows of all models by (segment of the order, interval of a value) in one pass, and cuts the intervals that a quantile falls
  into finer until none weighs more than an eighth of a bin (``_edges_of``);
* collapses the rows by the edges of all models together, written once, and these sums to the cells of every model (``_fine_sums``, ``_cell_sums``);
* grows a model from its cells, a model a task. There are at most ``BINS ** features`` cells, and never more than rows, however large the table.

Sums of labels are kept as integers, so models are the same whatever the partitioning. Scoring covers all rows and is
one pass without a shuffle: the models are (groups x rounds x nodes) numbers. A row is cut into bins once; a round then costs one look-up per
feature and a few operations on bit sets of leaves (``_lookup``), not a walk down the tree. Where few models score many rows, a round costs one
look-up per two features and one of the value (``_cells``).

A level of a tree adds up residuals per (node, feature, bin), and running sums over the bins give the best cut of every node. A tree is stored as a
heap: the children of node i are 2 i + 1 and 2 i + 2.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import materialize

# Rounds, learning rate and least rows of a leaf.
ROUNDS, RATE, MIN_LEAF = 200, 0.05, 20
DEPTH = 5
BINS = 64
HOLD_OUT = 0.2  # the last part by date, which picks the best round
SLICE_ROWS = 1 << 23  # sums that one task collapses to the cells of a model
_MODEL = "model int, round int, feature array<int>, cut array<double>, value array<double>, gain array<double>, error double"


def _edges(x: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, BINS) / BINS, method="lower"))


def _tree(bins: np.ndarray, edges: list[np.ndarray], rest: np.ndarray, depth: int, rate: float, rows_of: np.ndarray | None = None) -> tuple:
    """(feature, cut, value, gain, leaf of every row) of one tree on residuals; ``bins`` is features x rows.

    With ``rows_of`` a row stands for so many, and its residual is their sum.
    """
    size = (1 << depth + 1) - 1
    feature, cut, value = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size)
    gains, at = np.zeros(len(bins)), np.zeros(rest.size, np.int64)
    flat, start = bins.ravel(), np.arange(len(bins)) * rest.size
    value[0] = rate * rest.sum() / (rest.size if rows_of is None else rows_of.sum())
    for level in range(depth):
        first, n_nodes = (1 << level) - 1, 1 << level
        active = np.flatnonzero(at >= first)
        whole = active.size == at.size
        node, own, binned = (at - first, rest, bins) if whole else (at[active] - first, rest[active], bins[:, active])
        weight = rows_of if whole or rows_of is None else rows_of[active]
        best = np.full(n_nodes, 1e-12)
        left_sum = np.zeros(n_nodes)
        left_n = np.zeros(n_nodes)
        bin_at = np.zeros(n_nodes, np.int64)
        total_n, total = np.bincount(node, weight, n_nodes), np.bincount(node, own, n_nodes)
        for f, e in enumerate(edges):
            width = len(e) + 1
            cell = node * width + binned[f]
            n = np.bincount(cell, weight, n_nodes * width).reshape(n_nodes, width).cumsum(1)[:, :-1]
            s = np.bincount(cell, own, n_nodes * width).reshape(n_nodes, width).cumsum(1)[:, :-1]
            if not n.size:
                continue
            right = total_n[:, None] - n
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s * s / n + (total[:, None] - s) ** 2 / right - (total * total / total_n)[:, None]
            gain[(n < MIN_LEAF) | (right < MIN_LEAF)] = -1.0
            b = gain.argmax(1)
            found = gain[np.arange(n_nodes), b]
            better = found > best
            best[better], feature[first:first + n_nodes][better], bin_at[better] = found[better], f, b[better]
            cut[first:first + n_nodes][better] = e[b[better]]
            left_sum[better], left_n[better] = s[np.arange(n_nodes), b][better], n[np.arange(n_nodes), b][better]
        split = feature[first:first + n_nodes] >= 0
        if not split.any():
            break
        k = np.flatnonzero(split)
        np.add.at(gains, feature[first + k], best[k])
        left = 2 * (first + k) + 1
        value[left] = rate * left_sum[k] / left_n[k]
        value[left + 1] = rate * (total[k] - left_sum[k]) / (total_n[k] - left_n[k])
        rows = active if split.all() else active[split[node]]
        here = at[rows]
        # look-ups by one index array, and in place: by two arrays, or with new ones for each step, they take several times as long
        local = here - first
        place = start.take(feature[first:first + n_nodes]).take(local)
        place += rows
        here *= 2
        here += 1
        here += flat.take(place) > bin_at.take(local)
        at[rows] = here
    return feature, cut, value, gains, at


def _leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row ends in; ``x`` is features x rows."""
    at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    for _ in range(depth):
        f = feature[at]
        at = np.where(f < 0, at, 2 * at + 1 + (x[f, rows] > cut[at]))
    return at


#: Times a power of two below 2 ** 64, its upper six bits tell the power.
_DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
_DEEPEST = 6  # levels whose leaves fit a bit set


def _lookup(rounds: list[tuple], n_features: int, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(cuts per feature, leaves that a bin leaves over per round and feature, value per round and leaf) of one model.

    Leaves are bits, the leftmost the lowest. A node whose cut a row exceeds rules out the leaves on its left; the lowest leaf left over is the row's.
    Values are placed by the upper bits of the leaf's bit times ``_DE_BRUIJN``.
    """
    cuts = [np.unique([c for feature, cut, *_ in rounds for c in cut[feature == f]]) for f in range(n_features)]
    masks = np.full((len(rounds), n_features, 1 + max(map(len, cuts), default=0)), ~np.uint64(0))
    values, leaves = np.zeros((len(rounds), 64)), np.arange(1 << depth)
    place = (np.left_shift(np.uint64(1), leaves.astype(np.uint64)) * _DE_BRUIJN >> np.uint64(58)).astype(np.int64)
    for k, (feature, cut, value, *_) in enumerate(rounds):
        for i in np.flatnonzero(feature >= 0).tolist():
            level = (i + 1).bit_length() - 1
            half = 1 << depth - level - 1
            left = (1 << half) - 1 << (i + 1 - (1 << level)) * 2 * half
            masks[k, feature[i], np.searchsorted(cuts[feature[i]], cut[i]) + 1:] &= ~np.uint64(left)
        at = np.zeros(leaves.size, np.int64)
        for level in range(depth):
            at = np.where(feature[at] < 0, at, 2 * at + 1 + (leaves >> depth - 1 - level & 1))
        values[k, place] = value[at]
    return cuts, masks, values


def _scores(x: np.ndarray, cuts: list[np.ndarray], masks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over the rounds of a ``_lookup``; ``x`` is features x rows."""
    bins = [np.searchsorted(c, row) for c, row in zip(cuts, x)]  # the number of cuts a value exceeds
    out = np.zeros(x.shape[1])
    for mask, value in zip(masks, values):
        left = mask[0].take(bins[0])
        for m, b in zip(mask[1:], bins[1:]):
            left &= m.take(b)
        lowest = left & (np.uint64(0) - left)
        out += value.take((lowest * _DE_BRUIJN >> np.uint64(58)).view(np.int64))
    return out


#: Values that the cell tables of all models may hold together, 16 MB.
_CELLS = 2_000_000
Cells = list[tuple[list[np.ndarray], np.ndarray]]


def _cells(cuts: list[np.ndarray], masks: np.ndarray, values: np.ndarray, room: int) -> Cells | None:
    """(numbers per pair of features and their two bins, value per cell) of every round of a ``_lookup``; a row's numbers add up to its cell.

    A tree cuts a feature at few of the model's cuts, and bins that it does not tell apart share a number. None if the rounds have more than ``room``
    cells, or one has more than a short counts.
    """
    out: Cells = []
    for mask, value in zip(masks, values):
        steps = [np.r_[True, m[1:len(c) + 1] != m[:len(c)]] for c, m in zip(cuts, mask)]
        sizes = [int(s.sum()) for s in steps]
        n = math.prod(sizes)
        room -= n
        if room < 0 or n > np.iinfo(np.int16).max:
            return None
        left, numbers = np.array([~np.uint64(0)]), []
        for i, (s, m) in enumerate(zip(steps, mask)):
            left = (left[:, None] & m[:s.size][s]).ravel()
            numbers.append(((s.cumsum() - 1) * math.prod(sizes[i + 1:])).astype(np.int16))
        lowest = left & (np.uint64(0) - left)
        pairs = [sum(np.ix_(*numbers[i:i + 2])).ravel() for i in range(0, len(numbers), 2)]
        out.append((pairs, value.take((lowest * _DE_BRUIJN >> np.uint64(58)).view(np.int64))))
    return out


def _cell_scores(x: np.ndarray, cuts: list[np.ndarray], cells: Cells) -> np.ndarray:
    """The sums of ``_scores``, in the same order, by ``_cells``."""
    bins = [np.searchsorted(c, row) for c, row in zip(cuts, x)]
    paired = [np.ravel_multi_index(bins[i:i + 2], [len(c) + 1 for c in cuts[i:i + 2]]) for i in range(0, len(bins), 2)]
    out = np.zeros(x.shape[1])
    for pairs, value in cells:
        at = pairs[0].take(paired[0])
        for numbers, b in zip(pairs[1:], paired[1:]):
            at += numbers.take(b)
        out += value.take(at)
    return out


def _grow(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int) -> list[tuple]:
    """The rounds of one model of rows in one array."""
    fit = max(1, int(x.shape[1] * (1 - HOLD_OUT)))
    edges = [_edges(row[:fit]) for row in x]
    bins, one = np.stack([np.searchsorted(e, row) for e, row in zip(edges, x)]), np.ones(y.size)
    return _grow_cells(edges, (bins[:, :fit], one[:fit], y[:fit]), (bins[:, fit:], one[fit:], y[fit:]), rounds, rate, depth)


CellSums = tuple[np.ndarray, np.ndarray, np.ndarray]  # bins (features x cells), rows and sum of the labels of every cell


def _grow_cells(edges: list[np.ndarray], fit: CellSums, held: CellSums, rounds: int, rate: float, depth: int) -> list[tuple]:
    """The rounds of one model, up to the one with the least error on the rows held out; round 0 is the mean.

    The error is the mean squared distance from the cells' means: labels differ from these by a sum that no round changes.
    """
    (bins, n, total), (held_bins, held_n, held_total) = fit, held
    base = float(total.sum() / n.sum())
    fitted, guess, mean = np.full(n.size, base), np.full(held_n.size, base), held_total / held_n
    at_held = np.stack([np.append(e, np.inf)[b] for e, b in zip(edges, held_bins)])  # the greatest value of each bin stands for it

    def error() -> float:
        return float((held_n * (guess - mean) ** 2).sum() / held_n.sum()) if held_n.size else 0.0

    trees = [(np.full(1, -1, np.int32), np.zeros(1), np.full(1, base), np.zeros(len(bins)), error())]
    for _ in range(rounds):
        feature, cut, value, gains, at = _tree(bins, edges, total - n * fitted, depth, rate, n)
        fitted += value[at]
        guess += value[_leaf(at_held, feature, cut, depth)]
        trees.append((feature, cut, value, gains, error()))
    best = len(trees) if not held_n.size else 1 + max(1, int(np.argmin([t[4] for t in trees[1:]])) + 1)
    return trees[:best]


@dataclass
class Trees:
    """Fitted models by number: per round (feature, cut, value, gain, error)."""

    features: list[str]
    models: dict[int, list[tuple]]
    depth: int

    @property
    def getNumTrees(self) -> int:
        """Trees of the first model."""
        return len(next(iter(self.models.values()))) - 1

    def importances(self) -> dict[int, list[float]]:
        """Share of every feature in the summed gain, per model; all 0 if no tree was split."""
        out = {}
        for k, rounds in self.models.items():
            gain = np.sum([r[3] for r in rounds], axis=0)
            out[k] = (gain / gain.sum() if gain.sum() > 0 else gain).tolist()
        return out

    def scorer(self, model: int) -> Callable[[np.ndarray], np.ndarray]:
        """Scores of features x rows by one model."""
        rounds, depth = self.models[model], self.depth
        if depth <= _DEEPEST and self.features:
            cuts, masks, values = _lookup(rounds, len(self.features), depth)
            cells = _cells(cuts, masks, values, _CELLS // len(self.models))
            return (lambda x: _scores(x, cuts, masks, values)) if cells is None else (lambda x: _cell_scores(x, cuts, cells))
        return lambda x: sum((value[_leaf(x, feature, cut, depth)] for feature, cut, value, *_ in rounds), np.zeros(x.shape[1]))

    def predict(self, df: DataFrame, model: Column) -> Column:
        """Prediction of the rows of ``df`` by the model whose number ``model`` gives; null for a number without one, or where a feature is null."""
        scorers = {m: self.scorer(m) for m in self.models}

        @F.arrow_udf("double")
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for number, *columns in batches:
                k = number.to_numpy(zero_copy_only=False).astype(float)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
                known = ~np.isnan(x).any(axis=0)
                out = np.full(len(number), np.nan)
                for m in np.unique(k[~np.isnan(k)]):
                    rows = np.flatnonzero((k == m) & known)
                    if int(m) in scorers and len(rows):
                        out[rows] = scorers[int(m)](x[:, rows])
                yield pa.array(out, from_pandas=True)

        return run(model, *[F.col(c).cast("double") for c in self.features])


def sampled(df: DataFrame, groups: list[tuple[int, Column, int]], keys: list[str], fit_rows: int) -> DataFrame:
    """The rows of every group (number, condition, number of rows) with ``model``; of groups above ``fit_rows`` an even sample of about so many.

    For callers that want a sample; no model of this library is fitted on one. Rows beyond the largest share are dropped before they meet any group.
    """
    draw = F.pmod(F.xxhash64(*keys), F.lit(1 << 31))
    limits = [int((1 << 31) * min(1.0, fit_rows / max(n, 1))) for _, _, n in groups]
    ids = [F.when(cond & (draw < limit), F.lit(k)) for (k, cond, _), limit in zip(groups, limits)]
    return df.where(draw < max(limits)).withColumn("model", F.explode(F.array_compact(F.array(*ids))))


Arrays = list[np.ndarray]


def _collapsed(keys: Arrays, values: Arrays, ufuncs: list[np.ufunc]) -> tuple[Arrays, Arrays]:
    """The distinct keys in order, and the values of each by its ufunc."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not order.size:
        return keys, values
    starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    return [k[starts] for k in keys], [u.reduceat(v[order], starts) for u, v in zip(ufuncs, values)]


def _gathered(batches: Iterable[tuple[Arrays, Arrays]], ufuncs: list[np.ufunc], room: int = 1 << 20) -> tuple[Arrays, Arrays] | None:
    """All batches collapsed: whenever as many rows wait as there are distinct keys, and at least ``room``. None without a batch."""
    waiting, n_waiting, kept = [], 0, 0
    for keys, values in batches:
        waiting.append((keys, values))
        n_waiting += keys[0].size
        if n_waiting - kept >= max(room, kept):
            waiting = [_collapsed(*([np.concatenate(c) for c in zip(*part)] for part in zip(*waiting)), ufuncs)]
            n_waiting = kept = waiting[0][0][0].size
    return _collapsed(*([np.concatenate(c) for c in zip(*part)] for part in zip(*waiting)), ufuncs) if waiting else None


def _record_batches(columns: Arrays, names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, columns[0].size, rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + rows]) for c in columns], names)


def _numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns x rows; -0.0 becomes 0.0."""
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]) + 0.0


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles: equal steps are equal parts of an octave."""
    bits = x.view(np.int64)
    return bits ^ (bits >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))


_COARSE, _PARTS = 46, 64  # lower bits of ``_ordered`` that the first intervals leave out (64 to an octave), and least parts that a heavy one is cut into
_ALL_PARTS = 1 << 14  # parts of a feature's heavy intervals together, if these are few: saves passes over the rows
_HEAVY = 1 / (8 * BINS)  # an interval with more of a model's rows, and with several values, is cut
Spans = list[tuple[np.ndarray, np.ndarray]]  # first and last number of ``_ordered`` of the intervals of every feature


def _interval_counts(rows: DataFrame, features: list[str], spans: Spans | None) -> pd.DataFrame:
    """(feature, segment, at, n, low, top): rows, least and greatest value by feature, ``_segment`` and interval, which begins at ``at``. Without ``spans``
    all values count, in intervals of ``_COARSE``."""
    bits = 65 - _COARSE if spans is None else max(len(first) for first, _ in spans).bit_length()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Arrays, Arrays]]:
        for batch in batches:
            segment = batch.column("_segment").to_numpy(zero_copy_only=False).astype(np.int64) * len(features)
            for f, v in enumerate(_numbers(batch, features)):
                of, number = segment + f, _ordered(v)
                if spans is None:
                    number = (number >> _COARSE) + (1 << 63 - _COARSE)
                elif spans[f][0].size:
                    first, last = spans[f]
                    at = np.searchsorted(first, number, side="right") - 1
                    inside = np.flatnonzero((at >= 0) & (number <= last[at]))
                    of, number, v = of[inside], at[inside], v[inside]
                else:
                    continue
                yield [of << bits | number], [np.ones(v.size, np.int64), v, v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(parts(batches), [np.add, np.minimum, np.maximum])
        if found is not None:
            yield from _record_batches([*found[0], *found[1]], ["key", "n", "low", "top"])

    out = rows.mapInArrow(run, "key long, n long, low double, top double").groupBy("key").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("top").alias("top")).toPandas()  # bounded by segments x intervals
    of, number = out["key"].to_numpy(np.int64) >> bits, out["key"].to_numpy(np.int64) & ((1 << bits) - 1)
    feature = of % len(features)
    at = (number - (1 << 63 - _COARSE)) << _COARSE
    if spans is not None:
        for f, (first, _) in enumerate(spans):
            at[feature == f] = first[number[feature == f]]
    return out.assign(feature=feature, segment=of // len(features), at=at)


def _edges_of(rows: DataFrame, features: list[str], n_segments: int) -> list[list[np.ndarray]]:
    """Edges per segment and feature: values at the 1/64, 2/64, … of all rows of the segments up to this one, each at most an eighth of a bin off."""
    spans, known = None, pd.DataFrame()
    while True:
        found = _interval_counts(rows, features, spans)
        known = pd.concat([known, found]) if len(known) else found
        edges, spans, light = [[np.zeros(0)] * len(features) for _ in range(n_segments)], [(np.zeros(0, np.int64),) * 2] * len(features), []
        for f, g in known.groupby("feature"):
            at, place = np.unique(g["at"].to_numpy(np.int64), return_inverse=True)
            tables = [np.full((n_segments, at.size), v) for v in (0.0, np.inf, -np.inf)]
            for table, name, ufunc in zip(tables, ("n", "low", "top"), (np.add, np.minimum, np.maximum)):
                table[g["segment"].to_numpy(np.int64), place] = g[name].to_numpy(float)
                ufunc.accumulate(table, axis=0, out=table)
            heavy = np.zeros(at.size, bool)
            for k, (n, low, top) in enumerate(zip(*tables)):
                upto = n.cumsum()
                hit = np.searchsorted(upto, np.floor((upto[-1] - 1) * (np.arange(1, BINS) / BINS)), side="right")
                edges[k][f] = np.unique(top[hit])
                heavy[hit[(n[hit] > upto[-1] * _HEAVY) & (low[hit] < top[hit])]] = True
            ends = [(int(a), int(b)) for a, b in zip(*(_ordered(t[-1][heavy]) for t in tables[1:]))]
            each = max(_PARTS, _ALL_PARTS // max(1, len(ends)))
            parts = [(a + (b + 1 - a) * i // each, a + (b + 1 - a) * (i + 1) // each - 1) for a, b in ends for i in range(each)]
            spans[f] = tuple(np.array([p[i] for p in parts if p[0] <= p[1]], np.int64) for i in (0, 1))
            light.append(g[~heavy[place]])
        if not any(first.size for first, _ in spans):
            return edges
        known = pd.concat(light)  # the parts take the place of an interval that is cut


def _cuts(days: list[tuple], rows: DataFrame, ends: dict[int, object], order: list[str]) -> dict[int, tuple]:
    """(day, key of the day's last row or None for all of them) of the last row that each model is fitted on, in the order of these rows.

    That is the first four fifths of a model's rows in the given order; rows of one key stay together. ``days`` are dates with their rows.
    """
    cuts, within, upto = {}, [], np.cumsum([n for _, n in days])
    for model, end in ends.items():
        n = sum(c for d, c in days if end is None or d <= end)
        if n:
            fit = max(1, int(n * (1 - HOLD_OUT)))
            i = int(np.searchsorted(upto, fit))
            cuts[model] = (fit, days[i][0], None)
            if upto[i] > fit and len(order) > 1:
                within.append((model, days[i][0], fit - int(upto[i]) + days[i][1]))
    if within:
        day = rows.schema[order[0]].dataType
        want = rows.sparkSession.createDataFrame(within, T.StructType([T.StructField("_model", T.IntegerType()), T.StructField("_day", day), T.StructField("_place", T.LongType())]))
        keys = rows.where(F.col(order[0]).isin([d for _, d, _ in within])).groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
        keys = keys.withColumn("_upto", F.sum("_n").over(Window.partitionBy(order[0]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)))
        at = keys.join(F.broadcast(want), F.col(order[0]) == F.col("_day")).where("_upto >= _place and _upto - _n < _place")
        for r in at.select("_model", *order[1:]).collect():
            cuts[r[0]] = (*cuts[r[0]][:2], tuple(r)[1:])
    return {m: cut[1:] for m, cut in sorted(cuts.items(), key=lambda c: c[1][0])}


def _on_time_line(rows: DataFrame, days: list[tuple], cuts: dict[int, tuple], ends: dict[int, object], order: list[str]) -> DataFrame:
    """Rows with ``_segment``, the number of models (in the order of ``cuts``) that are fitted on earlier rows only, and ``_ended``, of models whose rows
    all lie before. Days are looked up in a table of one row per date; only on a day with a cut keys are compared."""
    within = {d: [key for day, key in cuts.values() if day == d and key is not None] for d, _ in days}
    keys = [f"_key{i}" for i in range(max(map(len, within.values())))]  # as many as the day with most cuts has
    table = [(d, sum(day < d for day, _ in cuts.values()), sum(ends[m] is not None and ends[m] < d for m in cuts),
              *within[d], *[None] * (len(keys) - len(within[d]))) for d, _ in days]
    key = T.StructType([rows.schema[c] for c in order[1:]])
    schema = T.StructType([T.StructField("_day", rows.schema[order[0]].dataType), T.StructField("_passed", T.IntegerType()), T.StructField("_ended", T.IntegerType()),
                           *(T.StructField(k, key) for k in keys)])
    placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), F.col(order[0]) == F.col("_day")).where(F.col("_ended") < len(cuts))
    passed = [F.when(F.col(k) < F.struct(*order[1:]), 1).otherwise(0) for k in keys]
    return placed.withColumn("_segment", reduce(Column.__add__, passed, F.col("_passed")))


@dataclass(frozen=True)
class _Packing:
    """Bins of several features as few whole numbers."""

    n_features: int
    n_bins: int

    @property
    def per_word(self) -> int:
        return max(1, 62 // max(1, (self.n_bins - 1).bit_length()))

    @property
    def names(self) -> list[str]:
        return [f"w{i}" for i in range(math.ceil(max(1, self.n_features) / self.per_word))]

    def words(self, bins: np.ndarray) -> Arrays:
        words = [np.zeros(bins.shape[1], np.int64) for _ in self.names]
        for i, b in enumerate(bins):
            words[i // self.per_word] = words[i // self.per_word] * self.n_bins + b
        return words

    def bins(self, words: Arrays) -> np.ndarray:
        words, bins = list(words), np.zeros((self.n_features, words[0].size), np.int64)
        for i in reversed(range(self.n_features)):
            words[i // self.per_word], bins[i] = np.divmod(words[i // self.per_word], self.n_bins)
        return bins


_LIMB = 30  # bits of either part of a label
_SUMS = ["n", "high", "low"]


def _types(ints: list[str], longs: list[str]) -> str:
    return ", ".join([*(f"{c} int" for c in ints), *(f"{c} long" for c in longs)])


def _fine_sums(rows: DataFrame, features: list[str], edges: list[np.ndarray], packing: _Packing, scale: int) -> DataFrame:
    """(_segment, _ended, words…, n, high, low) of the rows by bins of ``edges``: their number and the sum of their labels ``_y`` as two integers."""
    at = ["_segment", "_ended"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Arrays, Arrays]]:
        for batch in batches:
            bins = np.stack([np.searchsorted(e, row) for e, row in zip(edges, _numbers(batch, features))])
            y = np.ldexp(batch.column("_y").to_numpy(zero_copy_only=False), _LIMB - scale)
            high = np.rint(y)
            place = batch.column(at[0]).to_numpy(zero_copy_only=False).astype(np.int64) << 31 | batch.column(at[1]).to_numpy(zero_copy_only=False)
            yield [*packing.words(bins), place], [np.ones(y.size, np.int64), high.astype(np.int64), np.rint(np.ldexp(y - high, _LIMB)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(parts(batches), [np.add] * 3)
        if found is not None:
            *words, place = found[0]
            yield from _record_batches([(place >> 31).astype(np.int32), (place & (1 << 31) - 1).astype(np.int32), *words, *found[1]], [*at, *packing.names, *_SUMS])

    found = rows.select(*at, "_y", *features).mapInArrow(run, _types(at, [*packing.names, *_SUMS]))
    return found.groupBy(*at, *packing.names).agg(*(F.sum(c).alias(c) for c in _SUMS))


def _cell_sums(sums: DataFrame, fine: _Packing, places: dict[int, Arrays], packing: _Packing) -> DataFrame:
    """(model, _held, words…, n, high, low) of ``sums`` with ``model`` and ``_held``; ``places`` gives the model's bin of every fine bin."""

    def by_model(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            model = batch.column("model").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(model[1:] != model[:-1]) + 1).tolist(), model.size] if model.size else []
            yield from ((int(model[i]), batch.slice(i, j - i)) for i, j in zip(bounds, bounds[1:]))

    def part(model: int, batch: pa.RecordBatch) -> tuple[Arrays, Arrays]:
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["_held", *fine.names, *_SUMS]}
        bins = np.stack([p[b] for p, b in zip(places[model], fine.bins([column[c] for c in fine.names]))])
        return [*packing.words(bins), column["_held"].astype(np.int64)], [column[c] for c in _SUMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, pieces in groupby(by_model(batches), key=lambda p: p[0]):
            (*words, held), found = _gathered((part(*p) for p in pieces), [np.add] * 3)
            yield from _record_batches([np.full(held.size, model, np.int32), held.astype(np.int32), *words, *found], ["model", "_held", *packing.names, *_SUMS])

    cells = sums.mapInArrow(run, _types(["model", "_held"], [*packing.names, *_SUMS]))
    return cells.groupBy("model", "_held", *packing.names).agg(*(F.sum(c).alias(c) for c in _SUMS))


def fit_upto(df: DataFrame, ends: dict[int, object], features: list[str], label: str, order: list[str], rounds: int = ROUNDS, rate: float = RATE,
             depth: int = DEPTH) -> Trees:
    """A model for every number in ``ends``, of all complete rows whose first column of ``order`` is not above the given end (None: of all rows).

    The last fifth of a model's rows in the given order picks its best round. ``df`` is read several times, so it should be written before.
    """
    rows = df.select(*order, *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y")).dropna(
        subset=[order[0], *features, "_y"]).where(F.abs("_y") < float("inf"))
    per_day = rows.groupBy(order[0]).agg(F.count(F.lit(1)), F.max(F.abs("_y"))).collect()  # one row per date
    days = sorted((r[0], r[1]) for r in per_day)
    cuts = _cuts(days, rows, ends, order)
    if not cuts:
        return Trees(features, {}, depth)
    scale = int(np.frexp(max(r[2] for r in per_day))[1])
    placed = _on_time_line(rows, days, cuts, ends, order)
    found = _edges_of(placed.where(F.col("_segment") < len(cuts)).select("_segment", *features), features, len(cuts))
    edges = dict(zip(cuts, found))
    union = [np.unique(np.concatenate(e)) for e in zip(*found)]
    fine, packing = _Packing(len(features), 1 + max(e.size for e in union)), _Packing(len(features), BINS)
    sums = materialize(_fine_sums(placed, features, union, fine, scale), "sums")
    counts = dict(tuple(r) for r in sums.groupBy("_ended").count().collect())
    places = {m: [np.append(np.searchsorted(e, u), e.size) for e, u in zip(edges[m], union)] for m in cuts}
    parts = []
    for i, m in enumerate(cuts):
        n = sum(c for ended, c in counts.items() if ended <= i)
        own = sums.where(F.col("_ended") <= i).select(F.lit(m).alias("model"), (F.col("_segment") > i).alias("_held"), *fine.names, *_SUMS)
        parts.append(own.coalesce(1 + math.ceil(n / SLICE_ROWS)))  # two slices at least: Spark puts tables of one partition into one task
    cells = _cell_sums(reduce(DataFrame.unionAll, reversed(parts)), fine, places, packing)  # the largest first

    def run(group: pd.DataFrame) -> pd.DataFrame:
        model, group = int(group["model"].iloc[0]), group.sort_values(packing.names)
        bins, late = packing.bins([group[w].to_numpy(np.int64) for w in packing.names]), group["_held"].to_numpy() == 1
        total = np.ldexp(group["high"].to_numpy(float), scale - _LIMB) + np.ldexp(group["low"].to_numpy(float), scale - 2 * _LIMB)
        n = group["n"].to_numpy(float)
        own, held = ((np.ascontiguousarray(bins[:, at]), n[at], total[at]) for at in (~late, late))
        trees = _grow_cells(edges[model], own, held, rounds, rate, depth)
        return pd.DataFrame([(model, i, *t) for i, t in enumerate(trees)], columns=["model", "round", "feature", "cut", "value", "gain", "error"])

    models: dict[int, list[tuple]] = {}
    # bounded by groups x rounds x nodes
    spread = cells.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "model")  # AQE would merge models into a few tasks
    for r in sorted(spread.groupBy("model").applyInPandas(run, _MODEL).collect(), key=lambda r: (r["model"], r["round"])):
        models.setdefault(r["model"], []).append((np.array(r["feature"], np.int32), np.array(r["cut"]), np.array(r["value"]), np.array(r["gain"]), r["error"]))
    return Trees(features, models, depth)


def fit(rows: DataFrame, features: list[str], label: str, order: list[str], **tree_args) -> Trees:
    """A model for every value of ``model``, each of all its rows."""
    out = Trees(features, {}, tree_args.get("depth", DEPTH))
    for r in rows.select("model").distinct().collect():
        out.models |= fit_upto(rows.where(F.col("model") == r["model"]).drop("model"), {r["model"]: None}, features, label, order, **tree_args).models
    return out
