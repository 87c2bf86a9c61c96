"""Packing of tokenised documents into fixed sequences (operator 9).

A document is cut into full windows and one tail. Lengths are counted in units of ``UNIT`` tokens, rounded up, so the
histogram of tails has at most window / UNIT classes however many documents there are; only it reaches the driver.
There, combinations of up to three classes that fill a window exactly are enumerated, non-negative least squares finds
how often to repeat each so that the histogram is used up, the counts are rounded down, and what they leave over
is packed greedily, largest class first, again on counts. The plan is a short table of rank ranges; each piece looks up
its rank within its class. Ranks come from counts per (class, salt), so a class with a third of all rows is spread over
many tasks. A word's ids are looked up in a bounded cache; the tokenizer works word by word, as it drops white space.

Defined cases: null text is empty and gives the end id alone; a text of any length is tokenised whole in slices; repeated
rows are packed each for itself; null doc_id is carried along; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.session import materialize

WINDOW = 2048
UNIT = 8
END_ID = 1
CACHED_WORDS = 500_000
SALT_ROWS = 20_000  # pieces ranked in one group
_SLICE = 1 << 20  # characters tokenised at once
#: White space of the tokenizer's pattern; str.split() knows four more characters.
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_OTHER_GAPS = re.compile("[\x1c-\x1f]")
#: Composed Latin letters, then signs that no rule of the tokenizer joins to letters.
_PARTS = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-;=?@\\[-`{}~]*)")


class _Known(dict):
    """A bounded cache; what it has no room for is looked up in ``fresh``, the words of the texts at hand."""

    fresh: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.fresh[word]

    def add(self, new: dict[str, bytes]) -> None:
        """Words seen first are mostly the frequent ones: a full cache keeps them."""
        self.fresh = new
        if len(self) + len(new) <= CACHED_WORDS:
            self.update(new)


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, word by word.

    A word that is Latin letters and then other characters is put together from the ids of both parts. New letter parts go to the
    tokenizer many at once in one text; the tokens that end a word show where to cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocab.items() if token.endswith("</w>")]] = True
        # parts are independent only if the tokenizer marks ends of words, drops white space and parts letters from signs
        self.parted = self.ends.any() and self._ids("Words, more!") == sum(map(self._ids, ["words", ",", "more", "!"]), [])
        self.words, self.parts = _Known(), _Known()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, parts: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(parts), 20_000):
            some = parts[at:at + 20_000]
            lines = [" ".join(some[k:k + 100]) for k in range(0, len(some), 100)]
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cut = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            raw, begin = ids.tobytes(), 0
            if len(cut) != len(some):
                raise ValueError("the tokenizer splits words of letters")
            for word, stop in zip(some, cut.tolist()):
                out[word] = raw[begin:stop]
                begin = stop
        return out

    def _whole(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(words), 20_000):
            some = words[at:at + 20_000]
            out |= {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False))}
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        split = [(w, _PARTS.fullmatch(w) if self.parted else None) for w in words]
        new = self._whole([w for w, m in split if m is None])
        split = [(w, m[1].lower(), m[2]) for w, m in split if m]
        letters = self._letters([p for p in {p for _, p, _ in split} if p not in self.parts])
        signs = self._whole([p for p in {p for _, _, p in split} if p not in self.parts])
        self.parts.add(letters | signs)
        for w, a, b in split:
            new[w] = self.parts[a] + self.parts[b]
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_GAP.split(t) if _OTHER_GAPS.search(t) else t.split() for t in texts]
        self.words.add(self._learn([w for w in set().union(*split) if w not in self.words]))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


_LOADED: dict[str, WordIds] = {}  # one per Python worker, kept over its tasks


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _cuts(text: str) -> Iterator[str]:
    """The text in slices of about ``_SLICE`` characters, cut at white space."""
    at = 0
    while len(text) - at > _SLICE:
        gap = _GAP.search(text, at + _SLICE)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def find_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and the tail of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            out = []
            todo, size = [], 0
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("text")))
            for k, (doc, text) in enumerate(rows):
                text = text.as_py() or ""
                if len(text) > _SLICE:
                    out += _pieces(doc, b"".join([*(words.encode([t])[0] for t in _cuts(text)), end]), window)
                else:
                    todo.append((doc, text))
                    size += len(text)
                if size > 4 * _SLICE or k == len(rows) - 1:
                    for (d, _), ids in zip(todo, words.encode([t for _, t in todo]) if todo else []):
                        out += _pieces(d, ids + end, window)
                    todo, size = [], 0
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _pieces(doc: int | None, ids: bytes, window: int) -> list[tuple]:
    n = len(ids) // 4
    return [(doc, at, min(window, n - at), zlib.crc32(ids[4 * at:4 * (at + window)]), n) for at in range(0, n, window)]


def combinations(classes: int) -> list[tuple[int, ...]]:
    """All multisets of one to three classes that sum to ``classes``, largest first."""
    out = [(classes,)]
    for a in range(classes - 1, 0, -1):
        if 2 * a >= classes:
            out.append((a, classes - a))
        out += [(a, b, classes - a - b) for b in range(min(a, classes - a - 1), 0, -1) if b >= classes - a - b]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative x with least ||a x - b||, by the active-set method; never more than ``rounds`` exchanges."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= 1e-9 * (1 + np.abs(b).max()):
            break
        active.append(j)
        while active:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[active] = z
                break
            now = x[active]
            low = z <= 1e-12
            step = float(np.min(now[low] / np.maximum(now[low] - z[low], 1e-300)))
            x[active] = now + step * (z - now)
            x[[k for k, bad in zip(active, low) if bad and x[k] <= 1e-9]] = 0
            kept = [k for k in active if x[k] > 0]
            active = kept if len(kept) < len(active) else [k for k, bad in zip(active, low) if not bad]
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(classes of one sequence, repeats) that use up the histogram; entry c counts the pieces of class c."""
    classes = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[classes]:
        out.append(((classes,), int(left[classes])))
        left[classes] = 0
    usable = [c for c in combinations(classes) if all(left[k] for k in c)]
    if usable:
        a = np.zeros((classes + 1, len(usable)))
        for j, c in enumerate(usable):
            np.add.at(a[:, j], list(c), 1.0)
        for j, times in enumerate(np.floor(nnls(a, left.astype(float), 3 * classes) + 1e-9).astype(np.int64)):
            need = np.bincount(usable[j], minlength=classes + 1)
            times = int(min(times, *(left[k] // need[k] for k in set(usable[j]))))
            if times > 0:
                out.append((usable[j], times))
                left -= times * need
    while left.any():
        room, sequence, free = classes, [], left.copy()
        while (fits := np.flatnonzero(free[: room + 1])).size:
            c = int(fits[-1])
            take = int(min(free[c], room // c))
            sequence += [c] * take
            free[c] -= take
            room -= c * take
        need = np.bincount(sequence, minlength=classes + 1)
        times = int(min(left[k] // need[k] for k in set(sequence)))
        out.append((tuple(sequence), times))
        left -= times * need
    return out


def ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, past rank, uses per sequence, first sequence) for every class of every pattern."""
    out, used, base = [], {}, 0
    for sequence, times in patterns:
        for c in sorted(set(sequence)):
            uses, at = sequence.count(c), used.get(c, 0)
            out.append((c, at, at + uses * times, uses, base))
            used[c] = at + uses * times
        base += times
    return out


def assign(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` must be stored: it is read for the counts and for the ranks."""
    spark = pieces.sparkSession
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / UNIT).cast("int"))
    histogram = np.zeros(-(-window // UNIT) + 1, dtype=np.int64)
    for r in classed.groupBy("_class").count().collect():  # at most window / UNIT rows
        histogram[r["_class"]] = r["count"]
    table = ranges(plan(histogram)) or [(0, 0, 0, 1, 0)]
    salts = int(histogram.sum()) // SALT_ROWS + 1
    salted = classed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("_class", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    inside = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("_i", inside - 1).join(counts.select("_class", "_salt", before.alias("_before")), ["_class", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_i"))
    # the table has a bounded number of rows: a few for each of window / UNIT classes
    slots = spark.createDataFrame(table, "_class int, _from long, _to long, _uses long, _base long")
    placed = ranked.join(F.broadcast(slots), "_class").where("_rank >= _from and _rank < _to").withColumn(
        "sequence_id", F.col("_base") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_uses")).cast("long"))
    row = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(row) - F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return assign(materialize(find_pieces(docs, path, window), "pieces"), window)
