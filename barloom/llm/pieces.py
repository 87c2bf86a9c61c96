"""Encoding to and decoding from subword pieces (operator 6).

The pieces of a vocabulary lie in a double-array trie over the vocabulary's characters. A text is a start marker and the
text with spaces as markers; the Viterbi path through the trie's matches with the best sum of log scores gives its pieces.
A character that no piece holds costs ``PENALTY`` more than the worst piece and becomes its UTF-8 bytes.
Where no piece runs over a boundary (before a marker after other characters, around a line break), paths on both sides are
independent, so texts are encoded chunk by chunk, blocks of chunks of one length at once, and known chunks are taken
from a bounded cache. A text is held as the numbers of its chunks, four bytes each, and results leave the task slice by slice.
The trie is built once on the driver; its size is that of the vocabulary.

Defined cases: null stays null; an empty text has no pieces; a marker character in the text itself goes to bytes, so every text comes
back unchanged; unknown or null ids decode to nothing; texts of any length are encoded in slices; an empty table gives no rows;
further columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.lattice import START, initial_weights, vocabulary

PENALTY = 10.0
CACHED_CHUNKS = 300_000
LONG = 200  # longer chunks are walked one by one
_SLICE = 1 << 20
_BYTE = re.compile("<0x([0-9A-F]{2})>")
_CUT = re.compile(f"(?<=[^{START}]){START}")  # a chunk always starts here


class Trie:
    """Double-array trie: the child of node s by code c is base[s] + c if check of that place is s."""

    def __init__(self, strings: list[list[int]]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, string in enumerate(strings):
            node = 0
            for c in string:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends[node] = k
        codes = 1 + max((c for s in strings for c in s), default=0)
        size = 2 * len(children) + 2 * codes
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, dtype=bool)
        free[0] = False
        place, low = {0: 0}, 1
        # the fullest nodes first find room most easily; a parent's place is known before its children's
        level = [0]
        while level:
            following = []
            for node in sorted(level, key=lambda x: -len(children[x])):
                kids = children[node]
                if not kids:
                    continue
                code = np.array(sorted(kids))
                while not free[low]:
                    low += 1
                b = self._room(free, code, low, codes)
                if b + codes >= len(free):
                    free = self._grow(free, b + codes)
                here = place[node]
                self.base[here] = b
                free[b + code] = False
                self.check[b + code] = here
                for c in kids:
                    place[kids[c]] = b + c
                    following.append(kids[c])
            level = following
        for node, k in ends.items():
            self.value[place[node]] = k
        self.codes = codes

    @staticmethod
    def _room(free: np.ndarray, code: np.ndarray, low: int, codes: int) -> int:
        """Smallest base from which all codes fall on free places."""
        at = max(1, low - int(code[0]))
        while True:
            span = np.arange(at, min(at + 4096, len(free) - int(code[-1])))
            if not len(span):
                return max(at, len(free))
            ok = free[span + code[0]]
            for c in code[1:]:
                ok &= free[span + c]
            hit = np.flatnonzero(ok)
            if len(hit):
                return int(span[hit[0]])
            at = int(span[-1]) + 1

    def _grow(self, free: np.ndarray, need: int) -> np.ndarray:
        more = max(need + 1, 2 * len(free)) - len(free)
        self.base = np.r_[self.base, np.zeros(more, np.int32)]
        self.check = np.r_[self.check, np.full(more, -1, np.int32)]
        self.value = np.r_[self.value, np.full(more, -1, np.int32)]
        return np.r_[free, np.ones(more, dtype=bool)]

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of nodes by codes; -1 for none, for code 0 and from -1."""
        to = np.minimum(self.base[nodes] + codes, len(self.check) - 1)
        return np.where((nodes >= 0) & (codes > 0) & (self.check[to] == nodes), to, -1)


class Encoder:
    """Viterbi encoder of one vocabulary; ids are positions in ``vocab``."""

    def __init__(self, vocab: list[tuple[str, float]]):
        self.scores = np.array([s for _, s in vocab])
        self.bytes = {int(m[1], 16): k for k, (p, _) in enumerate(vocab) if (m := _BYTE.fullmatch(p))}
        plain = [(p, k) for k, (p, _) in enumerate(vocab) if k not in set(self.bytes.values())]
        # the marker stands for a space; a marker in a text must take the way of unknown characters
        alphabet = sorted({c for p, _ in plain for c in p})
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.trie = Trie([self.code[[ord(c) for c in p]].tolist() for p, _ in plain])
        at = self.trie.value >= 0
        self.trie.value[at] = np.array([k for _, k in plain])[self.trie.value[at]]
        self.longest = max(len(p) for p, _ in plain)
        self.unknown = float(self.scores.min()) - PENALTY
        joined = [p for p, _ in plain if len(p) > 1]
        self.by_marker = not any(re.search(f"[^{START}]{START}", p) for p in joined)
        breaks = self.by_marker and not any("\n" in p for p in joined)
        self.chunks = re.compile(f"\n|{START}+[^{START}\n]*|[^{START}\n]+" if breaks else f"{START}+[^{START}]*|[^{START}]+") if self.by_marker else None

    def split(self, text: str) -> Iterator[list[str]]:
        """The chunks of a marked text, about ``_SLICE`` characters of it at a time."""
        at = 0
        while at < len(text) and self.chunks:
            cut = _CUT.search(text, at + _SLICE)
            end = cut.start() if cut else len(text)
            yield self.chunks.findall(text, at, end)
            at = end
        if text and not self.chunks:
            yield [text]

    def coded(self, text: str) -> np.ndarray:
        """Codes of marked text: 0 for unknown characters."""
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def viterbi(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(position, piece ids) of all marked chunks, in any order; -1 in place of a character without a piece."""
        lengths = np.array([len(t) for t in texts])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            width = 4096 if n <= LONG else 1
            for at in range(0, len(rows), width):
                part = rows[at:at + width]
                codes = self.coded("".join(texts[k] for k in part)).reshape(len(part), n)
                yield from zip(part.tolist(), self._block(codes))

    def _block(self, codes: np.ndarray) -> list[list[int]]:
        rows, n = codes.shape
        if rows == 1:
            return [self._one(codes[0])]
        best, start, piece = np.full((n + 1, rows), -np.inf), np.zeros((n + 1, rows), np.int32), np.full((n + 1, rows), -1, np.int64)
        best[0] = 0
        for i in range(n):
            node = np.zeros(rows, dtype=np.int64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                node = self.trie.step(node, codes[:, j - 1])
                ids = np.where(node >= 0, self.trie.value[node], -1)
                score = np.where(ids >= 0, self.scores[ids], self.unknown if j == i + 1 else -np.inf)
                better = best[i] + score > best[j]
                best[j] = np.where(better, best[i] + score, best[j])
                start[j] = np.where(better, i, start[j])
                piece[j] = np.where(better, ids, piece[j])
                if (node < 0).all() and j > i:
                    break
        out = []
        for r in range(rows):
            ids, j = [], n
            while j:
                ids.append(int(piece[j, r]))
                j = int(start[j, r])
            out.append(ids[::-1])
        return out

    def _one(self, codes: np.ndarray) -> list[int]:
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, code = len(codes), codes.tolist()
        best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            node, first = 0, True
            for j in range(i + 1, min(n, i + self.longest) + 1):
                to = int(base[node]) + code[j - 1]
                node = to if code[j - 1] and check[to] == node else -1
                k = int(value[node]) if node >= 0 else -1
                score = scores[k] if k >= 0 else self.unknown if first else -np.inf
                if best[i] + score > best[j]:
                    best[j], start[j], piece[j] = best[i] + score, i, k
                first = False
                if node < 0:
                    break
        ids, j = [], n
        while j:
            ids.append(piece[j])
            j = start[j]
        return ids[::-1]

    def spelt(self, chunk: str, ids: list[int], vocab: list[tuple[str, float]]) -> bytes:
        """The ids as little-endian 32-bit bytes, with bytes in place of characters without a piece."""
        out, at = [], 0
        for k in ids:
            if k >= 0:
                out.append(k)
                at += len(vocab[k][0])
            else:
                char = START if chunk[at] == _LITERAL else chunk[at]
                out += [self.bytes[b] for b in char.encode("utf-8", "replace")]
                at += 1
        return np.array(out, dtype="<i4").tobytes()


#: Stands for a marker character that the text itself contains; no vocabulary has it.
_LITERAL = "\U0010FFFF"


def marked(text: str) -> str:
    """Start marker, and markers for spaces; empty stays empty."""
    return START + text.replace(START, _LITERAL).replace(" ", START) if text else ""


class _Numbers(dict):
    """Chunks by number; a new chunk gets the next one."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = len(self)
        return k


def _encoding(shared, text: str, into: str):
    """A function of record batches that appends the piece ids; a batch comes back in slices of about 8 * ``_SLICE`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, encoder = shared.value
        numbers, known = _Numbers(), []  # the ids of chunk k as bytes are known[k]

        def ids_of(split: list[np.ndarray]) -> list[bytes]:
            new = list(islice(numbers, len(known), None))
            known.extend([b""] * len(new))
            first = len(known) - len(new)
            for k, ids in encoder.viterbi(new):
                known[first + k] = encoder.spelt(new[k], ids, vocab)
            out = [b"".join(map(known.__getitem__, s.tolist())) for s in split]
            if len(known) > CACHED_CHUNKS:
                numbers.clear()
                known.clear()
            return out

        for b in batches:
            column, split, size, first = b.column(text), [], 0, 0
            for r in range(b.num_rows):
                t = column[r].as_py() or ""
                split.append(np.concatenate([np.zeros(0, np.int32), *[np.fromiter(map(numbers.__getitem__, c), np.int32, len(c)) for c in encoder.split(marked(t))]]))
                size += len(t)
                if size > 8 * _SLICE or r == b.num_rows - 1:
                    out, part = ids_of(split), b.slice(first, r + 1 - first)
                    flat = pa.array(np.frombuffer(b"".join(out), dtype="<i4"))
                    offsets = np.r_[0, np.cumsum([len(x) // 4 for x in out])].astype(np.int32)
                    missing = np.r_[part.column(text).is_null().to_numpy(zero_copy_only=False), False]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, mask=missing), flat)
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*b.schema.names, into])
                    split, size, first = [], 0, r + 1

    return run


def _shared_encoder(spark: SparkSession, vocab: list[tuple[str, float]]):
    return spark.sparkContext.broadcast((vocab, Encoder(vocab)))


def encode(docs: DataFrame, vocab: list[tuple[str, float]], text: str = "text", into: str = "ids") -> DataFrame:
    """The documents with the piece ids (positions in ``vocab``) of a text column."""
    fields = docs.schema
    run = _encoding(_shared_encoder(docs.sparkSession, vocab), text, into)
    return docs.mapInArrow(run, type(fields)(list(fields) + [type(fields[0])(into, _array())]))


def _array():
    from pyspark.sql.types import ArrayType, IntegerType

    return ArrayType(IntegerType())


def _spellings(vocab: list[tuple[str, float]]) -> list[bytes]:
    """The UTF-8 bytes that every piece stands for."""
    return [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(START, " ").encode() for p, _ in vocab]


def _texts(table: list[bytes], lists: pa.ListArray) -> list[str | None]:
    """The texts that lists of piece ids stand for."""
    def one(ids: list[int | None] | None) -> str | None:
        if ids is None:
            return None
        raw = b"".join([table[k] for k in ids if k is not None and 0 <= k < len(table)])
        return raw[raw[:1] == b" ":].decode("utf-8", "replace")

    return [one(x.as_py() if x.values is None or x.values.null_count else x.values.to_numpy().tolist()) for x in lists]


def decode(rows: DataFrame, vocab: list[tuple[str, float]], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text that a column of piece ids stands for."""
    shared = rows.sparkSession.sparkContext.broadcast(_spellings(vocab))

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array(_texts(shared.value, column), pa.string())

    return rows.withColumn(into, text(ids))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_hash, same (does decoding give the text back) of every document.

    Texts are encoded and decoded in one Python worker a task; only ids and the comparison leave it.
    """
    vocab = vocabulary(path)
    vocab = list(zip([p for p, _ in vocab], initial_weights(vocab).tolist()))
    spelt = [k for k, (p, _) in enumerate(vocab) if _BYTE.fullmatch(p)]
    encoded = _encoding(_shared_encoder(docs.sparkSession, vocab), "text", "ids")
    shared = docs.sparkSession.sparkContext.broadcast(_spellings(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encoded(batches):
            same = [was.as_py() == t for was, t in zip(b.column("text"), _texts(shared.value, b.column("ids")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(same, pa.bool_())], names=["doc_id", "ids", "same"])

    docs = docs.select("doc_id", "text")
    key, fields = docs.schema["doc_id"], type(docs.schema)
    out = docs.mapInArrow(run, fields([key]).add("ids", _array()).add("same", "boolean"))
    n_bytes = F.size(F.filter("ids", lambda x: (x >= min(spelt)) & (x <= max(spelt))))
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), n_bytes.cast("long").alias("n_bytes"), F.xxhash64("ids").alias("ids_hash"), "same")
