"""Document probability under a subword lattice (operator 2).

The pieces of an existing vocabulary span a lattice over each word (its start marked as the vocabulary does); the
probability of a word is the sum over all its segmentations, by a forward recursion in log space. Piece probabilities
start from the vocabulary's scores and are re-estimated on the training documents by expectation maximisation over
the table of distinct words with their counts. A document is its words and one end token.

Only distinct words go through the lattice. Their values return to the documents in two ways: words above a count that at most
``FREQUENT`` words reach are broadcast (at most so many entries of at most ``SHORT`` bytes, longer words as digests) and summed where
the text is; all other words of a text, with their numbers, are joined by a shuffle, and as they are rare no key is hot. Beside that
table the driver sees piece counts, one number per piece of the vocabulary.

Defined cases: null text is empty and scores its end token; repeated rows are scored each for itself; a null doc_id counts as training;
without training tokens V and N are 0 and pieces keep their initial weights; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.quality import bucket, bucket_top
from barloom.llm.rolling import U, mix, powers, utf8
from barloom.session import materialize

START = "▁"
END = "\n"  # no word can be this
FREQUENT = 200_000
SHORT = 64  # bytes of a word that the broadcast table holds as it is
HELD = 400_000  # distinct words that a task counts before it hands them on
ROUNDS = 2
SMOOTHING = 0.01  # added to every piece's expected count
LONG = 200  # words above this length are walked one by one
TOGETHER = 100_000  # words that go through the lattice at once, so that each length makes a long block
EDGES = 2_000_000  # lattice edges of one block
_BASE = 0x9E3779B97F4A7C15
_SLOTS = 22


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model file; control pieces are left out, byte pieces keep their <0xNN> form."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]


def initial_weights(vocab: list[tuple[str, float]]) -> np.ndarray:
    """Log probabilities from the scores: the k-th best score gets a share like 1 / (k + 100)."""
    order = np.argsort(np.argsort([-s for _, s in vocab], kind="stable"), kind="stable")
    p = 1.0 / (order + 100.0)
    return np.log(p / p.sum())


class Lattice:
    """Pieces with log probabilities; ``len(pieces)`` entries, the last extra one for the end token."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.logp = logp
        self.id = {p: i for i, p in enumerate(pieces)}
        self.bytes = np.array([self.id[f"<0x{b:02X}>"] for b in range(256)])
        plain = [(p, i) for p, i in self.id.items() if not (len(p) == 6 and p.startswith("<0x"))]
        self.plain = dict(plain)
        self.longest = max(len(p) for p in self.plain)
        size = LONG + 2
        self.up, self.down = powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size)
        keys = np.array([self._keys(np.array([[ord(c) for c in p]]))[0, -1] for p, _ in plain], dtype=U)
        keys = mix(keys + np.array([len(p) for p, _ in plain], dtype=U))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in plain])[order]
        self.seen = np.zeros(1 << _SLOTS, dtype=bool)
        self.seen[keys >> U(64 - _SLOTS)] = True

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        return np.cumsum(mix(codes.astype(U) + U(1)) * self.up[: codes.shape[1]], axis=1, dtype=U)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of hashed strings, -1 where there is none."""
        out = np.full(len(keys), -1)
        maybe = np.flatnonzero(self.seen[keys >> U(64 - _SLOTS)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out

    def _fallback(self, char: str) -> np.ndarray:
        """Byte pieces of a character that is no piece."""
        return self.bytes[list(char.encode(errors="replace"))]

    def _edges(self, codes: np.ndarray):
        """(from, to, piece ids, log probabilities) of a block of words of equal length; -1 marks a character spelt in bytes."""
        n = codes.shape[1]
        sums = np.concatenate([np.zeros((len(codes), 1), dtype=U), self._keys(codes)], axis=1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                ids = self._find(mix((sums[:, j] - sums[:, i]) * self.down[i] + U(j - i)))
                lp = np.where(ids >= 0, self.logp[ids], -np.inf)
                if j == i + 1 and (ids < 0).any():
                    for c in np.unique(codes[ids < 0, i]):
                        lp[(ids < 0) & (codes[:, i] == c)] = self.logp[self._fallback(chr(c))].sum()
                yield i, j, ids, lp

    def _blocks(self, texts: list[str]):
        """Word numbers and code points by length; long words come alone."""
        lengths = np.array([len(t) for t in texts])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            if n > LONG:
                yield from ((rows[k:k + 1], None) for k in range(len(rows)))
                continue
            width = max(1, EDGES // (int(n) * min(int(n), self.longest)))
            for at in range(0, len(rows), width):
                part = rows[at:at + width]
                raw = "".join(texts[k] for k in part).encode("utf-32-le", "surrogatepass")
                yield part, np.frombuffer(raw, dtype=np.uint32).reshape(len(part), n).astype(np.int64)

    def _walk(self, word: str):
        """Edges of one word from a dictionary: (from, to, ids, log probability), by end."""
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - self.longest), j):
                k = self.plain.get(word[i:j])
                if k is not None:
                    yield i, j, (k,), self.logp[k]
                elif j == i + 1:
                    ids = self._fallback(word[i])
                    yield i, j, ids, self.logp[ids].sum()

    def log_probability(self, texts: list[str]) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        out = np.zeros(len(texts))
        for rows, codes in self._blocks([START + t for t in texts]):
            if codes is None:
                out[rows[0]] = self._forward_one(START + texts[rows[0]])[-1]
                continue
            a = np.full((codes.shape[1] + 1, len(rows)), -np.inf)
            a[0] = 0
            for i, j, _, lp in self._edges(codes):
                a[j] = np.logaddexp(a[j], a[i] + lp)
            out[rows] = a[-1]
        return out

    def _forward_one(self, word: str) -> list[float]:
        a = [-math.inf] * (len(word) + 1)
        a[0] = 0.0
        for i, j, _, lp in self._walk(word):
            x, y = (a[j], a[i] + lp) if a[j] > a[i] + lp else (a[i] + lp, a[j])
            if y > -math.inf:
                x += math.log1p(math.exp(y - x))
            a[j] = x
        return a

    def expected_counts(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """How often each piece is used over all segmentations, weighted by their probability and the words' counts."""
        out = np.zeros(len(self.logp))
        for rows, codes in self._blocks([START + t for t in texts]):
            if codes is None:
                self._expect_one(START + texts[rows[0]], float(weights[rows[0]]), out)
                continue
            edges = list(self._edges(codes))
            n, w = codes.shape[1], weights[rows]
            a, b = np.full((n + 1, len(rows)), -np.inf), np.full((n + 1, len(rows)), -np.inf)
            a[0], b[n] = 0, 0
            for i, j, _, lp in edges:
                a[j] = np.logaddexp(a[j], a[i] + lp)
            for i, j, _, lp in reversed(edges):
                b[i] = np.logaddexp(b[i], b[j] + lp)
            for i, j, ids, lp in edges:
                share = w * np.exp(a[i] + lp + b[j] - a[n])
                known = ids >= 0
                out += np.bincount(ids[known], share[known], minlength=len(out))
                for k in np.flatnonzero(~known & (share > 0)):
                    np.add.at(out, self._fallback(chr(codes[k, i])), share[k])
        return out

    def _expect_one(self, word: str, weight: float, out: np.ndarray) -> None:
        edges, a = list(self._walk(word)), self._forward_one(word)
        b = [-math.inf] * len(a)
        b[-1] = 0.0
        for i, j, ids, lp in reversed(edges):
            x, y = max(b[i], b[j] + lp), min(b[i], b[j] + lp)
            b[i] = x + (math.log1p(math.exp(y - x)) if y > -math.inf else 0.0)
        for i, j, ids, lp in edges:
            np.add.at(out, list(ids), weight * math.exp(min(0.0, a[i] + lp + b[j] - a[-1])))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches joined to ones of about ``TOGETHER`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _token_lists(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The words of each text, A-Z lower-cased. ``bytes.split`` parts at just the bytes 0x20 and 0x09 to 0x0D."""
    data, offsets = utf8(batch.column("text"))
    for i in range(batch.num_rows):
        yield data[offsets[i]:offsets[i + 1]].tobytes().lower().split()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, total): counts in training documents and in all; the end token is the word END.

    A task counts up to ``HELD`` distinct words before it hands them on, so the shuffle carries counts, not tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, training = Counter(), Counter()

        def out() -> pa.RecordBatch:
            columns = [_strings(list(every)), pa.array([training[w] for w in every], pa.int64()), pa.array(list(every.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "c", "total"])

        for b in batches:
            for tokens, held in zip(_token_lists(b), b.column("held_out").to_pylist()):
                tokens.append(END.encode())
                every.update(tokens)
                if not held:
                    training.update(tokens)
                if len(every) >= HELD:
                    yield out()
                    every, training = Counter(), Counter()
        yield out()

    return docs.select("held_out", "text").mapInArrow(run, "word string, c long, total long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def _entry(word: bytes) -> bytes:
    """The word as a key of the broadcast table: a long one by its digest, which bounds the table's size."""
    return word if len(word) <= SHORT else b" " + blake2b(word, digest_size=16).digest()


def fit(counts: DataFrame, vocab: list[tuple[str, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the end token, by expectation maximisation over the training words."""
    spark = counts.sparkSession
    pieces = [p for p, _ in vocab]
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    logp = np.append(initial_weights(vocab) + math.log(0.98), math.log(0.02))
    train = counts.where((F.col("c") > 0) & (F.col("word") != END)).select("word", "c")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, logp))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            total = np.zeros(len(lattice.logp))
            for b in _gathered(batches):
                total += lattice.expected_counts(b.column("word").to_pylist(), np.array(b.column("c"), dtype=float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        got = train.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most one row per piece
        if not got:
            return logp
        n = np.full(len(logp), SMOOTHING)
        np.add.at(n, [r.piece for r in got], [r.n for r in got])
        n[-1] += ends
        logp = np.log(n / n.sum())
    return logp


def score(docs: DataFrame, path: str, held_out_remainder: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    marked = docs.select("doc_id", "text", F.coalesce(fold == held_out_remainder, F.lit(False)).alias("held_out"))
    counts = materialize(count_words(marked), "words")
    n, v = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    vocab = vocabulary(path)
    shared = spark.sparkContext.broadcast(([p for p, _ in vocab], fit(counts, vocab)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for b in _gathered(batches):
            w = b.column("word").to_pylist()
            lp = lattice.log_probability(w)
            lp[[k for k, x in enumerate(w) if x == END]] = lattice.logp[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp / math.log(10))], names=["word", "c", "total", "model"])

    valued = materialize(counts.mapInArrow(run, "word string, c long, total long, model double"), "valued").select(
        "word", "total", (F.col("c") > 0).alias("known"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("base"), "model")

    # the count that at most FREQUENT words reach, from a histogram of counts
    at, least = 0, 0
    for r in valued.groupBy(bucket(F.col("total")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(bucket_top(bucket(F.col("total")))).alias("top")).orderBy(F.desc("b")).collect():
        at += r.n
        if at > FREQUENT:
            least = r.top + 1
            break

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(0, "word", pa.array([_entry(w) for w in b.column("word").cast(pa.binary()).to_pylist()], pa.binary()))

    top = valued.where(F.col("total") >= least).drop("total").mapInArrow(entries, "word binary, known boolean, base double, model double").toArrow()  # at most FREQUENT rows
    values = [np.array(top.column(c), dtype=float) for c in ("known", "base", "model")]
    table = spark.sparkContext.broadcast((top.column("word").to_pylist(), values))
    first = materialize(marked.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(
        lambda batches: _sum_frequent(batches, *table.value), f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, "
        "n_tokens long, n_known double, base_score double, score double, rare array<struct<word:string,n:long>>"), "frequent")
    names = ["n_known", "base_score", "score"]
    far = (first.select("row", F.inline("rare")).join(valued.where(F.col("total") < least), "word")
           .groupBy("row").agg(*[F.sum(F.col("n") * F.col(c).cast("double")).alias(f"far_{t}") for c, t in zip(("known", "base", "model"), names)]))
    both = first.drop("rare").join(far, "row", "left").withColumns({c: F.col(c) + F.coalesce(f"far_{c}", F.lit(0.0)) for c in names})
    return both.select("doc_id", "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _sum_frequent(batches: Iterator[pa.RecordBatch], entries: list[bytes], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each text its tokens' number, the sums over words that the table holds, and its other words with their numbers."""
    place = {w: i for i, w in enumerate(entries)}
    end = place.get(END.encode(), -1)
    for b in batches:
        n, sums, words, times, ends = [], [], [], [], [0]
        for tokens in _token_lists(b):
            at = np.fromiter(chain(map(place.get, tokens, repeat(-1)), (end,)), np.int64, len(tokens) + 1)
            tokens.append(END.encode())
            others = Counter()
            for k in np.flatnonzero(at < 0):
                if len(tokens[k]) > SHORT:
                    at[k] = place.get(_entry(tokens[k]), -1)
                if at[k] < 0:
                    others[tokens[k]] += 1
            known = at[at >= 0]
            n.append(len(tokens))
            sums.append([v[known].sum() for v in values])
            words.extend(others)
            times.extend(others.values())
            ends.append(len(words))
        rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([_strings(words), pa.array(times, pa.int64())], names=["word", "n"]))
        sums = np.array(sums, dtype=float).reshape(-1, len(values))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "held_out")), pa.array(n, pa.int64()), *map(pa.array, sums.T.copy()), rare],
                                         names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])
