import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from barloom.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "The cat sat", "the Cat\x0bsat on THE mat", "ÄÖ über straße", "日本 🙂 🙂", "x" * 450, "a b c " * 50, "the the the"]


@pytest.fixture(scope="module")
def vocab():
    return lattice.vocabulary(PATH)


def brute(word, logp, plain):
    """Sum over all segmentations, by trying every first piece."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(len(word), 16) + 1):
        p = plain.get(word[:k])
        if p is None and k == 1:
            p = sum(logp[f"<0x{b:02X}>"] for b in word[0].encode())
        if p is not None:
            total += math.exp(p) * brute(word[k:], logp, plain)
    return total


def test_forward_equals_the_sum_over_segmentations(vocab):
    logp = np.append(lattice.initial_weights(vocab), -3.0)
    net = lattice.Lattice([p for p, _ in vocab], logp)
    table = {p: logp[i] for i, (p, _) in enumerate(vocab)}
    words = ["the", "cat", "straße", "🙂", "日x", "internation", "<0x41>", "qq"]
    for w, got in zip(words, net.log_probability(words)):
        assert got == pytest.approx(math.log(brute("▁" + w, table, {k: v for k, v in table.items() if not re.fullmatch("<0x..>", k)})), rel=1e-9)
    long = "".join(random.Random(1).choice("abce") for _ in range(230))
    assert net._forward_one("▁" + "internation")[-1] == pytest.approx(net.log_probability(["internation"])[0])
    counts = net.expected_counts([long, "cat"], np.array([1.0, 2.0]))
    assert sum(counts[i] * len(p) for i, (p, _) in enumerate(vocab)) == pytest.approx(len(long) + 1 + 2 * 4)


def test_scores_of_documents(spark, vocab):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS * 3)] + [(4, TEXTS[4], 1), (None, "the mat", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = lattice.score(docs, PATH).collect()
    assert len(got) == len(rows)

    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + ["\n"]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    c = Counter(w for i, t, _ in rows if not held[i] for w in toks(t))
    n, v = sum(c.values()), len(c)
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        r, w = by_id[i], toks(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0 and math.isfinite(r.score)
    assert sum(r.doc_id == 4 for r in got) == 2
    assert lattice.score(docs.limit(0), PATH).count() == 0


def test_rare_words_take_the_other_way_to_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id long, text string")
    want = {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lattice.score(docs, PATH).collect()}
    monkeypatch.setattr(lattice, "FREQUENT", 3)
    assert {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lattice.score(docs, PATH).collect()} == want


def test_fitting_raises_the_likelihood(spark, vocab):
    docs = spark.createDataFrame([(1, "wordwise weighing of the words " * 5, False)], "doc_id long, text string, held_out boolean")
    counts = lattice.count_words(docs)
    words = {r.word: r.c for r in counts.collect() if r.word != lattice.END}
    pieces = [p for p, _ in vocab]
    total = []
    for rounds in (0, 1, 3):
        net = lattice.Lattice(pieces, lattice.fit(counts, vocab, rounds))
        total.append(float(net.log_probability(list(words)) @ np.array(list(words.values()))))
    assert total[0] < total[1] <= total[2] + 1e-6
