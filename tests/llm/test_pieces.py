import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from barloom.llm import pieces
from barloom.llm.lattice import initial_weights, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    v = vocabulary(PATH)
    return list(zip([p for p, _ in v], initial_weights(v).tolist()))


def best(text, vocab):
    """Largest sum of scores over the whole marked text, and the ids of one path that reaches it, without chunks or trie."""
    table = {p: k for k, (p, _) in enumerate(vocab) if not pieces._BYTE.fullmatch(p)}
    by_byte = {int(m[1], 16): k for k, (p, _) in enumerate(vocab) if (m := pieces._BYTE.fullmatch(p))}
    low, t = min(s for _, s in vocab) - pieces.PENALTY, pieces.marked(text)
    score = [0.0] + [-1e18] * len(t)
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - 20), j):
            k = table.get(t[i:j])
            s = vocab[k][1] if k is not None else low if j == i + 1 else None
            if s is not None and score[i] + s > score[j]:
                score[j] = score[i] + s
    return score[-1], table, by_byte, low


def test_encoding_is_the_best_path_and_comes_back(spark, vocab):
    rnd = random.Random(6)
    parts = ["the", "Straße", "naïve", " ", "  ", "\n", "\t", "日本", "🙂", "▁", "x1", "Tokens", "'s", "qzx", "<0x41>", "<s>", "\x00"]
    texts = [None, "", " ", "▁", "\n\n", *["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 60))) for _ in range(40)], "abc" * 400, "ab " * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
    rows = pieces.decode(pieces.encode(docs, vocab), vocab).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert r.decoded == t and r.text == t
        if not t:
            assert r.ids == (None if t is None else [])
            continue
        want, _, by_byte, low = best(t, vocab)
        spelt, got, raw = set(by_byte.values()), 0.0, b""
        for k in [*r.ids, None]:
            if k in spelt:
                raw += bytes([int(vocab[k][0][3:5], 16)])
                continue
            got += low * len(raw.decode())
            raw = b""
            got += vocab[k][1] if k is not None else 0
        assert got == pytest.approx(want)


def test_trie_holds_exactly_its_strings():
    rnd = random.Random(7)
    strings = [list(s) for s in {tuple(rnd.randint(1, 300) for _ in range(rnd.randint(1, 5))) for _ in range(3000)}]
    trie = pieces.Trie(strings)
    known = {tuple(s): k for k, s in enumerate(strings)}
    for s in strings + [[rnd.randint(0, 300) for _ in range(3)] for _ in range(500)]:
        node = np.zeros(1, dtype=np.int64)
        for c in s:
            node = trie.step(node, np.array([c]))
        assert (int(trie.value[node[0]]) if node[0] >= 0 else -1) == known.get(tuple(s), -1)


def test_a_vocabulary_with_pieces_over_spaces_is_not_cut(spark):
    vocab = [(f"<0x{b:02X}>", -20.0) for b in range(256)] + [("▁a", -3.0), ("▁b", -3.0), ("▁a▁b", -1.0), ("c", -2.0)]
    docs = spark.createDataFrame([("a bc",), ("b a",)], "text string")
    assert [r.ids for r in pieces.encode(docs, vocab).collect()] == [[258, 259], [257, 256]]
    assert [r.decoded for r in pieces.decode(pieces.encode(docs, vocab), vocab).collect()] == ["a bc", "b a"]


def test_query_form(spark):
    docs = spark.createDataFrame([(1, None), (None, "ä b"), (2, ""), (2, "")], "doc_id long, text string")
    assert all(r.same for r in pieces.round_trip(docs, PATH).collect())
    assert pieces.round_trip(docs.limit(0), PATH).count() == 0


def test_a_round_trip_takes_one_python_worker_a_task(spark):
    plan = pieces.round_trip(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_long_batches_are_held_in_slices(vocab, monkeypatch):
    """Chunks are kept as numbers, a slice at a time; cut texts give the ids of whole ones."""
    shared = SimpleNamespace(value=(vocab, pieces.Encoder(vocab)))
    rnd = random.Random(8)
    words = ["the", "of", "naïve", "日本", "▁", "\n", " ", "tokens"]
    texts = [" ".join(rnd.choices(words, k=60_000)), None, "", *[" ".join(rnd.choices(words, k=50)) for _ in range(20)], " ".join(rnd.choices(words, k=60_000))]
    batch = pa.record_batch({"text": texts, "n": list(range(len(texts)))})
    run = pieces._encoding(shared, "text", "ids")
    whole = pa.Table.from_batches(run(iter([batch])))
    monkeypatch.setattr(pieces, "_SLICE", 1000)
    monkeypatch.setattr(pieces, "CACHED_CHUNKS", 5)
    parts = list(run(iter([batch])))
    assert pa.Table.from_batches(parts).equals(whole) and len(parts) == 2
    assert pieces._texts(pieces._spellings(vocab), whole["ids"].combine_chunks()) == texts
    held = ["".join(c) for c in shared.value[1].split(pieces.marked(texts[0]))]
    assert "".join(held) == pieces.marked(texts[0]) and max(map(len, held)) < 1100
