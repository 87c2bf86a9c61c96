import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    parts = ["the", "Straße", "naïve", "it's", "x1y22", "—", "!!!", "日本語", "́a", "ﬁn", "<|endoftext|>", "İo", "a\x1cb", " ", "\n\n", "\t", "ΑΣ", "é"]
    out = [None, "", " ", *["".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "\n"]) for _ in range(rnd.randint(1, 900))) for _ in range(60)]]
    return out + ["wort " * 3000, "wort " * 3000]


def test_pieces_cover_the_ids_and_sequences_have_no_gaps(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want = [(at, min(2048, len(ids) - at), zlib.crc32(np.array(ids[at:at + 2048], dtype="<u4").tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i]) == sorted(want * (2 if i == 5 else 1))
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(packing, "_SLICE", 50)
    words = packing.WordIds(PATH)
    text = "Hallo Welt  it's\n\nfine " * 40 + "x" * 200
    assert b"".join(words.encode([t])[0] for t in packing._cuts(text)) == words.encode([text])[0]


def test_plan_uses_every_piece_with_little_padding():
    rnd = np.random.default_rng(0)
    lengths = np.minimum(2047, rnd.gamma(1.2, 500, 50000).astype(int) + 1)
    histogram = np.bincount(-(-lengths // packing.UNIT), minlength=257)
    patterns = packing.plan(histogram)
    used = np.zeros(257, dtype=int)
    for sequence, times in patterns:
        assert sum(sequence) <= 256 and times > 0
        used += times * np.bincount(sequence, minlength=257)
    assert (used == histogram).all()
    assert lengths.sum() / (2048 * sum(t for _, t in patterns)) > 0.985


def test_nnls_matches_a_known_solution():
    rnd = np.random.default_rng(1)
    a = rnd.random((30, 12))
    x = np.where(rnd.random(12) < 0.5, 0, rnd.random(12))
    assert packing.nnls(a, a @ x, 100) == pytest.approx(x, abs=1e-6)
    b = rnd.normal(size=30)
    z = packing.nnls(a, b, 100)
    g = a.T @ (b - a @ z)
    assert (z >= 0).all() and (g <= 1e-6).all() and abs(g @ z) < 1e-6


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert packing.plan(np.zeros(257, dtype=int)) == []
