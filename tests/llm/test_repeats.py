import hashlib
import random
from collections import Counter

import pytest

from barloom.llm import repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        n_spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), n_spans, hashlib.sha256(bytes(x for x, y in zip(r, gone) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 37])
def test_equals_brute_force(spark, length):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 700))) for _ in range(10)]
    texts = [None, "", "a" * 500, "ab" * 300, "x" * 199, "y" * 200]
    for _ in range(40):
        texts.append("".join(rnd.choice(base)[rnd.randint(0, 80):rnd.randint(100, 700)] + rnd.choice(["", "", "z", "qq "]) for _ in range(rnd.randint(1, 6))))
    texts += texts[10:14]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.digests(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_repeated_rows_null_ids_and_other_columns(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    rows = [(1, text, "a", 5), (1, text, "a", 5), (None, "kurz", None, 6), (7, None, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n int")
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=str) == sorted([(1, "", "a", 5), (1, "", "a", 5), (None, "kurz", None, 6), (7, None, "b", 7)], key=str)
    assert repeats.digests(docs.limit(0)).count() == 0


def test_whole_characters_stay_whole(spark):
    body = "".join(chr(0x4E00 + i * 37 % 500) for i in range(150))
    docs = spark.createDataFrame([(1, "ä" + body + "x"), (2, "ö" + body + "y")], "doc_id long, text string")
    # the second bytes of ä and ö differ, their first bytes are no part of a repeated string
    assert {r.doc_id: r.text for r in repeats.remove_repeats(docs).collect()} == {1: "äx", 2: "öy"}


def test_runs_are_cut_at_chunks(spark, monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh") for _ in range(5000))
    data, offsets = repeats.np.frombuffer((text + text).encode(), dtype=repeats.np.uint8), repeats.np.array([0, 5000, 10000])
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    windows = Counter()
    for r in repeats._runs_of(data, offsets, 200, repeats._rollers(200)):
        for row, start, n in zip(r["row"], r["start"], r["n"]):
            windows.update((row, start + i) for i in range(n))
    assert windows == Counter((row, i) for row in (0, 1) for i in range(4801))
