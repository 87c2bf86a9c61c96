import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from barloom.llm import importance

R = random.Random(3)
SCHEMA = "doc_id long, text string, score string, part int, `row` int"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in runs(t, longest))
    g = Counter(bucket(f) for t in target for f in runs(t, longest))
    s_all, t_all = sum(s.values()), sum(g.values())
    out = []
    for i, text in docs:
        fs = runs(text, longest)
        weight = sum(math.floor(1000 * math.log((g[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def text():
    return " ".join(R.choice(["the", "Cat", "sat", "DOG", "über", "naïve", "x1", "a-b", "end.", "#", "zeta\n", "漢字", "sun"]) for _ in range(R.randint(0, 60)))


def frames(spark, docs, target):
    return (spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], SCHEMA).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"percent": 50, "least": 0}, {"longest": 3, "buckets": 101, "percent": 33, "seed": 7}])
def test_draw_equals_brute_force(spark, options):
    docs = [(i, text()) for i in range(300)] + [(500, None), (501, ""), (502, " \n#")]
    target = ["the cat sat on the sun " * 3, None, "Über 漢字"]
    a, b = frames(spark, docs, target)
    named = {("min_words" if k == "least" else k): v for k, v in options.items()}
    assert result(importance.resample(a, b, **named)) == brute(docs, target, **options)


def test_ties_repeated_rows_and_null_ids(spark):
    same = "one two three four five " * 5
    for docs in ([(7, same)] * 200, [(None, same)] * 30 + [(7, same)] * 30, [(i % 9, same) for i in range(90)]):
        a, b = frames(spark, docs, ["one two"])
        assert result(importance.resample(a, b, percent=37)) == brute(docs, ["one two"], percent=37)


def test_empty_tables_and_nothing_eligible(spark):
    a, b = frames(spark, [(1, "few words")], ["x"])
    assert importance.resample(a.limit(0), b).count() == 0
    assert result(importance.resample(a, b)) == brute([(1, "few words")], ["x"])
    assert result(importance.resample(a, b.limit(0))) == brute([(1, "few words")], [])


def test_cutoff_by_counts(spark):
    values = [R.choice([-5, 0, 3, 3, 3, 1 << 62, -(1 << 62), R.randint(-1000, 1000)]) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (2, 120, 200):
        at = sorted(values)[n - 1]
        assert importance.cutoff(rows, importance.F.col("v"), n) == (at, sum(v < at for v in values), sum(v <= at for v in values))


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(importance.bags, "_PIECE", 50)
    long = (text() + " ") * 40
    for k in (1, 2, 3):
        got = [f.decode() for some in importance.features(long.encode(), k) for f in some]
        assert Counter(got) == Counter(runs(long, k))
