import re
from collections import Counter

import pytest

from barloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\n\nx\nx \n", "é # ü|ö <b>", "a b c d a b c d e f",
         " ".join(f"w{i % 40}" for i in range(200)), " ".join(f"w{i}" for i in range(120)), "Wort\x0bzwei\x0cdrei vier\x1cfünf sechs",
         " ".join("abcabdabe"[i % 9] for i in range(5000)), "###\n" * 70]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.verdicts(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_buckets_hold_their_values(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 65, 1000, 12345, 2**40 + 17]
    rows = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality.bucket(quality.F.col("v"))).withColumn("t", quality.bucket_top(quality.F.col("b"))).collect()
    for r in rows:
        assert r.v <= r.t <= r.v * 17 / 16 + 1
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_sketch_quantiles_and_merge(spark):
    a = spark.createDataFrame([("x", v) for v in range(100)], "g string, v long")
    b = spark.createDataFrame([("x", v) for v in range(100, 1001)], "g string, v long")
    merged = quality.sketch(a, ["g"], "v").union(quality.sketch(b, ["g"], "v")).groupBy("g", "bucket").agg(quality.F.sum("n").alias("n"))
    row = quality.quantiles(merged, ["g"], {"q1": 0.25, "q3": 0.75}).first()
    assert row.q1 == pytest.approx(250, rel=1 / 16) and row.q3 == pytest.approx(750, rel=1 / 16)


def test_group_sets_its_own_fence(spark):
    plain = " ".join(f"wort{i}" for i in range(100))
    noisy = plain + " " + "# " * 60
    rows = [(i, plain, "en", "a", 1) for i in range(20)] + [(50, noisy, "en", "a", 1)]
    rows += [(100 + i, noisy, "en", "b", 1) for i in range(20)] + [(200, plain, None, None, 1)]
    kept = {r.doc_id for r in quality.filter_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {*range(20), *range(100, 120), 200}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", bucket int, measure string")
    assert quality.verdicts(empty).count() == 0
    assert quality.filter_documents(empty).columns == empty.columns
    text = " ".join(f"w{i}" for i in range(60))
    twice = spark.createDataFrame([(1, text, "en", "a", 1, 7, "m")] * 2, SCHEMA + ", bucket int, measure string")
    assert [tuple(r) for r in quality.filter_documents(twice).collect()] == [(1, text, "en", "a", 1, 7, "m")] * 2
