import os
import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


def corpus():
    rnd = random.Random(8)

    def prose(n, tag):
        return "\n".join(" ".join(f"{tag}{rnd.randint(0, 9999)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)) for _ in range(n))

    rows = []
    for i in range(30):
        text = prose(8, "w")
        rows.append((i, text + "\nThis line stands in all of them\n" + prose(2, "x"), "en", "a"))
    rows.append((30, rows[3][1], "en", "a"))  # a copy
    rows.append((31, rows[4][1].replace(rows[4][1].split()[40], "other"), "en", "b"))  # a near copy
    shared = prose(5, "s")
    rows += [(32, prose(30, "p") + "\n" + shared, "de", "b"), (33, shared + "\n" + prose(30, "q"), "de", "b")]
    rows += [(34, "too short", "en", "a"), (35, None, None, None), (36, "again and " * 100, "en", "a"), (37, "", "en", "a")]
    return [(*r, len(r[1] or ""), "k") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_on_a_small_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append({r.doc_id: r for r in docs.collect()})
    good, lined, near, passages, _ = seen
    assert set(good) == set(range(34))
    assert set(lined) == set(good) and not any("stands in all" in r.text for r in lined.values())
    assert len(lined[5].text.split("\n")) == 10
    assert set(near) == set(good) - {30, 31}
    assert set(passages) == set(near) and 0 < len(passages[32].text) < len(near[32].text)
    assert passages[6].text == near[6].text
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(passages)
    assert all(sum(r.length for r in packed if r.doc_id == d) == next(r.doc_tokens for r in packed if r.doc_id == d) for d in (0, 32))


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() >= 32
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert os.listdir(tmp_path) == ["documents.parquet"]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "packing"], ids=lambda s: s[0])
def test_no_working_name_meets_a_column(spark, stage):
    names = ["row", "t", "h", "i", "gone", "leaf", "line", "left", "key", "first", "last", "_key", "_first", "_last", "_drop", "_w", "_c", "_lines", "_m", "_l", "_s", "_kept", "node",
             "kept", "component", "component_id", "n_shingles", "s1", "s2", "bands", "bits", "n", "bucket", "measure", "v", "q1", "q3", "high_symbol_rate", "low_word_length"]
    rows = [(*r[:4], *(f"{n}{r[0]}" for n in names)) for r in corpus()]
    plain = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, plain + "".join(f", `{n}` string" for n in names))
    out, alone = stage[1](spark, docs, ""), stage[1](spark, docs.select("doc_id", "text", "lang", "source"), "")
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in alone.collect())
