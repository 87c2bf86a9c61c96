import random
import re
import time

from pyspark.sql import functions as F

from barloom.llm import lines

SCHEMA = "doc_id long, text string, h string, line int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def test_templates_with_fields_are_dropped(spark):
    texts = [f"first text {chr(97 + i)}\nPage {i} of 12 printed by hand\nclosing words {chr(97 + i)}" for i in range(12)]
    texts += [f"other start {chr(97 + i)}\nGreetings from all of the people at {w} today ok\nthe end {i}" for i, w in enumerate(["rome", "oslo", "bonn", "lima", "kyiv", "bern", "riga", "york", "nice", "graz", "linz"])]
    texts += [None, "", "\n \n", "Only once in this whole table\n\nfirst text a"]
    docs = frame(spark, texts)
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(docs).collect()}
    assert got[0] == "first text a\nclosing words a"
    assert got[12] == "other start a"
    assert [got[i] for i in range(23, 27)] == texts[23:]
    assert lines.drop_boilerplate(docs).columns == docs.columns


def test_copies_of_a_document_are_no_boilerplate(spark):
    texts = ["a line of text\nanother line of text\nand the last line"] * 30 + ["Short\nfoo"] * 30
    docs = frame(spark, texts)
    assert sorted(r.text for r in lines.drop_boilerplate(docs).collect()) == sorted(texts)


def test_unlike_lines_with_equal_beginnings_stay(spark):
    texts = [f"x{chr(97 + i)} y z\nthe cat is {' '.join(chr(97 + (i * 7 + k) % 26) * 3 for k in range(9))}" for i in range(26)]
    docs = frame(spark, texts)
    assert sorted(r.text for r in lines.drop_boilerplate(docs).collect()) == sorted(texts)


def test_repeated_rows_and_empty_table(spark):
    body = [f"start {chr(97 + i)} here\nAll rights reserved worldwide\nend {chr(97 + i)} here" for i in range(11)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(body)] + [(0, body[0], "x", 1), (None, body[1], "x", 1)], SCHEMA)
    got = [(r.doc_id, r.n_lines, r.n_dropped) for r in lines.digests(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, 3, 1) for i in range(11)] + [(0, 3, 1), (None, 3, 1)], key=str)
    assert lines.digests(docs.limit(0)).count() == 0


def test_footer_of_several_lines_goes_and_the_list_of_one_document_stays(spark):
    rest = random.Random(2)
    footer = ["We use cookies to make this site better", "Read more", "Terms and conditions apply", "Contact us today"]
    body = [" ".join("".join(rest.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(30)]
    numbers = "\n".join(f"{i}. buy item {i}" for i in range(20)) + "\n" + "\n".join(f"Dear {w} come to the party with us tonight please" for w in ["rome", "oslo", "bonn", "lima", "kyiv", "bern", "riga", "york", "nice", "graz", "linz", "faro"])
    docs = frame(spark, ["\n".join([b, *footer]) for b in body] + [numbers])
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(docs).collect()}
    assert got == {**dict(enumerate(body)), 30: numbers}


def test_a_leaf_holds_several_templates(spark):
    places = ["rome", "oslo", "bonn", "lima", "kyiv", "bern", "riga", "york", "nice", "graz", "linz"]
    texts = [f"own words {chr(97 + i)} {w * 3} and more of them\nThis page was made in {w} by us with care\nThis page was sold at {w} on one sunny day" for i, w in enumerate(places)]
    got = sorted(r.text for r in lines.drop_boilerplate(frame(spark, texts)).collect())
    assert got == sorted(t.split("\n")[0] for t in texts)


def test_near_copies_are_left_whole(spark):
    rest = random.Random(3)
    base = [" ".join("".join(rest.choices("abcdefghij", k=5)) for _ in range(12)) for _ in range(12)]
    texts = []
    for i in range(25):
        own = list(base)
        own[i % 12] += f" and{chr(97 + i)}"
        texts.append("\n".join(own))
    assert sorted(r.text for r in lines.drop_boilerplate(frame(spark, texts)).collect()) == sorted(texts)


def test_long_documents_and_tokens(spark):
    rows = "\n".join(f"row number {i} of very many rows here" if i % 2 else f"single {chr(97 + i % 26)} {'y' * (i % 37)} {i // 37}" for i in range(20000))
    start = time.time()
    texts = [rows, "a" * 1_000_000, "漢" * 300_000 + "1", "x" * 500_000 + " " * 500_000]
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(frame(spark, texts)).collect()}
    assert got == dict(enumerate(texts)) and time.time() - start < 30


def test_clashing_columns_are_kept(spark):
    names = ["t", "i", "h", "leaf", "n", "c", "row", "gone", "left", "line", "template", "_key", "_drop", "l", "k", "pos", "token"]
    texts = [f"own {chr(97 + i)} words\nAll rights reserved worldwide" for i in range(12)]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = lines.drop_boilerplate(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(i, t.split("\n")[0], *range(len(names))) for i, t in enumerate(texts)]


def test_masking_takes_the_same_fields_in_less_time(spark):
    rest = random.Random(4)
    spelt = "(?<![^ \\t-\\r])[^ \\t-\\r0-9]*+[0-9][^ \\t-\\r]*+"
    odd = ["".join(rest.choices(" \t\n\x0b\x0c\r\x1c\x85\u00a0\u2003\u0663a9é漢🙂-", k=40)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    for r in df.select("text", lines._masked(F.col("text")).alias("m")).collect():
        assert r.m == re.sub("[ \t\x0b-\r]+", " ", re.sub("[^ \t-\r]*[0-9][^ \t-\r]*", "<*>", r.text))
    words = " ".join("".join(rest.choices("abcdefghij", k=rest.randint(1, 12))) for _ in range(20_000))
    long = spark.createDataFrame([(words + str(i % 2),) for i in range(40)], "text string").repartition(1).localCheckpoint()

    def seconds(c):
        took = []
        for _ in range(3):
            start = time.time()
            long.agg(F.sum(F.length(c))).collect()
            took.append(time.time() - start)
        return min(took)

    plain = F.regexp_replace(F.regexp_replace("text", spelt, "<*>"), "[ \\t\\x0B-\\r]++", " ")
    assert seconds(lines._masked(F.col("text"))) < 0.8 * seconds(plain)
