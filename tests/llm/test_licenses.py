from barloom.llm import licenses

SCHEMA = "doc_id long, text string, label string, score int"


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_places_and_suppression(spark):
    got = scan(spark, [
        None, "", "nothing here at all",
        "Licensed under CC BY-NC 4.0.",
        "x\nThis work is licensed under the GNU General Public License, version 3.\nAll rights reserved. ALL RIGHTS RESERVED",
        "Released under the MIT License. Also the Apache License, Version 2.0",
        "general public license general public", "cc0 und CCé by", "all rights", "cc by cc by"])
    rows = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for _, r in sorted(got.items())]
    assert rows[0] == rows[1] == (0, 0, None, None, "", "", 0.0)
    assert rows[2] == (4, 0, None, None, "", "", 0.0)
    assert rows[3] == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc,license-mention", 1.0)
    assert rows[4] == (19, 3, 8, 16, "gpl,reserved", "gpl,gpl-3.0,license-mention,reserved", 1.0)
    assert rows[5] == (12, 0, None, None, "", "apache-2.0,license-mention,mit", 1.0)
    assert rows[6] == (5, 1, 0, 0, "gpl", "gpl", 0.8)
    assert rows[7] == (4, 0, None, None, "", "cc0", 0.9)
    assert rows[8] == (2, 0, None, None, "", "", 0.0)
    assert rows[9] == (4, 2, 0, 2, "cc-by", "cc-by", 0.8)


def test_a_hint_inside_a_named_license_is_dropped_and_long_texts_work(spark):
    got = scan(spark, ["spdx license identifier licensed", "mit license " * 30000, "MIT license", "MIT license"])
    assert got[0].labels == "spdx-tag"
    assert (got[1].n_words, got[1].labels) == (60000, "mit")
    assert got[2][1:] == got[3][1:]


def test_prefilter_lets_every_start_through(spark):
    import re
    for phrase in licenses.PHRASES:
        assert re.search(licenses.PREFILTER, phrase)
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scan(empty).count() == 0


def example(pattern):
    """A text that the pattern matches: first branches, optional parts present, repetitions as often as they may."""
    import re
    p = pattern.replace("[^ ]+", "x")
    p = re.sub(r"\[(\d)-\d\]\+?", r"\1", p)
    p = re.sub(r"\[([a-z0-9])[^\]]*\]", r"\1", p)
    while "(" in p:
        p = re.sub(r"\(([^()|]*)[^()]*\)(\{\d,(\d)\}|[?*])?", lambda m: m[1] * int(m[3] or 1), p)
    return p.replace("?", "")


def test_every_rule_fires_and_passes_the_prefilter(spark):
    import re
    from pyspark.sql import functions as F
    from barloom.llm.text import bind
    texts = [(k, example(r.pattern)) for k, r in enumerate(licenses.RULES)]
    for k, t in texts:
        assert re.search(licenses.PREFILTER, t), t
        assert t.split(" ")[0] == licenses.RULES[k].start
    found = spark.createDataFrame(texts, "k int, text string").select("k", "text", bind(F.split("text", " "), licenses._detections).alias("d"))
    assert [(r.k, r.text) for r in found.collect() if r.k not in {d["rule"] for d in r.d}] == []


def test_the_mit_grant_without_the_name(spark):
    got = scan(spark, ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software"])
    assert (got[0].labels, got[0].score) == ("mit", 1.0)
