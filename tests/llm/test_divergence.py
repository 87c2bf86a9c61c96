import random
import re
from collections import Counter

import pyarrow as pa

from barloom.llm import divergence

R = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, term string, p int, gid string"


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        inside = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in inside.items() if n >= least}
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))

        for s, c in counts.items():
            pairs = [(x, sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept)) for x, o in counts.items() if x != s]
            terms = [(t, (share(c, t) - share(whole, t)) ** 2 // share(whole, t)) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                best = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, "g") for i, r in enumerate(rows)], SCHEMA).repartition(3)


VOCAB = ["the", "Cat", "über", "漢字", "a1b", "x_y", "ZETA", "é", "dog.", "end\n", "\U0001f600", "￿"] + [f"w{chr(97 + i)}{chr(97 + i // 3)}" for i in range(26)]


def text():
    return " ".join(R.choices(VOCAB, weights=[1 / (i + 1) for i in range(len(VOCAB))], k=R.randint(0, 30)))


def test_audit_equals_brute_force(spark):
    rows = [(text(), R.choice(["en", "de", None]), R.choice(["a", "b", "c", "d", None])) for _ in range(150)]
    rows += [(text(), "en", "hot") for _ in range(80)] + [(None, "en", "mute"), ("", "fr", "x"), ("1 2 3", "fr", "y"), ("rare words", "it", "only")]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == brute(rows)


def test_limits_ties_repeats_and_empty_table(spark):
    rows = [("b a c d", "en", "s")] * 4 + [("b a", "en", "t")] * 5 + [("c", "en", "t")]
    docs = frame(spark, rows)
    assert sorted(map(tuple, divergence.audit(docs, top=1).collect())) == brute(rows, top=1)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_small_batches_and_pieces_give_the_same(spark, monkeypatch):
    rows = [(text() * 3, "en", f"s{i % 40}") for i in range(160)]
    monkeypatch.setattr(divergence, "_HELD", 7)
    monkeypatch.setattr(divergence, "_CELLS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_many_groups_in_chunks(monkeypatch):
    lists = [[{"gid": g, "p": R.randint(1, 10**9), "z": 1 + 7 * g} for g in R.sample(range(30), R.randint(0, 30))] for _ in range(40)]
    kind = pa.list_(pa.struct([("gid", pa.int64()), ("p", pa.int64()), ("z", pa.int64())]))
    want = Counter()
    for row in lists:
        for a in row:
            for b in row:
                gap = lambda x, y: (x - y) ** 2 // y
                want[a["gid"], b["gid"]] += gap(a["p"], b["p"]) - gap(a["p"], b["z"]) - gap(a["z"], b["p"]) + gap(a["z"], b["z"])
    for cells in (7, 100, 1 << 20):
        monkeypatch.setattr(divergence, "_CELLS", cells)
        out = next(divergence._shared(iter([pa.RecordBatch.from_arrays([pa.array(lists, kind)], names=["l"])])))
        got = {(a, b): s for a, b, s in zip(*(c.to_pylist() for c in out.columns))}
        # the diagonal is of no use, rows with one group are left out
        assert {k: v for k, v in got.items() if k[0] != k[1]} == {k: v for k, v in want.items() if k[0] != k[1]}
