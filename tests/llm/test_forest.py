import numpy as np

from barloom.llm import forest


def brute(rows, every, k):
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    out = {}
    for q, x in good.items():
        if q % every == 0:
            near = sorted((-float((x * y).sum()), i) for i, y in good.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_small_tables_are_searched_whole(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rnd.normal(size=8).astype(np.float32)]) for i in range(60)]
    rows += [(61, None), (62, [0.0] * 8), (63, [1.0, None] + [1.0] * 6), (64, [float("nan")] * 8), (65, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(66, [1.0, 2.0]), (80, [2.0, 1.0]), (67, rows[5][1]), (68, rows[5][1]), (100, []), (-20, rows[7][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, strings string")
    got = {}
    for r in forest.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20, 20)
    assert {q: [(i + 1, v, s) for i, (v, s) in enumerate(x)] for q, x in want.items() if x} == got
    assert forest.neighbours(df.limit(0)).count() == 0


def test_recall_on_vectors_without_structure(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(12000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in forest.neighbours(df, every=100).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    y = x.astype(float)
    hits = 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -9
        hits += len({*np.argsort(-s)[:20]} & {*found})
        assert all(abs(v - s[i]) < 1e-12 for i, v in found.items())
    assert len(got) == 120 and hits / (20 * len(got)) > 0.93


def test_the_ascent_stops_at_deep_prefixes_in_clusters():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(40, 32))
    x = np.repeat(centres, 50, axis=0) + rnd.normal(size=(2000, 32)) * 0.05
    rot = forest._rotations(32, 0)
    s = forest.strings(x, rot)
    found = forest.search_shard(np.arange(2000), x, s, np.arange(0, 2000, 50), x[::50], s[::50], 20, 400)
    assert all(q // 50 == v // 50 for q, v, _ in found) and len(found) == 800
