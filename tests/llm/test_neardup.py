import random
import re

import numpy as np
import pytest

from barloom.llm import neardup
from barloom.llm.graph import components
from barloom.llm.rolling import mix

SCHEMA = "doc_id long, text string, component_id long, n int"


def brute(docs, size, percent):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = {d: grams(t) for d, t in docs}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def family(rnd, n, words, edits):
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(words)] = f"x{rnd.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, size, percent):
    rnd = random.Random(7)
    texts = [None, "", " \n", "a", "A", "a b", "a  B", "b a", "É é"]
    for n, words, edits in [(25, 100, 8), (12, 30, 1), (10, 400, 12), (2, 2000, 3)]:
        texts += family(rnd, n, words, edits)
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain[k * 4:k * 4 + 120]))
    docs = list(enumerate(texts, 100))
    rnd.shuffle(docs)
    df = spark.createDataFrame([(d, t, 1, 1) for d, t in docs], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.cluster(df, size, percent).collect()}
    assert got == brute(docs, size, percent)


def hot_bucket(n, edits, seed=3):
    """Copies of one text with so many edits that most are below the similarity, yet share bands."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in rnd.sample(range(120), edits):
            t[at] = f"x{rnd.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("edits", [2, 4])
def test_unlike_sets_of_a_bucket_meet_in_blocks(spark, edits):
    docs = list(enumerate(hot_bucket(150, edits)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, 3, 85)
    sk = neardup.find_sketches(df, 3, neardup.band_rows(85)).withColumnRenamed("doc_id", "node")
    nothing = spark.createDataFrame([], "a long, b long")
    for block in (500, neardup.BLOCK):
        got = {r.node: r.component for r in neardup.links(df, sk, nothing, 3, 85, block).collect()}
        assert {d: got.get(d, d) for d, _ in docs} == {d: c for d, (_, c, _) in want.items()}


def test_no_task_holds_a_hot_bucket(spark):
    sets = spark.range(900).selectExpr("id as node", "array(id, id + 1) as shingles")
    rest = sets.selectExpr("7L as bucket", "node", "2L as n", "node as component")
    assert neardup._across(rest, sets, 85, 100).isEmpty()
    groups = neardup.dealt(rest, sets, 100).groupBy("low", "high").count().collect()
    assert len(groups) == 18 * 19 // 2  # 1,800 shingles in 18 blocks
    assert max(r["count"] for r in groups) < 200


def test_joins_is_a_spanning_forest():
    rnd = np.random.default_rng(5)
    sets = []
    for _ in range(6):
        base = rnd.choice(10**6, 60, replace=False)
        for _ in range(8):
            own = base.copy()
            own[rnd.integers(0, 60, 3)] = rnd.integers(10**6, 10**9, 3)
            sets.append(np.unique(own))
    cut = np.r_[0, np.cumsum([len(x) for x in sets])]
    for block in (np.zeros(48, dtype=np.int64), np.arange(48) % 2):
        comp = np.arange(48)
        found = neardup.joins(np.concatenate(sets), cut, comp, block, 80)
        want = {i: i for i in range(48)}
        for i in range(48):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (block.max() == 0 or block[i] != block[j]) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    low, high = sorted((want[i], want[j]))
                    want = {d: low if c == high else c for d, c in want.items()}
        got = {i: i for i in range(48)}
        for a, b in found:
            low, high = sorted((got[a], got[b]))
            assert low != high
            got = {d: low if c == high else c for d, c in got.items()}
        assert got == want


def test_sketch_fills_and_estimates():
    rnd = np.random.default_rng(1)
    a = mix(rnd.integers(0, 1 << 60, 600, dtype=np.uint64))
    pair = neardup.sketch([a[:500], a[50:550], a[:1], a[:2]], 700)
    assert (pair != neardup._EMPTY).all()
    assert abs((pair[0] == pair[1]).mean() - 450 / 550) < 0.08
    assert (neardup.sketch([a[:1]], 700) == pair[2]).all()  # alone as in company


def test_bits_leave_no_similar_pair_out():
    rnd = np.random.default_rng(2)
    a = mix(rnd.integers(0, 1 << 60, 4000, dtype=np.uint64))
    for n in (6, 20, 300):
        sets = [x for k in range(12) for x in (a[k * 300:k * 300 + n], a[k * 300 + int(n * 0.05):k * 300 + n + int(n * 0.05)])]
        b = neardup.bits(neardup.sketch(sets, 700)).view(np.uint64)

        def differ(i, j):
            x = b[i] ^ b[j]
            return int(np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())

        assert max(differ(i, i + 1) for i in range(0, 24, 2)) <= neardup.most_differences(700, 85) < 130
        assert differ(0, 2) > 400


def test_a_node_may_appear_with_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(4, one, 0, 0), (4, two, 0, 0), (2, one, 0, 0), (3, two + " c", 0, 0), (9, "z", 0, 0)], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in neardup.cluster(df).collect()} == {(4, 2), (2, 2), (3, 2), (9, 9)}


def test_components_of_a_path_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 9)] + [(300, 250), (300, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star + path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(9)}, 250: 250, 260: 250, 300: 250}


def test_keep_one_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, 1, 1), (3, text, 1, 1), (2, text + " x", 9, 9), (None, text, 1, 1), (5, "", 0, 0), (6, None, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = neardup.keep_one_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, 2, 5, 6]
    assert neardup.cluster(df.limit(0)).count() == 0
