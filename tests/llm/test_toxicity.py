import random
import zlib

import numpy as np

from barloom.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string, toxic int, score double", "doc_id long, quality int, toxic int"


def corpus():
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(700):
        words = ["".join(rnd.choice(["an", "be", "co", "du", "el", "fi"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 80))]
        toxic = int(rnd.random() < 0.25)
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "Moron!", "schurk" + rnd.choice("abcdefgh") + rnd.choice("xyz")]))
        docs.append((i, " ".join(words), "en", 9, 9.0))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i, r in got.items() if r.held_out] == held
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    frame = spark.createDataFrame(docs, DOCS)
    a, b = (toxicity.score(frame, spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_empty_inputs(spark):
    docs = spark.createDataFrame([(1, None, "en", 1, 1.0), (2, "", "en", 1, 1.0), (None, "idiot", "en", 1, 1.0), (2, "", "en", 1, 1.0)], DOCS)
    none = spark.createDataFrame([(None, 1, 1), (1, 1, None)], LABELS)
    assert [(r.predicted, round(r.score, 6)) for r in toxicity.score(docs, none).collect()] == [(0, 0.0)] * 4
    assert toxicity.score(docs.limit(0), none).count() == 0
    one_class = spark.createDataFrame([(1, 1, 1), (3, 1, 1)], LABELS)
    assert {r.predicted for r in toxicity.score(docs, one_class).collect()} == {1}


def test_label_model_finds_accuracies_and_correlated_voters():
    rnd = np.random.default_rng(3)
    truth = (rnd.random(6000) < 0.3).astype(int)
    rates = [(0.7, 0.05), (0.5, 0.02), (0.6, 0.3)]
    votes = np.column_stack([rnd.random(6000) < np.where(truth, *r) for r in rates])
    votes = np.column_stack([votes, votes[:, 0]]).astype(int)  # the last voter copies the first
    labels = np.where(rnd.random(6000) < 0.1, 1 - truth, truth)
    post, theta, share = toxicity.label_model(votes, labels)
    assert np.allclose(theta[1, :3], [0.7, 0.5, 0.6], atol=0.08) and np.allclose(theta[0, :3], [0.05, 0.02, 0.3], atol=0.05)
    assert share[0] == share[3] == 0.5 and share[1] == 1
    assert ((post > 0.5) == truth).mean() > (labels == truth).mean()


def test_linear_fit():
    rnd = np.random.default_rng(5)
    x = (rnd.random((4000, 3)) < 0.5).astype(float)
    p = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] - 0.5)))
    w, b = toxicity.fit_linear(x, p, l2=1e-9)
    assert np.allclose([*w, b], [2, -1, 0, -0.5], atol=1e-3)
