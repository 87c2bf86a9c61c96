"""Toxicity by weak supervision (operator 3).

Voters are words and word beginnings (a lexicon mined from labelled documents) and a few fixed patterns. A generative label
model, fitted by expectation maximisation, has a hidden true class; every voter, and the given label as one more,
fires with its own probability in each class. Voters that fire together more than that explains are correlated; each
counts by one over the number of voters that it runs with. A linear classifier learns the posterior
labels from the votes, and it alone scores documents.

Mining counts a word by its different surroundings (the word before), so near copies of one document count once.
Fitting takes a bounded sample of labelled training rows: ``POSITIVES`` and ``NEGATIVES`` with the smallest hash of their doc_id;
the class prior comes from all training labels. The model (at most ``VOTERS`` voters) is all that the driver holds.
Scoring is one projection over whole texts with built-in functions, without a shuffle.

Defined cases: null and empty texts get the score of a text without votes; labels of unknown documents, null labels and null ids are ignored;
documents are scored row by row, so repeated rows are scored alike; without training labels, or with those of one class only, every score is that class's
rate (0 without labels); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

POSITIVES, NEGATIVES = 4000, 6000
VOTERS = 512
PREFIXES = (4, 5, 6)
SUPPORT = 8  # surroundings in toxic documents
ODDS = 2.0  # least log odds of a voter
TOGETHER = 0.8  # share of joint firing from which two voters count as correlated
#: Fixed pattern voters.
PATTERNS = {
    "shouting": "(\\b[A-Z]{4,}\\b[^\\p{L}\\n]*){4}",
    "exclaiming": "!{3}",
    "masked": "\\p{L}[*@#$%]{2,}\\p{L}?",
}


@dataclass(frozen=True)
class Model:
    voters: list[str]  # "w:…" a word, "4:…" a beginning of that length, "!…" a pattern
    weights: np.ndarray
    intercept: float

    def of(self, kind: str) -> dict[str, float]:
        return {v[len(kind):]: float(x) for v, x in zip(self.voters, self.weights) if v.startswith(kind)}


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("\\p{L}+"), F.lit(0))


def _features(word: Column) -> Column:
    """A word's features; of beginnings only those shorter than the word."""
    return F.array_compact(F.array(F.concat(F.lit("w:"), word), *[F.when(F.length(word) > k, F.concat(F.lit(f"{k}:"), F.left(word, F.lit(k)))) for k in PREFIXES]))


def _mine(sample: DataFrame) -> list[str]:
    """The features that speak for the toxic class, best first."""
    w = F.arrays_zip(F.col("_w").alias("word"), F.concat(F.array(F.lit("")), F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0)))).alias("before"))
    seen = sample.select("toxic", F.explode(w).alias("x")).select("toxic", F.xxhash64("x.before").alias("ctx"), F.explode(_features(F.col("x.word"))).alias("feature"))
    n = seen.distinct().groupBy("feature").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("p"), F.count(F.when(F.col("toxic") == 0, 1)).alias("q"))
    totals = sample.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    odds = F.log((F.col("p") + 0.5) / (totals[0] + 1)) - F.log((F.col("q") + 0.5) / (totals[1] + 1))
    best = n.where(F.col("p") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= ODDS)
    return [r.feature for r in best.orderBy(F.desc(F.col("odds") * F.log("p")), "feature").limit(VOTERS).collect()]


def _votes(voters: list[str], words: Column, text: Column) -> Column:
    """The voters that fire, as an array of their names."""
    def named(kind: str) -> list[Column]:
        return [F.lit(v) for v in voters if v.startswith(kind)]

    def beginning(k: int):
        return lambda w: F.when(F.length(w) > k, F.concat(F.lit(f"{k}:"), F.left(w, F.lit(k))))

    parts = []
    distinct = F.array_distinct(words)
    if own := named("w:"):
        parts.append(F.array_intersect(F.transform(distinct, lambda w: F.concat(F.lit("w:"), w)), F.array(*own)))
    for k in PREFIXES:
        if own := named(f"{k}:"):
            parts.append(F.array_intersect(F.transform(distinct, beginning(k)), F.array(*own)))
    parts.append(F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit("!" + name)) for name, p in PATTERNS.items()])))
    return F.concat(*parts)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, accuracies [class, voter], share with which each voter counts).

    The last voter is the given label. Classes are anchored by starting from it.
    """
    x = np.column_stack([votes, labels]).astype(float)
    fired = x.sum(axis=0)
    joint = x.T @ x
    jaccard = joint / np.maximum(fired[:, None] + fired[None, :] - joint, 1)
    jaccard[-1, :-1] = jaccard[:-1, -1] = 0  # the label is a judge of its own
    share = 1 / np.maximum((jaccard >= TOGETHER).sum(axis=1), 1)
    post = np.where(labels == 1, 0.95, 0.05)
    for _ in range(rounds):
        theta = np.vstack([((1 - post) @ x + 0.5) / ((1 - post).sum() + 1), (post @ x + 0.5) / (post.sum() + 1)])
        theta = np.clip(theta, 1e-4, 1 - 1e-4)
        theta[0, -1], theta[1, -1] = min(theta[0, -1], 0.2), max(theta[1, -1], 0.8)
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        on, off = np.log(theta[1] / theta[0]), np.log((1 - theta[1]) / (1 - theta[0]))
        z = x @ (share * (on - off)) + (share * off).sum() + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return post, theta, share


def fit_linear(votes: np.ndarray, target: np.ndarray, l2: float = 1e-4, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of soft labels, by Newton's method."""
    x = np.column_stack([votes, np.ones(len(votes))]).astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * len(x))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows that are not held out."""
    train = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0).select("doc_id", "toxic")
    rates = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(rates) < 2:
        return Model([], np.zeros(0), 30.0 if 1 in rates else -30.0)
    order = F.xxhash64("doc_id")
    picked = [train.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(n) for c, n in ((1, POSITIVES), (0, NEGATIVES))]
    ids = picked[0].unionByName(picked[1])  # at most POSITIVES + NEGATIVES rows
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "toxic"])
    sample = materialize(own.select("toxic", "text", _words(F.col("text")).alias("_w")), "labelled")
    voters = _mine(sample) + ["!" + p for p in PATTERNS]
    place = {v: k for k, v in enumerate(voters)}
    rows = sample.select("toxic", _votes(voters, F.col("_w"), F.col("text")).alias("v")).collect()  # as many as the sample has
    given = np.array([r.toxic for r in rows])
    if len(set(given)) < 2:
        return Model([], np.zeros(0), 30.0 if given.any() else -30.0)
    votes = np.zeros((len(rows), len(voters)))
    for k, r in enumerate(rows):
        votes[k, [place[v] for v in r.v]] = 1
    post, _, _ = label_model(votes, given)
    weights, intercept = fit_linear(votes, post)
    share, true = np.clip(given.mean(), 1e-6, 1 - 1e-6), rates[1] / (rates[0] + rates[1])
    return Model(voters, weights, intercept + np.log(true / (1 - true)) - np.log(share / (1 - share)))


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    total = F.lit(float(model.intercept))
    rows = docs.select("doc_id", "text")
    if model.voters:
        rows = rows.withColumn("_v", _votes(model.voters, _words(F.col("text")), F.col("text")))
        weights = F.create_map(*[x for v, w in zip(model.voters, model.weights) for x in (F.lit(v), F.lit(float(w)))])
        total = total + F.aggregate("_v", F.lit(0.0), lambda a, v: a + F.coalesce(weights[v], F.lit(0.0)))
    score = 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply(docs, fit(docs, labels))
