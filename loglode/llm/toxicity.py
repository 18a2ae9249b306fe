"""Operator 4: toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models; each model also gets the probabilities of the
categories before it.  In training those probabilities are out-of-fold: they come from models that did not see the
document.  Features are words and their beginnings of 4 to 7 characters (as 32-bit hashes), present or not; the
`features` most telling ones by document frequency in labelled rows are kept.

The models are fitted on at most `max_labelled` labelled rows (by hash of doc_id), which bounds that one task; every
document is scored, over its whole text.  The chain follows the order of the given label columns: the labels table has
quality and toxic, so the default chain is low_quality, then toxic.

The last category's threshold is the one with the best F1 on out-of-fold scores, unless one is given.

Texts without words (null and empty ones among them) get the share of each category among the labelled rows and are
never toxic.  Labels that are null are left out of the fit, and documents with several label rows count once per row.
Without any labelled document a category has probability 0 (nearly), and a threshold of 0.5 holds.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, memory, slices

WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 5


def features_of_word(word: str) -> list[int]:
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:n]}*".encode()) for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class WordFeatures(Memo):
    """word -> numbers of the chosen features that it has."""

    def __init__(self, chosen: dict[int, int], limit: int = 200_000):
        super().__init__(lambda word: tuple(chosen[f] for f in features_of_word(word) if f in chosen), limit)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 200) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    penalty = np.full(x.shape[1], l2, np.float32)
    penalty[-1] = 0
    v = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(8):  # the largest curvature, which bounds the step
        v = x.T @ (x @ v)
        norm = float(np.linalg.norm(v))
        v /= max(norm, 1e-9)
    step = 1.0 / (0.25 * norm + l2)
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(x @ z)))
        new = z - step * (x.T @ (p - y) + penalty * z)
        w, z = new, new + k / (k + 3) * (new - w)
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def frequencies(docs: list[np.ndarray], labels: np.ndarray, step: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features in order, in how many docs each is, and in how many of each category; `step` docs at a time, so that
    memory follows the number of features and not that of all occurrences."""
    which = np.empty(0, docs[0].dtype)
    for a in range(0, len(docs), step):
        which = np.union1d(which, np.concatenate(docs[a : a + step]))
    every, with_label = np.zeros(len(which), np.int64), np.zeros((labels.shape[1], len(which)))
    for a in range(0, len(docs), step):
        some = docs[a : a + step]
        number = np.searchsorted(which, np.concatenate(some))
        every += np.bincount(number, minlength=len(which))
        for y, total in zip(labels[a : a + step].T.astype(float), with_label):
            total += np.bincount(number, np.repeat(y, [len(d) for d in some]), minlength=len(which))
    return which, every, with_label


def choose_features(docs: list[np.ndarray], labels: np.ndarray, features: int) -> dict[int, int]:
    """The features whose document frequencies differ most between classes, over all categories."""
    n = len(docs)
    which, every, with_label = frequencies(docs, labels)
    best = np.zeros(len(which))
    for y, a in zip(labels.T.astype(float), with_label):
        n1 = max(1.0, y.sum())
        n0 = max(1.0, n - n1)
        share = every / n
        z = np.abs(a / n1 - (every - a) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        best = np.maximum(best, z)
    best[every < 3] = -1
    order = np.lexsort((which, -best))[:features]
    return {int(which[i]): k for k, i in enumerate(order) if best[i] >= 0}


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Half way between the neighbouring scores that part the classes with the best F1; 0.5 with one class only."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    if not len(y) or y.all() or not y.any():
        return 0.5
    hits, ends = np.cumsum(y), np.flatnonzero(np.append(p[1:] != p[:-1], True))
    f1 = 2 * hits[ends] / (ends + 1 + y.sum())
    at = int(ends[int(np.argmax(f1))])
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0)) / 2)


def out_of_fold(x: np.ndarray, y: np.ndarray, folds: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Each row's probability by a model that did not see its fold."""
    out = otherwise.copy()
    for fold in range(FOLDS):
        held = folds == fold
        if held.any() and not held.all():
            out[held] = predict(logistic(x[~held], y[~held]), x[held])
    return out


def fit_chain(docs: list[np.ndarray], folds: np.ndarray, labels: np.ndarray, features: int) -> tuple[dict[int, int], list[np.ndarray], list[float], float]:
    """The chosen features, a model per category (model k takes k earlier probabilities after the features), the share of
    each category, and the threshold of the last."""
    if not len(docs):
        empty = [np.array([-30.0] * (1 + k), np.float32) * (np.arange(1 + k) == k) for k in range(labels.shape[1])]
        return {}, empty, [0.0] * labels.shape[1], 0.5
    chosen = choose_features(docs, labels, features)
    x = np.zeros((len(docs), len(chosen)), np.float32)
    for i, d in enumerate(docs):
        x[i, [chosen[f] for f in d.tolist() if f in chosen]] = 1
    models, threshold = [], 0.5
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float32)
        models.append(logistic(x, y))
        unseen = out_of_fold(x, y, folds, predict(models[-1], x))
        threshold = best_threshold(unseen, labels[:, k].astype(bool))
        x = np.hstack([x, unseen[:, None].astype(np.float32)])
    return chosen, models, labels.mean(axis=0).tolist(), threshold


def train(docs: DataFrame, labels: DataFrame, categories: dict, max_labelled: int, features: int) -> bytes:
    """What fit_chain returns, pickled; categories maps a name to a Column of labels that is 1, 0 or null.

    Documents that share a doc_id and its labels count once, with the least of their feature lists.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
    names = [f"y{i}" for i in range(len(categories))]
    # At most max_labelled rows of a few numbers each, so this side is bounded.
    picked = picked.dropna().orderBy(F.xxhash64("doc_id"), *names).limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                t = batch.slice(a, b - a)
                found = [sorted({f for w in words_of(x) for f in features_of_word(w)}) for x in t["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([t["doc_id"], pa.array(found, pa.list_(pa.int64())), t["fold"], *(t[n] for n in names)], ["doc_id", "found", "fold", *names])

    schema = ", ".join(["doc_id long", "found array<long>", "fold int", *(f"{n} int" for n in names)])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, folds, y = [], [], []
        for t in batches:
            ends = t["found"].offsets.to_numpy()
            values = t["found"].values.to_numpy().astype(np.uint32)
            found += [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
            folds += t["fold"].to_pylist()
            y += zip(*(t[n].to_pylist() for n in names))
        model = fit_chain(found, np.array(folds, int), np.array(y, int).reshape(-1, len(names)), features)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # One row for each row of picked, however many documents share its doc_id: at most max_labelled meet in one task.
    keys = ["doc_id", "fold", *names]
    sample = rows.mapInArrow(describe, schema).groupBy(keys).agg(F.min("found").alias("found")).repartition(1).sortWithinPartitions(*keys)
    row = sample.select("found", "fold", *names).mapInArrow(fit, "model binary").first()
    return row["model"] if row else next(fit(iter(())))["model"][0].as_py()  # an empty sample may leave no task


def score(docs: DataFrame, model: bytes, categories: list[str], carry: list[str] | None = None) -> DataFrame:
    """doc_id, a probability p_<category> and _words (has the text any?) for every row; carry names further columns of
    docs to keep."""
    extra = carry or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)

    kept = ["doc_id", *(["text", *extra] if carry is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, models, shares, _ = pickle.loads(model)
        lookup = memory(("features", zlib.crc32(model)), lambda: WordFeatures(chosen))
        for batch in batches:
            for a, b in slices(batch["text"]):
                t = batch.slice(a, b - a)
                words = [words_of(x) for x in t["text"].to_pylist()]
                found = [sorted({f for w in some for f in lookup[w]}) for some in words]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                which = np.array([f for x in found for f in x], int)
                before: list[np.ndarray] = []
                for w in models:
                    z = np.bincount(at, w[which], minlength=len(found)) + w[-1]
                    for j, p in enumerate(before):
                        z = z + w[len(chosen) + j] * p
                    before.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                some = np.array([len(x) > 0 for x in words], bool)
                scores = [pa.array(np.where(some, p, share)) for p, share in zip(before, shares)]
                yield pa.RecordBatch.from_arrays([*(t[c] for c in kept), *scores, pa.array(some)], [*kept, *(f"p_{c}" for c in categories), "_words"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = [*(f"`{c}` {types[c]}" for c in kept), *(f"p_{c} double" for c in categories), "_words boolean"]
    return rows.mapInArrow(run, ", ".join(schema))


def default_categories() -> dict:
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict | None = None, threshold: float | None = None, max_labelled: int = 12_000, features: int = 400, carry: list[str] | None = None) -> DataFrame:
    """doc_id, p_<category> for each category, and toxic: has words, and the last category's probability reaches threshold."""
    categories = categories or default_categories()
    model = train(docs, labels, categories, max_labelled, features)
    least = pickle.loads(model)[-1] if threshold is None else threshold
    scored = score(docs, model, list(categories), carry)
    return scored.withColumn("toxic", F.col("_words") & (F.col(f"p_{list(categories)[-1]}") >= least)).drop("_words")


def op4_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
