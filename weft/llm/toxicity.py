"""Toxicity by non-negative positive-unlabelled learning (operator 5).

A linear classifier over hashed words and word beginnings is trained in numpy
from confirmed toxic documents and from unlabelled text.  Its risk is that of
the positives, plus the unlabelled risk of the negative class corrected for the
class prior; where that correction falls below zero, the step goes the other
way, so that the estimate stays non-negative.

Only features with enough evidence take part; the documents that show a feature
are counted in Spark, and no more than ``MAX_FEATURES`` features are sent to the
driver.  The sample is bounded by ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` texts,
which take part whole, as every text that is scored does.

Defined results: null and empty texts get the score of a text without features;
a training set without positives or without text gives a classifier that scores
everything 0; repeated rows get equal scores; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import sample_texts
from .scratch import written
from .words import Words, chunks, mix

MAX_POSITIVE, MAX_UNLABELLED = 2000, 6000
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Features kept, and the least documents that show one.
MAX_FEATURES, LEAST_DOCS = 4096, 4
ROUNDS, RATE, WEIGHT_DECAY = 300, 0.05, 1e-3
THRESHOLD = 0.3


def feature_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the features of all words; a word's trailing marks are not cut off."""
    whole = words.hashes()
    length = words.end - words.start
    rows, hashes = [words.doc], [whole]
    for n in BEGINNINGS:
        long = length > n
        rows.append(words.doc[long])
        hashes.append(mix(words.hashes(n)[long] ^ np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def _by_row(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The distinct feature hashes of each text."""
    for part in chunks(batch):
        rows, hashes = feature_hashes(Words(part.column("text"), lower=True))
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
        yield part, [np.unique(hashes[order[a:b]]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of each text (whole) to be toxic."""
        total = np.full(len(texts), self.bias)
        if len(self.hashes):
            rows, hashes = feature_hashes(Words(texts, lower=True))
            at = np.searchsorted(self.hashes, hashes)
            at[at == len(self.hashes)] = 0
            hit = self.hashes[at] == hashes
            seen = np.unique(rows[hit] * np.int64(len(self.hashes)) + at[hit])
            np.add.at(total, seen // len(self.hashes), self.weights[seen % len(self.hashes)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risks(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk of the positives, that of the negatives as the unlabelled show it, and both gradients (weights, then bias).

    Logistic losses: -log(s) as positive, -log(1 - s) as negative.
    """
    w32 = w.astype(np.float32)
    sp, su = _sigmoid((p @ w32).astype(float) + b), _sigmoid((u @ w32).astype(float) + b)
    positive = -prior * np.log(sp).mean()
    negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
    g_positive = prior * np.append((sp - 1).astype(np.float32) @ p / len(p), (sp - 1).mean())
    g_negative = np.append(su.astype(np.float32) @ u / len(u) - prior * (sp.astype(np.float32) @ p) / len(p), su.mean() - prior * sp.mean())
    return positive, negative, g_positive, g_negative


def fit(kept: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> Model:
    """From sorted feature hashes and 0/1 matrices of positive and unlabelled texts; prior is the share of positives among the unlabelled."""
    if not len(kept) or not len(p) or not len(u):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    w, b = np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for k in range(1, ROUNDS + 1):
        _, negative, g_positive, g_negative = risks(w, b, p, u, prior)
        grad = -g_negative if negative < 0 else g_negative + g_positive
        grad[:-1] += WEIGHT_DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(kept, w, float(b))


def chosen_features(counts: DataFrame, n_positive: int, n_unlabelled: int, prior: float) -> DataFrame:
    """hash of the features with enough evidence, the strongest MAX_FEATURES at most.

    counts has hash, and the positive and unlabelled texts that show it.  A
    feature of toxic text shows up among the unlabelled about prior times as
    often as among the positives; Chernoff's bound holds chance down, over all
    the features that are looked at.
    """
    tried = counts.where("positive > 0").count()
    lift = F.greatest(F.lit(1.0), (F.col("positive") / n_positive) / ((F.col("unlabelled") + 1) / n_unlabelled))
    strong = (F.col("positive") >= LEAST_DOCS) & (F.col("lift") > 0.5 / prior) & (F.col("positive") * (F.log("lift") - 1 + 1 / F.col("lift")) > math.log(max(tried, 1)))
    return counts.withColumn("lift", lift).where(strong).orderBy(F.desc(F.col("positive") * F.log("lift")), "hash").limit(MAX_FEATURES).select("hash")


def train(docs: DataFrame, positive: DataFrame, unlabelled: DataFrame, prior: float) -> Model:
    """From at most MAX_POSITIVE and MAX_UNLABELLED different texts: those of the positive doc_ids, and of unlabelled."""
    toxic = sample_texts(docs.where("text is not null"), MAX_POSITIVE, ids=positive)
    drawn = toxic.withColumn("positive", F.lit(True)).unionByName(sample_texts(unlabelled, MAX_UNLABELLED).withColumn("positive", F.lit(False)))
    texts = written(drawn.select("text", "positive"), "labelled")
    sizes = {r.positive: r["count"] for r in texts.groupBy("positive").count().collect()}
    nothing = np.zeros((0, 0), np.float32)
    if len(sizes) < 2:
        return fit(np.zeros(0, np.uint64), nothing, nothing, prior)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes in _by_row(batch):
                of = np.repeat(part.column("positive").to_numpy(zero_copy_only=False).astype(np.int64), [len(h) for h in hashes])
                every = np.concatenate(hashes)
                values, at = np.unique(every, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *(pa.array(np.bincount(at, x, len(values)).astype(np.int64)) for x in (of, 1 - of))], ["hash", "positive", "unlabelled"])

    counts = written(texts.mapInArrow(shown, "hash long, positive long, unlabelled long").groupBy("hash").agg(F.sum("positive").alias("positive"), F.sum("unlabelled").alias("unlabelled")).where("positive > 0"), "counts")
    kept = np.sort(np.array([r.hash for r in chosen_features(counts, sizes[True], sizes[False], prior).collect()], np.int64).view(np.uint64))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes in _by_row(batch):
                yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array([np.flatnonzero(np.isin(kept, h, assume_unique=True)).astype(np.int16) for h in hashes], pa.list_(pa.int16()))], ["positive", "places"])

    got = texts.mapInArrow(reduced, "positive boolean, places array<smallint>").orderBy("positive", F.xxhash64("places")).collect()

    def matrix(rows: list) -> np.ndarray:
        x = np.zeros((len(rows), len(kept)), np.float32)
        for i, r in enumerate(rows):
            x[i, r.places] = 1
        return x

    return fit(kept, *(matrix([r for r in got if r.positive is want]) for want in (True, False)), prior)


def train_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """From documents and their 0/1 labels ``toxic``; the prior is the labelled rows' share of positives."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(0.5, max(0.001, (toxic or 0) / max(1, n)))
    return train(docs, known.where("toxic = 1"), docs.where("text is not null"), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, plus score."""
    schema = docs.drop("score").withColumn("score", F.lit(0.0)).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.append_column("score", pa.array(held.value.scores(part.column("text"))))

    return docs.drop("score").mapInArrow(make, schema)
