"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; every training text, whatever its label, is unlabelled. The
class prior is estimated from how much of the unlabelled scores lies above the best cut of the
positives. A logistic model then minimises the non-negative unbiased risk
prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)]).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common

#: Most rows of either sample, positives and unlabelled, that a model is fitted on: those whose
#: hashed ids are smallest.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
_NAMES = (
    "word_size upper digits sentence_marks bangs pipes symbols "
    "distinct_words distinct_pairs same_as_last distinct_lines shouted capital_start marked_end"
).split()
N_FEATURES = len(_NAMES)

#: Byte classes: upper case 0, digit 1, sentence mark 2, exclamation mark 3, pipe 4, symbol 5, any other 6.
_CLASS = np.full(256, 6)
_CLASS[65:91], _CLASS[48:58], _CLASS[ord("!")], _CLASS[ord("|")] = 0, 1, 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 2
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 5


def features(text: bytes) -> np.ndarray:
    """Shape of a text: word size, shares of character classes, repetition and casing of its words."""
    out = np.zeros(N_FEATURES)
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return out
    share = np.bincount(_CLASS, weights=np.bincount(data, minlength=256), minlength=7) / len(data)
    starts, ends = common.word_bounds(data)
    n = len(starts)
    out[0] = (ends - starts).mean() / 10 if n else 0
    out[1:7] = share[:6]
    if n:
        words = common.word_hashes(data, starts, ends, 0)
        pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
        lines = text.split(b"\n")
        kinds = _CLASS[data]
        first, last = kinds[starts], kinds[ends - 1]
        capitals = np.concatenate(([0], np.cumsum(kinds == 0)))
        out[7:] = (
            len(np.unique(words)) / n,
            len(np.unique(pairs)) / max(1, len(pairs)),
            (words[1:] == words[:-1]).mean() if n > 1 else 0,
            len(set(lines)) / len(lines),
            ((capitals[ends] - capitals[starts]) >= 2).mean(),
            (first == 0).mean(),
            ((last >= 3) & (last <= 5)).mean(),
        )
    return out


def _expanded(x: np.ndarray) -> np.ndarray:
    """Features, roots of the shares and a constant."""
    return np.concatenate((x, np.sqrt(np.clip(x[:, 1:], 0, None)), np.ones((len(x), 1))), axis=1)


class Model:
    """A logistic model over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        z = np.clip((_expanded(x) - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, size: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam with a fixed number of steps from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of both tails over all cuts, with a margin for chance."""
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    tail = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    p, u = tail(positive), tail(unlabelled)
    slack = np.sqrt(np.log(4 / 0.1) / 2 / len(positive)) + np.sqrt(np.log(4 / 0.1) / 2 / len(unlabelled))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 5e-3) -> Model:
    """Minimises the non-negative risk; too few rows of either kind give a model that scores 1."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(np.zeros(1), np.ones(1), None, 1.0)
    p, u = _expanded(positive), _expanded(unlabelled)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    # first positives against unlabelled, for the prior
    a = _descend(lambda w: (u * _sigmoid(u @ w)[:, None]).mean(0) - (p * _sigmoid(-(p @ w))[:, None]).mean(0) + decay * w, p.shape[1], 300)
    prior = class_prior(p @ a, u @ a)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        loss_u, loss_p = np.logaddexp(0, u @ w).mean(), np.logaddexp(0, p @ w).mean()
        gain = -prior * (p * (1 - sp)[:, None]).mean(0)
        rest = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        # a negative part that has fallen below zero is climbed back
        return (gain + rest if loss_u - prior * loss_p >= 0 else -rest) + decay * w

    return Model(mean, scale, _descend(gradient, p.shape[1]), prior)


def _features_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            flat = np.concatenate([np.zeros(0)] + [features(t.as_py() or b"") for t in batch[1]])
            rows = pa.FixedSizeListArray.from_arrays(pa.array(flat), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch[0], rows], ["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, x array<double>"
    )


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS) -> Model:
    """Fits a model on at most `sample` trusted positives (labels.quality 1) and `sample` unlabelled rows."""
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = common.smallest(ids.join(trusted, "doc_id", "left_semi"), sample).withColumn("kind", F.lit(1)).unionByName(
        common.smallest(ids, sample).withColumn("kind", F.lit(0))
    )
    # at most twice the sample, so it may be broadcast; one text of every id, however often it occurs
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"
    ).groupBy("doc_id").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    got = _features_of(rows, "doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").select("kind", "x").toArrow()
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES)
    kind = np.array(got["kind"])
    order = np.lexsort(x.T)  # the fit must not depend on the order of rows
    x, kind = x[order], kind[order]
    return fit(x[kind == 1], x[kind == 0])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs that a caller needs are kept apart: returns doc_id, text and score of every row."""

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py().encode() if t.is_valid else b"") for t in batch[1]]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(model.scores(x))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        x = np.array([features(t.encode() if t is not None else b"") for t in texts]).reshape(-1, N_FEATURES)
        return pd.Series(model.scores(x))

    return docs.filter(scored(F.col(text).cast("string")) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    The model learns from rows whose crc32(doc_id as text) mod 4 is not 2. Null and empty texts
    have all-zero features and are scored like any other; rows with a null id are scored, never
    learned from and not held out; repeated rows count once per row. Without trusted positives
    every score is 1. An empty table gives an empty result; other columns are ignored.
    """
    learned = F.col("doc_id").isNotNull() & (common.fold("doc_id", 4) != 2)
    model = train(docs.filter(learned), labels.filter(learned))
    return score(docs, model).select(
        "doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def op4_quality_pu(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
