"""Quality classifier: a support vector machine on naive Bayes features.

Indicators of n-grams (words, word pairs, shapes of the text) are scaled by the
log-ratio of their smoothed counts in the two classes; a linear hinge-loss model
is then fitted by dual coordinate descent, and mixed with its mean weight as the
interpolation of naive Bayes and SVM asks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .features import SHAPE_BITS, fetched, labelled_sample, scored, shape_features, word_features

WORD_BITS = 18
MAKERS = [(word_features(WORD_BITS, bigrams=True), 1 << WORD_BITS), (shape_features, 1 << SHAPE_BITS)]
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Labelled rows that the model is fitted on at most.
SAMPLE = 6000


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log of the ratio of each feature's smoothed share in class 1 and in class 0."""
    counts = []
    for side in (1, 0):
        picked = [r for r, k in zip(rows, y, strict=True) if k == side]
        counts.append(alpha + (np.bincount(np.concatenate(picked), minlength=size) if picked else np.zeros(size)))
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, c: float = 1.0, passes: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min (|w|^2 + bias^2) / 2 + c * sum of hinge losses; rows hold feature numbers, values their value.

    Each step maximises the dual in one variable, which lies between 0 and c.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    w, bias = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(rows))
    own = [values[r] for r in rows]
    norm = np.array([float(v @ v) for v in own]) + 1.0
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)).tolist():
            r, v, s = rows[i], own[i], sign[i]
            gradient = s * (float(w[r] @ v) + bias) - 1
            new = min(c, max(0.0, alpha[i] - gradient / norm[i]))
            step = (new - alpha[i]) * s
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


class QualityModel:
    """weights for the features of MAKERS, and a bias; the score is the logistic of their sum."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, c: float = 0.1, beta: float = 0.75) -> QualityModel:
        """Without rows, or with one class only, every score is that class's share.

        beta: how far weights are moved from their mean size towards themselves;
        features of weight 0, which no support vector has, stay at 0.
        """
        if len(rows) == 0 or len(set(y.tolist())) < 2:
            share = (float(y.sum()) + 1) / (len(y) + 2)
            return cls(np.zeros(SIZE), np.log(share / (1 - share)))
        ratio = log_count_ratio(rows, y, SIZE)
        w, bias = dual_coordinate_descent(rows, ratio, y, c)
        mean = float(np.abs(w).sum() / max(1, np.count_nonzero(w)))
        return cls(((1 - beta) * mean + beta * w) * ratio * (w != 0), bias * beta)

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """docs and `name`, from 0 to 1; null and empty texts get the bias alone. Other columns pass through; a column of that name is replaced."""
        out = scored(docs, text_col, MAKERS, self.weights, name)
        return out.withColumn(name, 1 / (1 + F.exp(-(F.col(name) + F.lit(self.bias)))))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, where=None, label_col: str = "quality") -> QualityModel:
    """A model from two-valued labels, fitted on at most `most` labelled rows and SAMPLE_BYTES of features.

    Labels that are null, or of a null id, play no part; an id with both labels
    counts as 1, and each text of a repeated id counts. Rows are picked by the
    hash of their id.
    """
    rows, label = fetched(labelled_sample(docs, labels, label_col, most, where=where), MAKERS)
    return QualityModel.fit(rows, (label > 0).astype(int))


def op10_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit_quality(docs, labels, where=F.coalesce(remainder != 1, F.lit(True)))
    scores = model.score(docs.select("doc_id", "text")).withColumn("held_out", F.coalesce(remainder == 1, F.lit(False)))
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
