"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades.

P(grade > k) = logistic(x.w - threshold_k): one weight vector for all ordered
thresholds. The model gives the expected severity, the sum of those
probabilities, and the probability of any toxicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table, written
from .features import drawn, feature_counts, gathered, labelled_sample, narrowed, scored, word_features

BITS = 20
MAKERS = [(word_features(BITS, prefixes=(4, 5, 6)), 1 << BITS)]
#: Labelled rows that the model is fitted on at most; standard deviations by which a feature's share in toxic and clean rows must differ.
SAMPLE, DEVIATIONS = 12000, 4.0
#: Severity grades: 0 for rows labelled clean, 1 to GRADES for rows labelled toxic; parts of the sample that judge each other.
GRADES, FOLDS = 3, 2


def grades(rows: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Severity grades from two-valued labels: toxic rows in equal shares by the margin that a model of the other folds gives them."""
    if not len(rows) or not toxic.any():
        return toxic
    margin = np.zeros(len(rows))
    fold = np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        model = OrdinalModel.fit([r for r, f in zip(rows, fold, strict=True) if f != k], toxic[fold != k], size)
        for i in np.flatnonzero(fold == k):
            margin[i] = model.weights[rows[i]].sum(dtype=float)
    cuts = np.quantile(margin[toxic > 0], np.arange(1, GRADES) / GRADES)
    return np.where(toxic > 0, 1 + (margin[:, None] > cuts).sum(axis=1), 0)


def deviations(seen: np.ndarray, bad: np.ndarray, n: int, n_bad: int) -> np.ndarray:
    """By how many standard deviations a feature's share in toxic rows is above that in clean ones; seen, bad: rows, and toxic rows, that have it."""
    n_bad, n_good = max(1, n_bad), max(1, n - n_bad)
    mean = ((seen + 0.5) / (n + 1)).clip(0, 1 - 1e-9)
    return (bad / n_bad - (seen - bad) / n_good) / np.sqrt(mean * (1 - mean) * (1 / n_bad + 1 / n_good))


def telling(rows: DataFrame, size: int) -> DataFrame:
    """rows (nr, label, features) with those features alone that a model of the sample, or of it without one of the folds, takes.

    They are counted and picked by the executors, so the driver gets few of the
    features of a text; fit() would leave out the others and gives the same model.
    """
    part = F.col("nr") % FOLDS * 2 + ((F.col("label") > 0) & ~F.isnan("label")).cast("long")
    n = np.zeros((FOLDS, 2), np.int64)
    for r in rows.groupBy(part.alias("part")).count().collect():
        n[divmod(r["part"], 2)] = r["count"]
    models = [[k for k in range(FOLDS) if k != out] for out in range(-1, FOLDS)]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).reshape(FOLDS, 2, -1)
            keep = np.zeros(batch.num_rows, bool)
            for folds in models:
                keep |= np.abs(deviations(seen[folds].sum(axis=(0, 1)), seen[folds, 1].sum(axis=0), int(n[folds].sum()), int(n[folds, 1].sum()))) >= DEVIATIONS
            yield batch.select(["feature"]).filter(pa.array(keep))

    chosen = feature_counts(rows, part, 2 * FOLDS).mapInArrow(pick, "feature int").toArrow()
    return narrowed(rows, chosen.column(0).to_numpy(), size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def cut_points(params: np.ndarray, top: int) -> np.ndarray:
    """The ascending thresholds in the last `top` parameters: the first one, and logarithms of the gaps."""
    last = params[len(params) - top :]
    return last[0] + np.concatenate(([0.0], np.cumsum(np.exp(last[1:]))))


def ordinal_loss(params: np.ndarray, owner: np.ndarray, col: np.ndarray, grade: np.ndarray, top: int, ridge: float) -> tuple[float, np.ndarray]:
    """The mean negative log likelihood of the grades with a ridge on the weights, and its gradient.

    params: weights, then thresholds as in cut_points; owner, col: the row and
    the weight of each feature that occurs.
    """
    n, used = len(grade), len(params) - top
    w, cut = params[:used], cut_points(params, top)
    eta = np.bincount(owner, w[col], minlength=n)
    high = np.where(grade < top, cut[np.minimum(grade, top - 1)] - eta, np.inf)
    low = np.where(grade > 0, cut[np.maximum(grade - 1, 0)] - eta, -np.inf)
    sh, sl = _sigmoid(high), _sigmoid(low)
    p = (sh - sl).clip(1e-12)
    dh, dl = sh * (1 - sh) / p / n, sl * (1 - sl) / p / n
    slope = np.zeros_like(params)
    slope[:used] = np.bincount(col, (dh - dl)[owner], minlength=used) + ridge * w
    on_cut = np.bincount(np.maximum(grade - 1, 0), dl, minlength=top)[:top] - np.bincount(np.minimum(grade, top - 1), np.where(grade < top, dh, 0), minlength=top)[:top]
    after = np.cumsum(on_cut[::-1])[::-1]
    slope[used] = after[0]
    slope[used + 1 :] = after[1:] * np.exp(params[used + 1 :])
    return float(-np.log(p).mean() + ridge * (w @ w) / 2), slope


class OrdinalModel:
    """Weights of features and ascending thresholds; grade k or less has probability logistic(thresholds[k] - x.w)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grade: np.ndarray, size: int, ridge: float = 1e-4, steps: int = 250, rate: float = 0.08) -> OrdinalModel:
        """By full-batch Adam on the likelihood with a ridge on the weights; without rows the model never sees toxicity."""
        if len(rows) == 0 or grade.max(initial=0) == 0:
            return cls(np.zeros(size), np.array([8.0]))
        top = int(grade.max())
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        names, flat = np.unique(np.concatenate(rows), return_inverse=True)
        seen = np.bincount(flat, minlength=len(names))
        bad = np.bincount(flat[grade[owner] > 0], minlength=len(names))
        used = np.flatnonzero(np.abs(deviations(seen, bad, len(rows), int((grade > 0).sum()))) >= DEVIATIONS)
        place = np.full(len(names), -1, np.int64)
        place[used] = np.arange(len(used))
        keep = place[flat] >= 0
        col, owner = place[flat][keep], owner[keep]
        n = len(rows)
        share = np.array([(grade <= k).mean() for k in range(top)]).clip(1 / (n + 1), n / (n + 1))
        start = np.log(share / (1 - share))
        gaps = np.log(np.diff(start).clip(1e-2))
        params = np.concatenate((np.zeros(len(used)), [start[0]], gaps))
        first, second = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            slope = ordinal_loss(params, owner, col, grade, top, ridge)[1]
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights = np.zeros(size)
        weights[names[used]] = params[: len(used)]
        return cls(weights, cut_points(params, top))

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with `severity` (expected grade) and `p_toxic` (of any grade above 0).

        Null and empty texts have no features and get the base rates. Other
        columns pass through; columns of those two names are replaced.
        """
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("severity", "p_toxic")])
        out = scored(docs, text_col, MAKERS, self.weights, "__eta")
        over = [1 / (1 + F.exp(F.lit(float(t)) - F.col("__eta"))) for t in self.thresholds]
        severity = over[0]
        for x in over[1:]:
            severity = severity + x
        return out.withColumns({"severity": severity, "p_toxic": over[0]}).drop("__eta")


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, label_col: str = "toxic", where=None) -> OrdinalModel:
    """An ordinal model from two-valued labels, fitted on at most `most` labelled rows and SAMPLE_BYTES of features, of which the driver gets the telling ones.

    Labels that are null, or of a null id, play no part; an id with both labels
    is toxic, and each text of a repeated id counts. Rows are picked by the hash
    of their id. Without toxic rows the model finds nothing toxic.
    """
    sample = written(drawn(labelled_sample(docs, labels, label_col, most, where=where), MAKERS))
    rows, label = gathered(telling(sample, 1 << BITS))
    forget(sample)
    toxic = (label > 0).astype(int)
    return OrdinalModel.fit(rows, grades(rows, toxic, 1 << BITS), 1 << BITS)


def reject_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of docs whose probability of toxicity is below `most`, with their own columns."""
    return model.score(docs, text_col).where(F.col("p_toxic") < most).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = fit_toxicity(docs, labels).score(docs.select("doc_id", "text"))
    return out.select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= 0.5).alias("rejected"))
