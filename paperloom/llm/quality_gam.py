"""Quality classifier: a generalised additive model with pairwise interactions.

Features describe the shape of a text (letters, marks, repetition, words), never its id, source or language. Each is cut
into bins at quantiles. Cyclic boosting visits the features in turn, fits a shallow tree on the bins of one and adds it to
that feature's look-up table; then the pairs that lower the loss most get tables over two coarse binnings in the same way.
A score is the sum of looked-up bins through a logistic function, computed for a batch of texts at once.

Training rows are a bounded sample (``MAX_TRAINING_ROWS``) in hash order of the id, so it does not depend on the layout of
the table; only their features reach the driver. Every document is scored, with its whole text.

Null and empty texts have features of their own (all zero) and a score. Several labels of one id count by their mean, rounded
to 0 or 1; null labels and null ids are not learned from. Without labels, or with labels of one kind, the score is the share
of label 1, or 1 if there are none, so that nothing is rejected. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
FEATURES = [
    "log_words", "word_length", "upper", "lower", "digit", "space", "line_ends", "beyond_ascii", "stops", "shouts", "bars",
    "symbols", "brackets", "quotes", "distinct_words", "commonest_word", "distinct_lines", "distinct_pairs", "marks_per_word",
]

_CLASSES = np.zeros((256, 13), dtype=np.float64)
for _column, _bytes in enumerate(
    (
        range(65, 91), range(97, 123), range(48, 58), (32, 9), (10, 13), range(128, 256), b".,;:", b"!?", b"|\\/_~",
        b"#$%&*@^+=<>", b"()[]{}", b"\"'`-", [*range(9), 11, 12, *range(14, 32), 127],
    )
):
    _CLASSES[list(_bytes), _column] = 1


def features_of(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    if not data:
        return np.zeros(len(FEATURES))
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _CLASSES
    share = count / len(data)
    words = data.lower().split()
    n = max(1, len(words))
    tally = Counter(words)
    lines = data.split(b"\n")
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    return np.array(
        [
            np.log1p(len(words)), (len(data) - count[3] - count[4]) / n, *share[:6], *share[6:12],
            len(tally) / n, max(tally.values(), default=0) / n, len(set(lines)) / len(lines), pairs, (count[6:12].sum() + count[12]) / n,
        ]
    )


def _tree_on_bins(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of the regression tree with the given number of leaves, split where the loss falls most."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    parts = [(0, len(gradient))]

    def gain(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        if not cut.size:
            return 0.0, a
        whole = (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
        both = (g[cut] - g[a]) ** 2 / (h[cut] - h[a] + 1) + (g[b] - g[cut]) ** 2 / (h[b] - h[cut] + 1) - whole
        best = int(np.argmax(both))
        return float(both[best]), int(cut[best])

    while len(parts) < leaves:
        (best, cut), part = max(((gain(*p), p) for p in parts), key=lambda x: x[0][0])
        if best <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    table = np.zeros(len(gradient))
    for a, b in parts:
        table[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return table


def _tree_on_pairs(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Table over two binnings: one cut along the first, and one along the second on either side; and its gain."""
    best_gain, best = 0.0, np.zeros_like(gradient)
    for cut in range(1, gradient.shape[0]):
        table, total = np.zeros_like(gradient), 0.0
        for rows in (slice(0, cut), slice(cut, None)):
            g, h = gradient[rows].sum(axis=0), weight[rows].sum(axis=0)
            values = _tree_on_bins(g, h, 2)
            table[rows] = values
            total += float((values * g).sum())
        if total > best_gain:
            best_gain, best = total, table
    return best, best_gain


class PairwiseAdditiveModel:
    """Look-up tables per feature and per chosen pair of features."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 200, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate = bins, coarse, rounds, pair_rounds, pairs, rate
        self.base, self.cuts, self.tables = 0.0, [], []
        self.pair_cuts, self.pairs, self.pair_tables = [], [], []

    @staticmethod
    def _edges(values: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseAdditiveModel:
        share = float(y.mean()) if len(y) else 1.0
        self.base = float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -9, 9))
        if len(set(y.tolist())) < 2:
            return self
        self.cuts = [self._edges(v, self.bins) for v in x.T]
        self.pair_cuts = [self._edges(v, self.coarse) for v in x.T]
        fine = [np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)]
        rough = [np.searchsorted(c, v, side="right") for c, v in zip(self.pair_cuts, x.T, strict=True)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        total = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for table, at in zip(self.tables, fine, strict=True):
                g, h = slopes()
                step = self.rate * _tree_on_bins(np.bincount(at, g, len(table)), np.bincount(at, h, len(table)), 3)
                table += step
                total += step[at]

        def over_pair(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            width = len(self.pair_cuts[j]) + 1
            at = rough[i] * width + rough[j]
            g, h = slopes()
            size = (len(self.pair_cuts[i]) + 1) * width
            return at, np.bincount(at, g, size).reshape(-1, width), np.bincount(at, h, size).reshape(-1, width)

        ranked = []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                _, g, h = over_pair(i, j)
                ranked.append((-_tree_on_pairs(g, h)[1], i, j))
        self.pairs = [(i, j) for gain, i, j in sorted(ranked)[: self.n_pairs] if gain < 0]
        self.pair_tables = [np.zeros((len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                at, g, h = over_pair(i, j)
                step = self.rate * _tree_on_pairs(g, h)[0]
                table += step
                total += step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for cuts, table, v in zip(self.cuts, self.tables, x.T, strict=True) if self.tables else ():
            total += table[np.searchsorted(cuts, v, side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            rows, columns = (np.searchsorted(self.pair_cuts[k], x[:, k], side="right") for k in (i, j))
            total += table[rows, columns]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features_of(t) for t in texts]).reshape(-1, len(FEATURES))


def text_features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(texts)))

    return of(text)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> PairwiseAdditiveModel:
    """Fit on at most ``max_rows`` labelled ids outside the held-out fold."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.round(F.avg(label_col)).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # at most max_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", text_features(F.col("text")).alias("x"))
    once = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in once]).reshape(-1, len(FEATURES))
    return PairwiseAdditiveModel().fit(x, np.array([r["label"] for r in once], dtype=np.float64))


def score(text: Column, model: PairwiseAdditiveModel) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    return scored(text)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that the classifier predicts to have label 1."""
    return docs.where(score(F.col("text"), train(docs, labels)) >= THRESHOLD)
