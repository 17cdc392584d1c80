"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Cyclic boosting visits the features in turn and fits a
shallow tree over one feature's bins to the current gradient; the trees of a feature add up to one lookup
table. Then the pairs of features whose joint bins explain most of what is left are boosted the same way
into two-way tables. A score is the logistic of an intercept and one table entry per feature and pair, so
scoring is a vectorised sum of bin lookups.

The model is fitted on the driver from at most about max_rows labelled rows, drawn by a hash of doc_id;
every document is scored in Spark tasks. Inputs of a score come from the text alone.

Cases: null and empty texts have all features 0 and are scored like any other; labels that are null are
ignored and of several labels for a document the largest counts; without labels, or with one class only,
the score is the (smoothed) share of label 1; repeated rows and extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_words", "mean_word", "long_words", "distinct_words", "repeated_next", "upper", "digits", "dots",
    "exclaims", "pipes", "symbols", "other_bytes", "words_per_line", "word_ends",
)
MAX_ROWS = 20_000
THRESHOLD = 0.3


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 6, np.int64)
    for kind, chars in ((0, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (1, b"0123456789"), (2, b".,;:'\"?-()"), (3, b"!"), (4, b"|"), (5, b"#$%&*+/<=>@[\\]^_`{}~")):
        kinds[list(chars)] = kind
    kinds[128:] = 7
    kinds[[9, 10, 11, 12, 13, 32]] = 8
    return kinds


KINDS = _byte_classes()


def text_features(text: str | None) -> list[float]:
    """The features of one text, all finite."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper, digits, dots, exclaims, pipes, symbols, _, other, blank = np.bincount(KINDS[raw], minlength=9).tolist()
    n, size = len(words), max(1, len(raw) - blank)
    ends = sum(w[-1] in "!*#$%&|" for w in words)
    return [
        np.log1p(n), size / n, sum(len(w) > 12 for w in words) / n, len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n, upper / size, digits / size, dots / size,
        exclaims / size, pipes / size, symbols / size, other / size, n / (1 + text.count("\n")), ends / n,
    ]


@dataclass
class AdditiveModel:
    """edges[j]: the inner bin edges of feature j; tables[j]: its lookup table; pairs: (i, j) -> two-way table."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), table in self.pairs.items():
            a = np.searchsorted(self.coarse[i], x[:, i], side="right")
            b = np.searchsorted(self.coarse[j], x[:, j], side="right")
            total += table[a, b]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _inner_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(grad, hess, ridge=1.0):
    return grad / (hess + ridge)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 4) -> np.ndarray:
    """The values of a tree with at most so many leaves over ordered bins, each split the best of all leaves."""
    cuts = [0, len(grad)]
    gain = lambda g, h: g * g / (h + 1.0)
    while len(cuts) - 1 < leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            gains = gain(g[:-1], h[:-1]) + gain(g[-1] - g[:-1], h[-1] - h[:-1]) - gain(g[-1], h[-1])
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (float(gains[k]), a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(grad[a:b].sum(), hess[a:b].sum())
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way grid into four quadrants: its gain and the grid of leaf values."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, out = -1.0, np.zeros_like(grad)
    for a in range(grad.shape[0] - 1):
        for b in range(grad.shape[1] - 1):
            parts = [
                (g[a, b], h[a, b]), (g[a, -1] - g[a, b], h[a, -1] - h[a, b]), (g[-1, b] - g[a, b], h[-1, b] - h[a, b]),
                (g[-1, -1] - g[a, -1] - g[-1, b] + g[a, b], h[-1, -1] - h[a, -1] - h[-1, b] + h[a, b]),
            ]
            gain = sum(x * x / (y + 1.0) for x, y in parts)
            if gain > best:
                best, cut, values = gain, (a + 1, b + 1), [_leaf(x, y) for x, y in parts]
    if best > 0:
        a, b = cut
        out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = values
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 32, n_pairs: int = 6) -> AdditiveModel:
    """Fits the model to features x (rows by features) and labels y (0 or 1)."""
    model = AdditiveModel(intercept=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0)
    if len(y) == 0 or y.min() == y.max():
        return model
    width = x.shape[1]
    model.edges = [_inner_edges(x[:, j], bins) for j in range(width)]
    model.coarse = [_inner_edges(x[:, j], 8) for j in range(width)]
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            size = len(model.tables[j])
            grad, hess = slopes()
            step = rate * _tree(np.bincount(fine[j], grad, size), np.bincount(fine[j], hess, size))
            model.tables[j] += step
            total += step[fine[j]]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def grid(i: int, j: int):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        grad, hess = slopes()
        sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (grad, hess)]
        return cell, _quadrants(*sums)

    ranked = sorted(((grid(i, j)[1][0], (i, j)) for i in range(width) for j in range(i)), reverse=True)
    chosen = [pair for _, pair in ranked[:n_pairs]]
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in chosen}
    for _ in range(rounds // 3):
        for i, j in chosen:
            cell, (_, values) = grid(i, j)
            model.pairs[i, j] += rate * values
            total += rate * values.ravel()[cell]
    return model


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label_col: str = "quality") -> AdditiveModel:
    """Learns from labelled documents whose crc32(doc_id as text) mod 5 is not 0, about max_rows of them at most."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max(label_col).cast("double").alias("__label"))
    found = usable.count()
    share = min(1.0, max_rows / max(1, found))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return text.map(text_features)

    # drawn is bounded by max_rows, so it may be broadcast.
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(features("text").alias("x"), "__label")
    table = rows.toPandas()
    x = np.array(table["x"].tolist(), float).reshape(len(table), len(FEATURES))
    return fit(x, table["__label"].to_numpy(float))


def held_out(column: str):
    """Whether labels of a row are never learned from; a row without an id has none, and is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def score(documents: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 if score >= threshold, else 0)."""

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in text], float).reshape(len(text), len(FEATURES))
        return pd.Series(model.scores(x))

    out = documents.withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return score(documents, train(documents, labels, max_rows))
