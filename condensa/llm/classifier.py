"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from condensa.llm.common import known_labels, map_texts
from condensa.session import materialize

THRESHOLD = 0.7
#: Share of the covariance of both classes, and then of its mean variance on the diagonal.
POOLED, SHRUNK = 0.3, 0.1
#: Log-density differences are divided by this before they become a probability, and cut.
TEMPERATURE, MOST = 2.0, 30.0

FEATURES = (
    "log_words",
    "word_bytes",
    "distinct_share",
    "log_top_share",
    "adjacent_repeats",
    "repeated_pairs",
    "symbol_share",
    "bar_share",
    "mark_share",
    "stop_share",
    "upper_share",
    "digit_share",
    "line_bytes",
    "dup_line_share",
)

#: Classes of ASCII characters.
_SYMBOLS, _MARKS, _STOPS = b"#*$%&<>@^~_=+{}[]\\/", b"!?", b".,;:"
_CLASSES = {
    "symbol": _SYMBOLS,
    "bar": b"|",
    "mark": _MARKS,
    "stop": _STOPS,
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
}
_OTHERS = {name: bytes(b for b in range(256) if b not in kept) for name, kept in _CLASSES.items()}


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of `FEATURES`; zeros without words.

    Shares are square roots or logarithms, which bring their distributions nearer to normal ones.
    """
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    has = {name: len(text.translate(None, other)) for name, other in _OTHERS.items()}
    folded = text.lower().split()
    counts = Counter(folded)
    pairs = set(zip(folded, folded[1:]))
    letters = has["upper"] + has["lower"]
    lines = [line for line in text.split(b"\n") if line.strip()]

    def root(part: float, whole: float) -> float:
        return (part / whole) ** 0.5 if whole else 0.0

    return [
        float(np.log1p(n)),
        float(np.log((size - text.count(b" ")) / n + 1)),
        len(counts) / n ** 0.85,
        float(np.log(max(counts.values()) / n + 0.01)),
        root(sum(a == b for a, b in zip(folded, folded[1:])), n),
        root(n - 1 - len(pairs), n),
        root(has["symbol"], size),
        root(has["bar"], n),
        root(has["mark"], n),
        root(has["stop"], n),
        root(has["upper"], letters),
        root(has["digit"], size),
        float(np.log1p(size / len(lines))),
        root(len(lines) - len(set(lines)), len(lines)),
    ]


class Gaussian(NamedTuple):
    log_prior: float
    mean: np.ndarray
    factor: np.ndarray  # inverse of the lower Cholesky factor of the covariance
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Up to a constant: the Mahalanobis distance comes from one triangular product."""
        z = (x - self.mean) @ self.factor.T
        return self.log_prior - 0.5 * ((z * z).sum(axis=1) + self.log_det)


class Discriminant(NamedTuple):
    classes: tuple[Gaussian, Gaussian] | None
    constant: float  # the score without classes

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.constant)
        odds = (self.classes[1].log_density(x) - self.classes[0].log_density(x)) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(odds, -MOST, MOST)))


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, x` (array of double): the statistics of each row's whole text."""

    def run(texts: list[bytes]) -> list:
        rows = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        offsets = np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))]

    return map_texts(docs, key, text, run, "x array<double>", binary=True)


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class the count, mean and covariance, summed where the rows are."""
    d = len(FEATURES)
    entries = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in entries]
    found = {}
    for row in rows.groupBy("_label").agg(F.count("*").alias("n"), *sums, *products).collect():
        n, mean = row["n"], np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
        cov = np.zeros((d, d))
        for i, j in entries:
            cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / n - mean[i] * mean[j]
        found[row["_label"]] = (n, mean, cov)
    return found


def fit(
    stats: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    label: str = "quality",
) -> Discriminant:
    """The discriminant of all labelled rows that `learn` (a condition on the labels table) allows.

    Class covariances are mixed with the pooled one, then with a diagonal, so they are never
    singular; constant statistics do no harm. With fewer than two classes, or fewer than two rows in
    one, every score is the smoothed share of label 1.
    """
    known = known_labels(labels.where(learn), key, label)
    found = _moments(stats.join(known, key))
    total = {c: found[c][0] if c in found else 0 for c in (0, 1)}
    if min(total.values()) < 2:
        return Discriminant(None, (total[1] + 1) / (sum(total.values()) + 2))
    n = sum(total.values())
    pooled = sum(total[c] * found[c][2] for c in (0, 1)) / n
    spread = np.maximum(np.diag(pooled), 1e-6)
    classes = []
    for c in (0, 1):
        count, mean, own = found[c]
        cov = (1 - POOLED) * own + POOLED * pooled
        # the diagonal part in units of each statistic's own spread
        scale = np.sqrt(np.outer(spread, spread))
        level = np.trace(cov / scale) / len(cov)
        cov = (1 - SHRUNK) * cov + SHRUNK * level * np.diag(spread)
        lower = np.linalg.cholesky(cov + 1e-9 * np.diag(spread))
        factor = np.linalg.inv(lower)
        log_det = 2 * np.log(np.diag(lower)).sum()
        classes.append(Gaussian(float(np.log(count / n)), mean, factor, float(log_det)))
    return Discriminant((classes[0], classes[1]), 0.5)


def score(
    stats: DataFrame, model: Discriminant, key: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """`key, score, predicted` of each row of `document_statistics`."""
    kind = stats.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            scores = model.scores(x)
            predicted = (scores >= threshold).astype(np.int32)
            columns = [batch.column(0), pa.array(scores), pa.array(predicted)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "score", "predicted"])

    schema = f"`{key}` {kind}, score double, predicted int"
    return stats.select(key, "x").mapInArrow(run, schema=schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """`key, score, predicted` of every row of `docs`, scored from its whole text.

    Statistics are computed once and written to the shared folder (a few numbers a row); learning
    joins them, not texts, to the labels. Null and empty texts have zero statistics and are scored
    like any other; repeated rows and null keys are answered each.
    """
    stats = materialize(document_statistics(docs, key, text), "statistics")
    return score(stats, fit(stats, labels, learn, key, label), key)
