"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .rules import base_statistics

SHRINK = 0.15
RIDGE = 1e-3


#: Words of plain prose that are added to every text before shares are taken, so that a short text is not judged by
#: chance: their letters, capitals and stops.
ADDED_WORDS, ADDED_CHARS, ADDED_CAPITALS, ADDED_STOPS = 10, 50, 1.5, 1.5


def transformed() -> dict[str, Column]:
    """Document statistics, by roots, squares and logarithms nearer to normal; none looks at id, source or language."""
    n, chars, lines = F.col("n_words") + ADDED_WORDS, F.col("word_chars") + ADDED_CHARS, F.col("n_lines") + 1
    return {
        "x_word_length": F.log1p(chars / n),
        "x_symbols": F.sqrt(F.col("n_symbols") / n),
        "x_capitals": F.sqrt((F.col("n_capitals") + ADDED_CAPITALS) / chars),
        "x_shouts": F.sqrt(F.col("n_shouts") / n),
        "x_stops": F.sqrt((F.col("n_stops") + ADDED_STOPS) / n),
        "x_repeats": (F.col("n_repeat_words") / n) ** 2,
        "x_dup_lines": F.col("n_dup_lines") / lines,
    }


@dataclass(frozen=True)
class Gaussian:
    """A class: share of the rows, mean, Cholesky factor of the shrunk covariance, and its inverse, kept for scoring."""

    share: float
    mean: np.ndarray
    factor: np.ndarray
    inverse: np.ndarray

    @staticmethod
    def of(n: float, total: float, sums: np.ndarray, products: np.ndarray, pooled: np.ndarray, shrink: float) -> Gaussian:
        mean = sums / n
        own = products / n - np.outer(mean, mean)
        mixed = (1 - shrink) * own + shrink * pooled
        mixed = (1 - shrink) * mixed + shrink * np.diag(np.diag(mixed))
        factor = np.linalg.cholesky(mixed + RIDGE * np.eye(len(mean)))
        return Gaussian(n / total, mean, factor, np.linalg.inv(factor))

    def log_density(self, xs: list[Column]) -> Column:
        """log share, less half the log determinant and the squared Mahalanobis distance, as a column."""
        distance = F.lit(0.0)
        for i in range(len(xs)):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + F.lit(float(self.inverse[i, j])) * (xs[j] - F.lit(float(self.mean[j])))
            distance = distance + z * z
        constant = float(np.log(self.share) - np.log(np.diag(self.factor)).sum())
        return F.lit(constant) - 0.5 * distance


def fit(labelled: DataFrame, names: list[str], label: str, shrink: float = SHRINK) -> tuple[Gaussian, Gaussian] | None:
    """(class 0, class 1) from one aggregation of counts, sums and products, a row a class; None if one has no rows."""
    sums = [F.sum(x).alias(f"s_{i}") for i, x in enumerate(names)]
    products = [F.sum(F.col(x) * F.col(y)).alias(f"p_{i}_{j}") for i, x in enumerate(names) for j, y in enumerate(names) if j <= i]
    rows = {r[label]: r for r in labelled.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    if 0 not in rows or 1 not in rows:
        return None
    d, total = len(names), float(rows[0]["n"] + rows[1]["n"])

    def arrays(r):
        p = np.array([[r[f"p_{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
        return float(r["n"]), np.array([r[f"s_{i}"] for i in range(d)], dtype=float), p

    parts = [arrays(rows[c]) for c in (0, 1)]
    pooled = sum(p - np.outer(s, s) / n for n, s, p in parts) / total
    return tuple(Gaussian.of(n, total, s, p, pooled, shrink) for n, s, p in parts)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score_quality(docs: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """(doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted.

    Learns from labels of rows that are not held out. The score maps the difference of the two classes' log densities
    to 0 to 1 without flattening out: 0.5 + 0.5 * t / (1 + |t|) with t half that difference; predicted is score >= 0.5.

    Null and empty texts have the statistics of the added words alone and are scored like others. A null doc_id is never held out and has no
    label. Labels other than 0 and 1 are left out; a document with several labels counts once for each. Without labels
    of both classes all scores are 0.5. Repeated rows are scored alike. An empty table gives no rows. Columns besides
    these don't take part.
    """
    xs = transformed()
    d = base_statistics(docs.select("doc_id", "text")).select("doc_id", *[x.alias(k) for k, x in xs.items()])
    d = stored(d.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y"))
    model = fit(d.filter(~F.col("held_out")).join(known, F.col("doc_id") == F.col("__id")), list(xs), "__y", shrink)
    if model is None:
        score = F.lit(0.5)
    else:
        columns = [F.col(x) for x in xs]
        t = (model[1].log_density(columns) - model[0].log_density(columns)) / 2
        score = 0.5 + 0.5 * t / (1 + F.abs(t))
    d = d.withColumn("score", score)
    return d.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
