"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the diagonal of the
pooled one. A score is the logistic of the difference of the classes' log
densities and log shares; the densities come from Mahalanobis distances by the
classes' Cholesky factors, which are made once and are constants of the
scoring expression. Sums of a class are one Spark aggregation; the driver sees
one row of sums for each class.

Defined cases: null and empty texts have zero statistics and a score; null
labels and labels without a document are not learnt from, repeated labels
count each time; where a class has fewer than ``MIN_CLASS`` rows the score is
the smoothed share of class 1 (0.5 without labels); an empty table gives no
row; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chapterflow.llm import outliers

FEATURES = ["x_words", "x_length", "x_symbols", "x_lines", "x_repeats", "x_upper", "x_marks", "x_distinct"]
#: Weight of the pooled diagonal, least variance of a feature, least rows of a class.
SHRINK, FLOOR, MIN_CLASS = 0.2, 0.02, 20


@dataclass
class Model:
    """Log odds of the classes' shares; for each class mean, Cholesky factor, and log determinant. No classes: a constant score."""

    log_odds: float
    means: list[np.ndarray]
    factors: list[np.ndarray]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x_*) of every row."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    stats = outliers.statistics(plain, keep=["doc_id"], full=True)
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns({"x_marks": F.log1p(100 * F.col("n_marks") / chars), "x_distinct": F.log1p(100 * (1 - F.col("n_distinct") / words))}).select("row.doc_id", *FEATURES)


def fit(rows: DataFrame, label: str) -> Model:
    """Model of the rows' 0/1 label; rows with another or no label are left out."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in pairs]
    found = {r["y"]: r for r in rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"), *sums).collect()}
    n = [found[y]["n"] if y in found else 0 for y in (0, 1)]
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < MIN_CLASS:
        return Model(log_odds, [], [])
    means, covs = [], []
    for y in (0, 1):
        mean = np.array([found[y][f"s{i}"] for i in range(len(FEATURES))]) / n[y]
        cov = np.zeros((len(FEATURES),) * 2)
        for i, j in pairs:
            cov[i, j] = cov[j, i] = found[y][f"s{i}_{j}"] / n[y] - mean[i] * mean[j]
        means.append(mean)
        covs.append(cov)
    pooled = np.diag((n[0] * covs[0] + n[1] * covs[1]).diagonal() / sum(n))
    factors = [np.linalg.cholesky((1 - SHRINK) * c + SHRINK * pooled + FLOOR * np.eye(len(FEATURES))) for c in covs]
    return Model(log_odds, means, factors)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``score``: the probability of class 1."""
    log_odds: Column = F.lit(model.log_odds)
    out = rows
    for y, sign in zip((0, 1), (0.5, -0.5), strict=True):
        if not model.means:
            break
        mean, factor = model.means[y], model.factors[y]
        for i, x in enumerate(FEATURES):
            rest = F.col(x) - float(mean[i])
            for j in range(i):
                rest = rest - float(factor[i, j]) * F.col(f"_z{y}_{j}")
            out = out.withColumn(f"_z{y}_{i}", rest / float(factor[i, i]))
            log_odds = log_odds + sign * F.col(f"_z{y}_{i}") * F.col(f"_z{y}_{i}")
        log_odds = log_odds + float(2 * sign * np.log(factor.diagonal()).sum())
    bounded = F.least(F.greatest(log_odds, F.lit(-40.0)), F.lit(40.0))
    return out.withColumn("score", 1 / (1 + F.exp(-bounded))).select(*rows.columns, "score")
