"""Quality by a regularised quadratic discriminant over transformed statistics of the document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

#: Names of the statistics, in their order.
STATISTICS = [
    "log_words", "log_mean_word", "upper", "symbol", "punctuation", "digit", "bar", "long_word", "distinct", "top_word",
    "repeat_next", "line_repeat", "log_line", "sentence_end", "non_ascii",
]
SHRINK_SHARED, SHRINK_DIAGONAL, RIDGE = 0.1, 0.05, 1e-4
PUNCTUATION = ".,;:'\"()-?"


def logit(part: float, whole: float, prior: float) -> float:
    """Log odds of a share, drawn towards a usual one so that short texts stay near it."""
    a, b = part + 20 * prior, whole - part + 20 * (1 - prior)
    return float(np.log(a / b))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; an empty or null one has the priors' values."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    counted, upper, lower, digits, spaces = Counter(text), 0, 0, 0, 0
    marks, bars, others = 0, counted.get("|", 0), 0
    for c, k in counted.items():
        if c.isalpha():
            upper, lower = (upper + k, lower) if c.isupper() else (upper, lower + k)
        elif c.isdigit():
            digits += k
        elif c.isspace():
            spaces += k
        elif c in PUNCTUATION:
            marks += k
        else:
            others += k
    seen = Counter(words)
    most = max(seen.values(), default=0)
    repeats = sum(map(str.__eq__, words, words[1:]))
    ended = sum(x.rstrip()[-1] in ".!?" for x in lines)
    extra = len(lines) - len(set(lines))
    solid = chars - spaces
    return [
        np.log1p(n), np.log((solid + 5) / (n + 1)), logit(upper, upper + lower, 0.03), logit(others - bars, solid, 0.002),
        logit(marks, solid, 0.03), logit(digits, solid, 0.01), logit(bars, n, 0.002), logit(sum(k for w, k in seen.items() if len(w) > 15), n, 0.01),
        logit(len(seen) / n**0.85 if n else 0.9, 1.5, 0.6) if n else logit(0.9, 1.5, 0.6), logit(most, n, 0.06), logit(repeats, n, 0.005),
        logit(extra, len(lines), 0.02), np.log((n + 20) / (len(lines) + 1)), logit(ended, len(lines), 0.9), logit(chars - len(text.encode("ascii", "ignore")), solid, 0.02),
    ]


def statistics_column(text_col: str) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.clip(statistics(t), -20, 20) for t in texts], dtype=object)

    return of(text_col)


@dataclass
class Discriminant:
    """Class means and Cholesky factors, kept so that scoring solves triangles only."""

    means: np.ndarray  # class x statistic
    factors: np.ndarray  # inverse Cholesky factors, class x statistic x statistic
    constants: np.ndarray  # log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of the log densities (Mahalanobis)."""
        logs = np.stack([c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant | None:
    """From each class's count, sums and sums of products. None unless both classes have rows."""
    if n.min() < 1:
        return None
    d = sums.shape[1]
    means = sums / n[:, None]
    covs = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    shared = (covs * n[:, None, None]).sum(0) / n.sum()
    factors, constants = np.empty_like(covs), np.empty(2)
    for c in range(2):
        weight = min(1.0, SHRINK_SHARED + d / n[c])  # a class with few rows leans on the shared covariance
        cov = (1 - weight) * covs[c] + weight * shared
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors[c] = np.linalg.inv(low)
        constants[c] = np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum()
    return Discriminant(means, factors, constants)


def fit(measured: DataFrame) -> Discriminant | None:
    """From all rows of (x array<double>, y int in 0, 1): each partition sends one row of sums a class."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(STATISTICS)
        n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for part in batches:
            x, y = np.array(part["x"].tolist(), float).reshape(len(part), d), part["y"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                sums[c] += own.sum(0)
                products[c] += own.T @ own
        for c in (0, 1):
            values = np.concatenate(([n[c]], sums[c], products[c].ravel()))
            yield pd.DataFrame({"y": c, "i": np.arange(len(values)), "v": values})

    d = len(STATISTICS)
    rows = measured.mapInPandas(gather, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    values = np.zeros((2, 1 + d + d * d))
    for r in rows:
        values[r.y, r.i] = r.v
    return discriminant(values[:, 0], values[:, 1 : 1 + d], values[:, 1 + d :].reshape(2, d, d))


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) with score (probability of class 1) and predicted (1 from threshold on).

    Class means and covariances come from all labelled rows of docs that meet the condition `train`: counts, sums and
    products are added up per partition. Statistics are taken once per whole text and written to the shared folder with
    the columns that are kept, for the fit and the scores. Null and empty texts get a score like any other; labels other than 0 and 1, null ids and
    labels without a document are left out of the fit; a document with several labels counts with each; if a class has
    no rows every score is 0.5. Columns of docs named score or predicted are replaced. Repeated rows score alike.
    """
    keep = docs.columns if keep is None else keep
    ident, learn, x = (unused(docs, c) for c in ("id", "train", "x"))
    measured = docs.select(*keep, F.col(id_col).alias(ident), train.alias(learn), statistics_column(text_col).alias(x))
    measured = cut(measured, "statistics")
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("marked"), F.col(label_col).cast("int").alias("y"))
    model = fit(measured.where(F.col(learn)).select(F.col(ident).alias("id"), F.col(x).alias("x")).join(marks, F.col("id") == F.col("marked")).select("x", "y"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(sent.value.score(np.array(x.tolist(), float).reshape(len(x), -1)) if sent.value and len(x) else np.full(len(x), 0.5))

    out = measured.withColumn("score", of(x)).drop(ident, learn, x)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
