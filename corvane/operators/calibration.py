"""Calibration of raw scores: a logistic curve for each group, fitted over all of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import sigmoid
from ..shared import dropped, unused, written

#: Newton steps at most, and the gradient (a mean over rows) below which a fit has settled.
STEPS, SETTLED = 30, 1e-12


def _beside(rows: DataFrame, told: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of told, a row for each group, nulls being a group as well; without a group told is one row."""
    if not group:
        return rows.crossJoin(told)
    names = {c: unused(rows, f"{c}_{i}") for i, c in enumerate(group)}
    right = told.select(*[F.col(c).alias(names[c]) for c in group], *[c for c in told.columns if c not in group])
    return rows.join(right, [F.col(c).eqNullSafe(F.col(names[c])) for c in group], how).drop(*names.values())


def platt(rows: DataFrame, group: list[str], score: str, label: str, steps: int = STEPS) -> DataFrame:
    """(group, slope, intercept, n, settled): the curve 1 / (1 + exp(-(slope x score + intercept))) of greatest likelihood.

    label is 0 or 1 (or a boolean). Scores are standardised by group, the curve is fitted by Newton steps on two figures,
    and told in the scores' own units. A step is one aggregate over the rows: five sums a group and partition, so a group
    of any size is no single task's work; the figures of all groups are a table that is joined to the rows. Rows with a
    null score or label take no part. A group of one class, or of one score only, gets the identity (1, 0). A group that
    a threshold separates has no greatest likelihood: its slope grows until the steps end or the curve is a step, and
    settled is false.
    """
    x, y, mean, sd, a, b = (unused(rows, c) for c in ("x", "y", "mean", "sd", "a", "b"))
    base = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*group, F.col(score).cast("double").alias(x), F.col(label).cast("int").alias(y))
    # equal scores of a group and class are one row of a weight, which counts in the task before it is sent
    base = written(base.groupBy(*group, x, y).agg(F.count("*").alias("w")), "scores")
    n, sum_x = F.sum("w"), F.sum(F.col("w") * F.col(x))
    groups = base.groupBy(*group).agg(n.alias("n"), (sum_x / n).alias(mean), F.min(y).alias("low"), F.max(y).alias("high"), F.min(x).alias("least"), F.max(x).alias("most"), *[f(F.when(F.col(y) == k, F.col(x))).alias(f"{n}{k}") for k in (0, 1) for f, n in ((F.min, "from"), (F.max, "to"))])
    spread = _beside(base, groups.select(*group, mean), group).groupBy(*group).agg(F.sqrt(F.sum(F.col("w") * F.pow(F.col(x) - F.col(mean), F.lit(2))) / F.sum("w")).alias(sd))
    fits = (F.col("low") != F.col("high")) & (F.col("least") < F.col("most"))
    split = F.coalesce((F.col("to0") <= F.col("from1")) | (F.col("to1") <= F.col("from0")), F.lit(False))
    state = _beside(groups, spread, group).select(*group, "n", mean, sd, fits.alias("fits"), split.alias("split"), F.lit(0.0).alias(a), F.lit(0.0).alias(b), F.lit(float("inf")).alias("slant"))
    state = written(state, "curves")
    still = F.col("fits") & (F.col("slant") > SETTLED)
    for _ in range(steps):
        if state.where(still).isEmpty():
            break
        rows_ = _beside(base, state.where(still).select(*group, mean, sd, a, b), group)
        z = (F.col(x) - F.col(mean)) / F.col(sd)
        p = sigmoid(F.col(a) * z + F.col(b))
        off, bend = F.col("w") * (p - F.col(y)), F.col("w") * p * (1 - p)
        sums = rows_.groupBy(*group).agg(F.sum(off * z).alias("g_a"), F.sum(off).alias("g_b"), F.sum(bend * z * z).alias("h_aa"), F.sum(bend * z).alias("h_ab"), F.sum(bend).alias("h_bb"))
        det = F.col("h_aa") * F.col("h_bb") - F.col("h_ab") * F.col("h_ab")
        move = lambda top: F.coalesce(F.try_divide(top, det), F.lit(0.0))
        da, db = move(F.col("h_bb") * F.col("g_a") - F.col("h_ab") * F.col("g_b")), move(F.col("h_aa") * F.col("g_b") - F.col("h_ab") * F.col("g_a"))
        reach = F.greatest(F.abs(da), F.abs(db), F.lit(4.0)) / 4.0  # no step is longer than 4 spreads
        slant = F.coalesce(F.greatest(F.abs("g_a"), F.abs("g_b")) / F.col("n"), F.col("slant"))
        before, state = state, written(_beside(state, sums, group, "left").select(*group, "n", mean, sd, "fits", "split", (F.col(a) - da / reach).alias(a), (F.col(b) - db / reach).alias(b), slant.alias("slant")), "curves")
        dropped(before)
    dropped(base)
    slope = F.col(a) / F.col(sd)
    return state.select(
        *group, F.when(F.col("fits"), slope).otherwise(1.0).alias("slope"), F.when(F.col("fits"), F.col(b) - slope * F.col(mean)).otherwise(0.0).alias("intercept"),
        "n", (~F.col("fits") | ~F.col("split") & (F.col("slant") <= SETTLED)).alias("settled"),
    )


def calibrated(rows: DataFrame, curves: DataFrame, group: list[str], score: str, into: str = "calibrated") -> DataFrame:
    """rows with the score put through its group's curve; null for a null score or a group without a curve."""
    slope, intercept = unused(rows, "slope"), unused(rows, "intercept")
    told = curves.select(*group, F.col("slope").alias(slope), F.col("intercept").alias(intercept))
    out = _beside(rows, told, group, "left")
    return out.withColumn(into, sigmoid(F.col(slope) * F.col(score) + F.col(intercept))).select(*[c for c in rows.columns if c != into], into)
