"""Statistics of repeated measurements of items: means, variance components, intervals, comparisons of groups."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import unused, written
from .ordering import running


def item_means(rows: DataFrame, group: list[str], item: str, value: str) -> DataFrame:
    """Per group and item: mean, variance (sample) and number of the values that are not null."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group, item).agg(
        F.avg(value).alias("item_mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("item_var"), F.count("*").alias("reps")
    )


def item_equal_mean(rows: DataFrame, group: list[str], item: str, value: str) -> DataFrame:
    """Mean over items of each item's mean, so that items with more repeats weigh no more."""
    return item_means(rows, group, item, value).groupBy(*group).agg(F.avg("item_mean").alias("mean"), F.count("*").alias("n_items"), F.sum("reps").alias("n_trials"))


def variance_components(rows: DataFrame, group: list[str], item: str, value: str) -> DataFrame:
    """Between- and within-item variance by one-way random-effects ANOVA for unequal repeats, floored at 0."""
    means = item_means(rows, group, item, value)
    n, reps = F.count("*"), F.sum("reps")
    sums = means.groupBy(*group).agg(
        n.alias("n_items"), reps.alias("n_trials"), F.avg("item_mean").alias("mean"), (F.sum(F.col("reps") * F.col("item_mean")) / reps).alias("grand"),
        F.sum(F.col("item_var") * (F.col("reps") - 1)).alias("ss_within"), F.sum(F.col("reps") * F.pow("item_mean", F.lit(2))).alias("ss_all"), F.sum(F.pow("reps", F.lit(2))).alias("sq"),
    )
    within = F.coalesce(F.try_divide(F.col("ss_within"), (F.col("n_trials") - F.col("n_items")).cast("double")), F.lit(0.0))
    between_ms = F.try_divide(F.col("ss_all") - F.col("n_trials") * F.pow("grand", F.lit(2)), (F.col("n_items") - 1).cast("double"))
    r0 = F.try_divide(F.col("n_trials") - F.col("sq") / F.col("n_trials"), (F.col("n_items") - 1).cast("double"))
    out = sums.withColumn("within", within).withColumn("between", F.greatest(F.coalesce(F.try_divide(between_ms - within, r0), F.lit(0.0)), F.lit(0.0)))
    return out.select(*group, "n_items", "n_trials", "mean", "between", "within")


def normal_interval(rows: DataFrame, group: list[str], item: str, value: str, level: float = 0.95, least_items: int = 2) -> DataFrame:
    """Normal-approximation interval of the item-equal mean from the variance components; null below least_items."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    c = variance_components(rows, group, item, value)
    half = z * F.sqrt(F.col("between") / F.col("n_items") + F.col("within") / F.col("n_trials"))
    enough = F.col("n_items") >= least_items
    return c.select(*group, "n_items", "mean", F.when(enough, F.col("mean") - half).alias("low"), F.when(enough, F.col("mean") + half).alias("high"), (~enough).alias("insufficient"))


def paired_differences(rows: DataFrame, model: str, item: str, value: str) -> DataFrame:
    """For each pair of models a < b: mean difference of item means over shared items, its normal interval, the winner."""
    means = item_means(rows, [model], item, value)
    a, b = means.select(F.col(model).alias("a"), F.col(item).alias("i"), F.col("item_mean").alias("x")), means.select(F.col(model).alias("b"), F.col(item).alias("j"), F.col("item_mean").alias("y"))
    d = a.join(b, (F.col("i") == F.col("j")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(
        F.count("*").alias("n_items"), F.avg(F.col("x") - F.col("y")).alias("diff"), F.coalesce(F.stddev_samp(F.col("x") - F.col("y")), F.lit(0.0)).alias("sd")
    )
    half = 1.96 * F.col("sd") / F.sqrt("n_items")
    d = d.withColumns({"low": F.col("diff") - half, "high": F.col("diff") + half})
    return d.withColumn("winner", F.when(F.col("low") > 0, F.col("a")).when(F.col("high") < 0, F.col("b"))).drop("sd")


def pareto(points: DataFrame, quality: str, cost: str) -> DataFrame:
    """points with on_front: no other has at least its quality at no more cost and is better in one.

    The best quality at each cost is compared with the running best of lower costs, so no pair of points is formed.
    Points are one per model, a bounded list.
    """
    at, top, before = (unused(points, c) for c in ("cost", "best", "before"))
    best = points.where(F.col(cost).isNotNull()).groupBy(F.col(cost).alias(at)).agg(F.max(quality).alias(top))
    best = best.withColumn(before, F.max(top).over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)))
    front = (F.col(quality) == F.col(top)) & (F.col(before).isNull() | (F.col(quality) > F.col(before)))
    return points.join(best, F.col(cost) == F.col(at), "left").withColumn("on_front", F.coalesce(front, F.lit(False))).drop(at, top, before)


def nearest_ranks(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group sorted[int(share x n)] for each name: share; from running counts of equal values, so no group is gathered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_count"))
    placed = running(counts, group, [value], "_to", F.col("_count"), "_n")
    at = lambda p: F.min(F.when(F.col("_to") + F.col("_count") > F.least(F.floor(F.col("_n") * p), F.col("_n") - 1), F.col(value)))
    return placed.groupBy(*group).agg(*[at(p).alias(n) for n, p in shares.items()])


#: What a question can be: nothing answers it; something does and was found; something does but was not found.
UNANSWERABLE, RETRIEVABLE, NOT_RETRIEVED = "unanswerable", "answerable_retrievable", "answerable_not_retrieved"


def abstention_curve(rows: DataFrame, score: str, kind: str, thresholds: list[float], group: list[str] = ()) -> DataFrame:
    """Per group and threshold, rows whose score is below it being held back: recall (share of unanswerable rows held back),
    false_answer (share of them answered), false_abstain (share of retrievable rows held back).

    Answerable rows whose answer was not found take no part, nor do null scores; a share of nothing is 0. Each row is
    counted once, by how many of the sorted thresholds its score reaches; curves are running sums of those counts.
    """
    steps = sorted(set(thresholds))
    reached = sum(((F.col(score) >= t).cast("int") for t in steps), F.lit(0))
    is_a = lambda k: F.sum((F.col(kind) == k).cast("long"))
    counts = rows.where(F.col(score).isNotNull()).groupBy(*group, reached.alias("k")).agg(is_a(UNANSWERABLE).alias("u"), is_a(RETRIEVABLE).alias("r"))
    listed = counts.groupBy(*group).agg(F.collect_list(F.struct("k", "u", "r")).alias("c"))  # as long as the thresholds
    to = lambda f, at: F.aggregate(F.filter("c", lambda x: x["k"] <= at), F.lit(0).cast("long"), lambda s, x: s + x[f])
    lines = listed.select(*group, "c", F.posexplode(F.array(*[F.lit(float(t)) for t in steps])).alias("i", "threshold"))
    share = lambda x, n: F.coalesce(F.try_divide(x.cast("double"), n.cast("double")), F.lit(0.0))
    n_u, n_r, u, r = to("u", F.lit(len(steps))), to("r", F.lit(len(steps))), to("u", F.col("i")), to("r", F.col("i"))
    return lines.select(*group, "threshold", share(u, n_u).alias("recall"), share(n_u - u, n_u).alias("false_answer"), share(r, n_r).alias("false_abstain"))


def win_rates(verdicts: DataFrame, a: str, b: str, winner: str, models: DataFrame | None = None) -> DataFrame:
    """(model, other, games, rate): wins and half the ties over games, for each ordered pair; a null winner is a tie.

    With models (a column model, a short list) every ordered pair of them has a row, 0.5 where they never met.
    """
    won = lambda me: F.when(F.col(winner).isNull(), 0.5).when(F.col(winner) == F.col(me), 1.0).otherwise(0.0)
    both = verdicts.select(F.col(a).alias("model"), F.col(b).alias("other"), won(a).alias("w")).unionByName(verdicts.select(F.col(b).alias("model"), F.col(a).alias("other"), won(b).alias("w")))
    met = both.groupBy("model", "other").agg(F.count("*").alias("games"), F.avg("w").alias("rate"))
    if models is None:
        return met
    names = models.select("model").distinct()
    grid = names.crossJoin(F.broadcast(names.withColumnRenamed("model", "other"))).where("model <> other")  # models squared
    return grid.join(met, ["model", "other"], "left").na.fill({"games": 0, "rate": 0.5})


def pooled_scores(rates: DataFrame) -> DataFrame:
    """(model, games, score): wins and half the ties over all games of a model against everyone; 0.5 without games."""
    score = F.coalesce(F.try_divide(F.sum(F.col("rate") * F.col("games")), F.sum("games").cast("double")), F.lit(0.5))
    return rates.groupBy("model").agg(F.sum("games").alias("games"), score.alias("score"))


def agreement(rows: DataFrame, group: list[str], x: str, y: str, least: float = 0.6) -> DataFrame:
    """Spearman (average ranks), Pearson, mean absolute difference; null correlations for constants or under two rows; low
    where Spearman is null or under `least`.

    Ranks come from counts of equal values, summed in order, so ties of any size are one row.
    """
    base = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, *dict.fromkeys([x, y]))
    for c in (x, y):
        ranks = running(base.groupBy(*group, c).agg(F.count("*").alias("_count")), group, [c], "_before", F.col("_count"))
        ranks = ranks.select(*group, c, (F.col("_before") + (F.col("_count") + 1) / 2).alias(f"_r{c}"))
        base = base.join(ranks, [*group, c])

    def corr(a: str, b: str) -> Column:
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return base.groupBy(*group).agg(F.count("*").alias("n"), corr(f"_r{x}", f"_r{y}").alias("spearman"), corr(x, y).alias("pearson"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mae")).withColumn("low", F.coalesce(F.col("spearman") < least, F.lit(True)))


def trend(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def high_variance_items(rows: DataFrame, group: list[str], item: str, value: str, limit: float, least: int = 2) -> DataFrame:
    return rows.groupBy(*group, item).agg(F.stddev_samp(value).alias("sd"), F.count(value).alias("reps")).where((F.col("reps") >= least) & (F.col("sd") > limit))


def distribution(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean and exact interpolated percentiles of the finite values."""
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    return ok.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *[F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95)])


def required_reps(components: DataFrame, half_width: float, z: float = 1.96, least: int = 2, most: int = 50) -> DataFrame:
    """Repeats per item that bring the interval to half_width, clamped, and whether that cannot be reached."""
    room = F.lit(half_width**2 / z**2) - F.col("between") / F.col("n_items")
    need = F.when(room > 0, F.ceil(F.col("within") / (F.col("n_items") * room)))
    return components.withColumn("reps", F.least(F.greatest(F.coalesce(need, F.lit(most)), F.lit(least)), F.lit(most)).cast("long")).withColumn("unreachable", room <= 0)


def operating_point(curve: DataFrame, ceiling: float, group: list[str] = ()) -> DataFrame:
    """Per group the point of the highest recall with false answers within the ceiling, the lowest threshold among equals;
    zeros where none is within it."""
    names = ("threshold", "recall", "false_answer", "false_abstain")
    within = F.col("false_answer") <= ceiling
    best = F.max_by(F.struct(*names), F.when(within, F.struct("recall", -F.col("threshold"))))
    one = curve.groupBy(*group).agg(F.when(F.bool_or(within), best).alias("b"))
    return one.select(*group, *[F.coalesce(f"b.{c}", F.lit(0.0)).alias(c) for c in names])


def merge_orders(verdicts: DataFrame, pair: list[str], winner: str, confidence: str) -> DataFrame:
    """Verdicts of one pair judged in both orders: the winner if they agree, else a tie (null); mean confidence."""
    return verdicts.groupBy(*pair).agg(F.when((F.count(winner) == F.count("*")) & (F.min(winner) == F.max(winner)), F.min(winner)).alias("winner"), F.avg(confidence).alias("confidence"), F.count("*").alias("orders"))


def first_choice_disagreement(choices: DataFrame, model: str, item: str, choice: str) -> DataFrame:
    """For each pair of models a < b: share of shared items on which their choices differ."""
    x = choices.select(F.col(model).alias("a"), F.col(item).alias("i"), F.col(choice).alias("p"))
    y = choices.select(F.col(model).alias("b"), F.col(item).alias("j"), F.col(choice).alias("q"))
    return x.join(y, (F.col("i") == F.col("j")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("p") != F.col("q")).cast("double")).alias("disagreement"))


def score_separation(scored: DataFrame, group: str, score: str) -> DataFrame:
    """Per group: its best score less the mean of the others, and less the second. Null for a single row."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score)))
    rows = scored.withColumn("_nth", nth)
    best, second = F.max(F.when(F.col("_nth") == 1, F.col(score))), F.max(F.when(F.col("_nth") == 2, F.col(score)))
    return rows.groupBy(group).agg((best - F.avg(F.when(F.col("_nth") > 1, F.col(score)))).alias("top_to_rest"), (best - second).alias("top_to_second"))


def inversions_in_run():
    """A function for the weight of a run's pairs of points (x, y, n) of which one has the smaller x and the larger y: a pass
    for each bit of y's rank. It is made here so that workers need nothing but numpy and pandas."""

    def count(points: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((points["y"], points["x"]))  # of equal x the smaller y first, so that those never count
        rank = np.unique(points["y"].to_numpy()[order], return_inverse=True)[1]
        n = points["n"].to_numpy(float)[order]
        total = 0.0
        for bit in range(int(rank.max()).bit_length()):
            at = np.argsort(rank >> (bit + 1), kind="stable")
            high = (rank[at] >> bit) & 1
            before = np.cumsum(n[at] * high)
            block = rank[at] >> (bit + 1)
            start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            base = np.repeat(np.r_[0.0, before[start[1:] - 1]], np.diff(np.r_[start, len(block)]))
            total += float(np.sum(n[at] * (1 - high) * (before - base)))
        return pd.DataFrame({"near": [total]})

    return count


def discordance(rows: DataFrame, x: str, y: str, run: int = 200_000) -> DataFrame:
    """Share of pairs of rows that two scores order oppositely, and the number of pairs; ties are not discordant.

    Equal points are one, of a weight. Each score's range is cut at quantiles into runs of about `run` points, a value
    that is a cut being a run of its own, in which nothing can be discordant. Pairs in different runs of both scores are
    counted from the table of cells by prefix sums; those within one run of x, and those within one run of y across runs
    of x, are counted inside the run, in n log n. No pair is a row. Nulls take no part.
    """
    points = written(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n")), "points")
    runs = max(2, -(-points.count() // run))
    shares = [i / runs for i in range(1, runs)]
    cuts = points.agg(F.percentile_approx("x", shares, 10 * runs).alias("cx"), F.percentile_approx("y", shares, 10 * runs).alias("cy"))
    # below, at or above each cut: even numbers are the stretches between cuts, odd ones the cuts themselves
    run_of = lambda c, v: F.size(F.filter(F.array_distinct(c), lambda k: k < v)) * 2 + F.array_contains(c, v).cast("int")
    placed = points.crossJoin(F.broadcast(cuts)).select("x", "y", "n", run_of(F.col("cx"), F.col("x")).alias("rx"), run_of(F.col("cy"), F.col("y")).alias("ry"))  # one row of cuts
    cells = placed.groupBy("rx", "ry").agg(F.sum("n").cast("double").alias("n"))
    grid = cells.select("rx").distinct().crossJoin(cells.select("ry").distinct())  # at most (2 runs) squared cells
    full = grid.join(cells, ["rx", "ry"], "left").na.fill(0.0, ["n"])
    left = F.coalesce(F.sum("n").over(Window.partitionBy("ry").orderBy("rx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.coalesce(F.sum("left").over(Window.partitionBy("rx").orderBy(F.desc("ry")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    far = full.withColumn("left", left).withColumn("above", above).agg(F.coalesce(F.sum(F.col("n") * F.col("above")), F.lit(0.0)).alias("far"))
    count = inversions_in_run()
    in_x = placed.where("rx % 2 = 0").groupBy("rx").applyInPandas(count, "near double")
    in_y = placed.where("ry % 2 = 0").groupBy("ry", F.col("rx").cast("double").alias("x"), "y").agg(F.sum("n").alias("n")).groupBy("ry").applyInPandas(count, "near double")
    near = in_x.unionByName(in_y).agg(F.coalesce(F.sum("near"), F.lit(0.0)).alias("near"))
    total = points.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    pairs = (F.col("rows") * (F.col("rows") - 1) / 2).cast("long")
    return total.crossJoin(far).crossJoin(near).select(pairs.alias("pairs"), F.coalesce(F.try_divide(F.col("far") + F.col("near"), pairs.cast("double")), F.lit(0.0)).alias("divergence"))  # single rows
