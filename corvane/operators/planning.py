"""Deciding what to run next: repeats, rungs, promotions, tournaments. Inputs are short lists of strata or variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import unused
from .ordering import running
from .selection import round_robin


def rungs(strata: DataFrame, name: str, size: str, total: int) -> DataFrame:
    """strata with seats: one each as far as total goes, the rest by spare size, leftovers to the largest spare sizes.

    A larger total never takes a seat away from the first ones. One row a stratum.
    """
    every = Window.partitionBy()
    out = strata.withColumn("_first", F.row_number().over(Window.orderBy(F.desc(size), name)) <= total)
    out = out.withColumn("_one", F.when(F.col("_first") & (F.col(size) > 0), 1).otherwise(0))
    out = out.withColumn("_spare", F.col(size) - F.col("_one")).withColumn("_left", F.greatest(F.least(F.lit(total), F.sum(size).over(every)) - F.sum("_one").over(every), F.lit(0)))
    out = out.withColumn("_part", F.floor(F.coalesce(F.try_divide(F.col("_left") * F.col("_spare"), F.sum("_spare").over(every)), F.lit(0.0))).cast("long"))
    out = out.withColumn("_rest", F.col("_left") - F.sum("_part").over(every)).withColumn("_nth", F.row_number().over(Window.orderBy(F.desc(F.col("_spare") - F.col("_part")), name)))
    more = F.when((F.col("_nth") <= F.col("_rest")) & (F.col("_part") < F.col("_spare")), 1).otherwise(0)
    return out.withColumn("seats", (F.col("_one") + F.col("_part") + more).cast("long")).select(*strata.columns, "seats")


def strides(n: int, axis: dict[str, int]) -> list[Column]:
    """Coordinates of batch number `id` on each axis: steps coprime to the axis's length visit every value."""
    from math import gcd

    out = []
    for i, (name, size) in enumerate(axis.items()):
        step = next(s for s in range(max(1, (i + 1) * size // (len(axis) + 1)), size + n + 2) if gcd(s, size) == 1)
        out.append(F.pmod(F.col("id") * step + i, F.lit(size)).cast("long").alias(name))
    return out


def sized_strata(components: DataFrame, half_width: float, budget: int, z: float = 1.96, least: int = 2, most: int = 50, multi: Column | None = None) -> DataFrame:
    """Components per stratum (n_items, between, within) with reps, scaled down together where they exceed the budget, to no
    fewer than `least`. Before that, strata of several turns (multi) get no fewer than any of a single turn. One row a stratum."""
    room = F.lit(half_width**2 / z**2) - F.col("between") / F.col("n_items")
    need = F.when(room > 0, F.ceil(F.col("within") / (F.col("n_items") * F.when(room > 0, room))))
    out = components.withColumn("needed", F.least(F.greatest(F.coalesce(need, F.lit(most)), F.lit(least)), F.lit(most)).cast("long"))
    if multi is not None:
        single = F.coalesce(F.max(F.when(~multi, F.col("needed"))).over(Window.partitionBy()), F.lit(0))
        out = out.withColumn("needed", F.when(multi, F.greatest("needed", single)).otherwise(F.col("needed")).cast("long"))
    trials = F.sum(F.col("needed") * F.col("n_items")).over(Window.partitionBy())
    scaled = F.greatest(F.floor(F.col("needed") * F.lit(float(budget)) / trials), F.lit(least)).cast("long")
    return out.withColumn("reps", F.when(trials > budget, scaled).otherwise(F.col("needed")))


def promotion(champion: Column, challenger: Column, threshold: float, usable: Column) -> Column:
    """Whether a challenger takes the champion's place: it is usable and better by at least the threshold. Nothing else
    decides; a null score or a null usable does not promote."""
    return F.coalesce(usable & (challenger - champion >= threshold), F.lit(False))


def escalates(score: Column, prior: Column, half_width: Column, improved: Column, slack: float = 1.0) -> Column:
    """Whether a champion goes to the next rung: there was a promotion at this one, and its score is no more than `slack` half
    widths below that of the rung before; a null prior (the first rung) asks for the promotion only."""
    return F.coalesce(improved & (prior.isNull() | (score >= prior - slack * half_width)), F.lit(False))


def tournament(variants: DataFrame, variant: str, score: str, half_width: str, threshold: float) -> DataFrame:
    """The winner, a row with tie: by score, then the smaller half width, then the smaller variant; tie if it is not ahead of
    the next by the threshold. Variants without a score take no part. Only the best two are compared."""
    best = variants.where(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc_nulls_last(half_width), variant).limit(2)
    two = best.agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(half_width).alias("h"), F.col(variant).alias("v")))).alias("l")).where(F.size("l") > 0)
    first, second = F.col("l")[0], F.get("l", F.lit(1))
    # a null half width sorts first in an array and last above: of equal scores the row with one is taken
    swap = second.isNotNull() & (first["s"] == second["s"]) & first["h"].isNull() & second["h"].isNotNull()
    won = F.when(swap, second).otherwise(first)
    return two.select(won["v"].alias(variant), (-won["s"]).alias(score), won["h"].alias(half_width), F.coalesce(second["s"] - first["s"] < threshold, F.lit(False)).alias("tie"))


def ladder(items: DataFrame, stratum: str, order: list[str], totals: list[int]) -> DataFrame:
    """items of the ladder with rung, the first (from 0) that holds them: each rung takes `totals` items in all, shared out by
    rungs, and of each stratum a prefix of its order, so that a rung holds all that the rungs before it hold."""
    sizes = items.groupBy(stratum).agg(F.count("*").alias("size"))
    seats = None
    for i, total in enumerate(totals):
        one = rungs(sizes, stratum, "size", total).select(F.col(stratum).alias("_s"), F.lit(i).alias("_i"), F.col("seats").alias("_n"))
        seats = one if seats is None else seats.unionByName(one)
    seats = seats.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("_i", "_n"))).alias("_l"))  # a rung a row
    nth, most, name = unused(items, "nth"), unused(items, "seats"), unused(items, "stratum")
    held = items.join(seats.select(F.col("_s").alias(name), F.transform("_l", lambda x: x["_n"]).alias(most)), F.col(stratum).eqNullSafe(F.col(name))).drop(name)
    placed = held.withColumn(nth, F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    rung = F.array_position(F.transform(most, lambda n: n >= F.col(nth)), True) - 1
    return placed.withColumn("rung", rung.cast("int")).where("rung >= 0").select(*items.columns, "rung")


def spec_pairs(edges: DataFrame, a: str, b: str, topic_a: str, topic_b: str, personas: list[str]) -> DataFrame:
    """edges with their place (those across topics first, then by ends) and a persona in turn. Ends tell edges apart."""
    across = unused(edges, "across")
    placed = running(edges.withColumn(across, (F.col(topic_a) == F.col(topic_b)).cast("int")), [], [across, a, b], "place").drop(across)
    return placed.withColumn("place", (F.col("place") + 1).cast("int")).withColumn("persona", F.element_at(F.array(*[F.lit(p) for p in personas]), F.pmod(F.col("place") - 1, F.lit(len(personas))) + 1))


def subsample(items: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """The first n items of each stratum. At most n a stratum leave a task."""
    nth = unused(items, "nth")
    return items.withColumn(nth, F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col(nth) <= n).drop(nth)


def _in_pass(items: DataFrame, name: str, reps: Column) -> DataFrame:
    return items.withColumns({"pass": F.lit(name), "reps": reps.cast("long")})


def pilot_plan(items: DataFrame, stratum: str, order: list[str], per_stratum: int, reps: int) -> DataFrame:
    """Items with pass and reps: a subsample, every stratum with the same reps, to measure variances."""
    if reps < 1:
        raise ValueError("a pilot needs at least one repeat")
    return _in_pass(subsample(items, stratum, order, per_stratum), "pilot", F.lit(reps))


def flat_plan(items: DataFrame, reps: int) -> DataFrame:
    """Items with pass and reps: every item in one wide pass, no pilot, no cap."""
    if reps < 1:
        raise ValueError("a flat plan needs at least one repeat")
    return _in_pass(items, "wide", F.lit(reps))


def demo_plan(items: DataFrame, stratum: str, order: list[str], per_stratum: int, most: int, reps_wide: int = 2, reps_deep: int = 3) -> DataFrame:
    """Items with pass and reps: at most `most` of a subsample, taken in turn from the strata so that many are touched; the same
    items wide and deep, so that a model has at most most x (reps_wide + reps_deep) trials."""
    if most < 1:
        raise ValueError("a demo needs at least one item")
    few = round_robin(subsample(items, stratum, order, max(1, min(per_stratum, most))), stratum, order, most).drop("turn")
    return _in_pass(few, "wide", F.lit(reps_wide)).unionByName(_in_pass(few, "deep", F.lit(reps_deep)))


def full_plan(items: DataFrame, stratum: str, order: list[str], per_stratum: int, components: DataFrame, half_width: float, budget: int, **how) -> DataFrame:
    """Items with pass and reps, sized from a pilot's variances (components: stratum, between, within): wide over all items of a
    stratum, deep over its subsample, where fewer items ask for more repeats. Each pass is scaled to the budget by itself;
    strata that the pilot has not measured are left out."""
    few = subsample(items, stratum, order, per_stratum)
    out = None
    for name, rows in (("wide", items), ("deep", few)):
        sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("n_items"))
        sized = sized_strata(components.drop("n_items").join(sizes, F.col(stratum) == F.col("_s")).drop("_s"), half_width, budget, **how)
        reps = sized.select(F.col(stratum).alias("_s"), F.col("reps").alias("_reps"))
        one = _in_pass(rows.join(reps, F.col(stratum) == F.col("_s")), name, F.col("_reps")).select(*items.columns, "pass", "reps")
        out = one if out is None else out.unionByName(one)
    return out


def trials(plan: DataFrame, models: list[str]) -> DataFrame:
    """plan with a row for each model and repeat (rep from 0)."""
    wide = plan.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return wide.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reps") - 1)).alias("rep")).drop("reps")
