"""Ordering, sampling, allocation and state over rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import unused
from .ordering import running


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, that of the highest order; by aggregation, so a key with many rows is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    return rows.groupBy(*key).agg(best).select(*key, "_row.*").select(*rows.columns)


def moving_average(rows: DataFrame, group: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Mean of the last `width` rows' values, nulls skipped; null where the row's own value is."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("moving_mean", F.when(F.col(value).isNotNull(), F.avg(value).over(w)))


def drifting(rows: DataFrame, group: str, session: str, order: str, value: str, eps: float = 1e-9) -> DataFrame:
    """Per group: whether the session means, in order of first appearance, fall at every step; false under two."""
    s = rows.groupBy(group, session).agg(F.avg(value).alias("m"), F.min(order).alias("first"))
    step = F.col("m") - F.lag("m").over(Window.partitionBy(group).orderBy("first", session))
    return s.withColumn("step", step).groupBy(group).agg((F.coalesce(F.every(F.when(F.col("step").isNotNull(), F.col("step") < -eps)), F.lit(False)) & (F.count("*") >= 2)).alias("drift"), F.count("*").alias("sessions"))


def hash_sample(rows: DataFrame, group: list[str], key: list[str], n: int, seed: str) -> DataFrame:
    """n rows of each group, first in the order of SHA-256 of seed and key: the same on every run."""
    h = unused(rows, "h")
    rows = rows.withColumn(h, F.sha2(F.concat_ws("\x1f", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256))
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy(h, *key))).where(F.col("pick") <= n).drop(h)


def largest_remainder(strata: DataFrame, name: str, size: str, total: int) -> DataFrame:
    """Seats by share of size: whole parts, then leftovers in turn to the largest remainders (ties by name) that have room.

    No stratum gets more than its size; a total beyond all sizes fills them. Strata are a bounded list (one row each), so
    their ranking is a single window over them.
    """
    exact, whole, room, left, turn_, nth, more_, of = (unused(strata, c) for c in ("exact", "whole", "room", "left", "turn", "nth", "more", "of"))
    every = Window.partitionBy()
    all_ = F.sum(size).over(every)
    out = strata.withColumn(exact, F.coalesce(F.try_divide(F.col(size) * F.least(F.lit(total), all_), all_), F.lit(0.0)).cast("double"))
    out = out.withColumn(whole, F.least(F.floor(F.round(exact, 9)), F.col(size)).cast("long")).withColumn(room, F.col(size) - F.col(whole))
    out = out.withColumn(left, F.least(F.lit(total), all_) - F.sum(whole).over(every))
    turn = Window.orderBy(turn_, F.desc(F.round(F.col(exact) - F.floor(F.round(exact, 9)), 9)), name)
    turns = out.where((F.col(room) > 0) & (F.col(left) > 0)).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col(room), F.col(left)))).alias(turn_))
    more = turns.withColumn(nth, F.row_number().over(turn)).where(F.col(nth) <= F.col(left)).groupBy(F.col(name).alias(of)).agg(F.count("*").alias(more_))
    out = out.join(more, F.col(name) == F.col(of), "left")
    return out.withColumn("seats", (F.col(whole) + F.coalesce(more_, F.lit(0))).cast("long")).select(*[c for c in strata.columns if c != "seats"], "seats")


def hold_out(rows: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """rows with held_out: round(n x share) of each stratum, one at least and not all, by the order of a hash of the key.

    Rows are placed by running counts over ranges, so a stratum with most rows is no single task.
    """
    h, nth, size = (unused(rows, c) for c in ("h", "nth", "size"))
    hashed = rows.withColumn(h, F.concat(F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(key).cast("string")), 256), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    placed = running(hashed, [stratum], [h], nth, total=size)
    take = F.least(F.greatest(F.bround(F.col(size) * F.lit(share)), F.lit(1)), F.col(size) - 1)
    return placed.withColumn("held_out", F.col(nth) < take).select(*[c for c in rows.columns if c != "held_out"], "held_out")


def round_robin(rows: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """n rows taken in turn from the strata: everyone's first, then everyone's second. At most n of each are looked at."""
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("turn", nth).where(F.col("turn") <= n).orderBy("turn", stratum, *order).limit(n)


def canonical(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows sorted by all of order, so that equal inputs print alike."""
    return rows.orderBy(*order)


def stops(rows: DataFrame, group: str, order: list[str], value: str, limit: int) -> DataFrame:
    """Per group: the place (from 0) of the row that ends the first losing streak of `limit` rows, null if none does."""
    streaks = losing_streaks(rows, group, order, value)
    at, place = unused(streaks, "at"), F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return streaks.withColumn(at, place).groupBy(group).agg(F.min(F.when(F.col("streak") >= limit, F.col(at))).cast("long").alias("stop_at"))


def representative(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, that of the lowest order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def losing_streaks(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """rows with streak: how many in a row, ending here, did not beat the best before them."""
    w = Window.partitionBy(group).orderBy(*order)
    flag, island = unused(rows, "better"), unused(rows, "island")
    better = F.coalesce(F.col(value) > F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    out = rows.withColumn(flag, better.cast("int")).withColumn(island, F.sum(flag).over(w))
    return out.withColumn("streak", (F.row_number().over(Window.partitionBy(group, island).orderBy(*order)) - 1).cast("long")).drop(flag, island)


def collapse(rows: DataFrame, levels: list[list[str]], item: str, least: int) -> DataFrame:
    """(item, level, stratum): the finest level whose group has `least` items; what is left goes to the coarsest."""
    left, out = rows, None
    for i, keys in enumerate(levels):
        named = left.withColumn("stratum", F.concat_ws("\x1f", F.lit(str(i)), *[F.col(k).cast("string") for k in keys]))
        if i < len(levels) - 1:
            big = named.groupBy("stratum").agg(F.count_distinct(item).alias("n")).where(F.col("n") >= least).select("stratum")
            here, left = named.join(big, "stratum", "left_semi"), named.join(big, "stratum", "left_anti").drop("stratum")
        else:
            here = named
        here = here.select(item, F.lit(i).alias("level"), "stratum")
        out = here if out is None else out.unionByName(here)
    return out
