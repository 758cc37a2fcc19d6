"""Running totals in an order, of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import unused, written


def running(rows: DataFrame, group: list[str], order: list, into: str, weight: Column | None = None, total: str | None = None) -> DataFrame:
    """rows with `into`: the sum of the weights (1 each without) of the rows before it in its group's order; with `total`, also
    the group's sum.

    Rows are dealt into ranges of group and order, summed range by range, and each range goes on from the ranges before
    it, so a group with most rows is no single task's work; what is put in order whole is a row per group and range. The
    order should tell rows apart: equal rows stay in one range.
    """
    taken = rows.withColumns({c: F.lit(0) for c in (into, total) if c})
    part, own, before, every = (unused(taken, c) for c in ("part", "own", "before", "every"))
    names = {c: unused(taken, f"of_{c}") for c in group}
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn(own, (F.lit(1) if weight is None else weight).cast("double" if weight is not None else "long"))
    dealt = written(keyed.repartitionByRange(n, *[F.col(c) for c in group], *order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*group, part).agg(F.sum(own).alias(own))
    across = Window.partitionBy(*group)
    sums = sums.withColumns({before: F.coalesce(F.sum(own).over(across.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), every: F.sum(own).over(across)})
    told = sums.select(*[F.col(c).alias(names[c]) for c in group], F.col(part).alias(f"{part}_"), before, every)
    inside = F.coalesce(F.sum(own).over(Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn(into, inside).join(told, [F.col(c).eqNullSafe(F.col(names[c])) for c in group] + [F.col(part) == F.col(f"{part}_")])
    out = out.withColumn(into, F.col(into) + F.col(before))
    return out.select(*[c for c in rows.columns if c not in (into, total)], into, *([F.col(every).alias(total)] if total else []))
