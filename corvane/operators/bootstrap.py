"""Bootstrap of means of items that have repeats: exact resamples, drawn piece by piece over the partitions.

A resample draws as many items as there are, and for each drawn item as many of its repeats as it has. How often an item
is drawn follows a multinomial law over the items, which a tree splits: the draws of a node fall to its left half by a
binomial law. Items are dealt by hash to leaves of about LEAF; whoever works on a leaf walks down from the root with
generators seeded by the nodes, so all leaves agree on one resample without hearing of each other. An item's own draws
are split over the pieces of its histogram of values in the same way.

Items whose repeats are all of one value give that value whichever of them is drawn. They are counted by value, and their
draws fall to the values by the same law; a binomial law first splits a resample between them and the other items.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dropped, written
from .statistics import item_equal_mean, item_means

#: Items, or values of single-valued items, that a leaf holds on average; different values of one item that a piece of its histogram holds; repeats of an item
#: up to which they are drawn one by one, which gives the same law.
LEAF, PIECE, FEW = 512, 4096, 1024


def _levels(n, size: int):
    """How often a hash is halved for pieces of about `size`."""
    return F.greatest(F.ceil(F.log2(n.cast("double") / F.lit(float(size)))), F.lit(0)).cast("int")


def _path(rows: DataFrame, key: list[str], leaf: str, depth: str, deepest: int, size: str, name: str) -> DataFrame:
    """rows with the sizes of the nodes from the root to the row's leaf; one row a leaf, hence few."""
    at = [F.sum(size).over(Window.partitionBy(*key, F.expr(f"shiftright({leaf}, greatest({depth} - {d}, 0))"))) for d in range(deepest + 1)]
    return rows.withColumn(name, F.array(*at))


def bootstrap_draws(rows: DataFrame, group: list[str], item: str, value: str, draws: int, seed: int) -> DataFrame:
    """(group, draw, m): item-equal means of a two-stage resample, items first, then each item's own repeats.

    Nulls are skipped. A partition adds up `draws` sums of its own leaves and only those are combined; neither a group
    nor an item is held whole.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    own = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(group, keys)], F.col(item).alias("_i"), F.col(value).cast("double").alias("_v"))
    counts = written(own.groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_w")), "counts")
    many = F.col("_kinds") > 1
    units = counts.groupBy(*keys, "_i").agg(F.sum("_w").alias("_n"), F.count("*").alias("_kinds"), F.min("_v").alias("_one"))
    units = units.select(*keys, many.alias("_many"), F.when(many, F.col("_i")).alias("_i"), F.when(~many, F.col("_one")).alias("_one"), "_n", "_kinds")
    units = units.groupBy(*keys, "_many", "_i", "_one").agg(F.count("*").alias("_m"), F.max("_n").alias("_n"), F.max("_kinds").alias("_kinds"))
    units = written(units.withColumn("_gh", F.xxhash64(F.lit(seed), *keys)), "units")
    of = lambda x, yes: F.coalesce(F.sum(F.when(F.col("_many") == yes, x)), F.lit(0))
    groups = units.groupBy("_gh", *keys).agg(of(F.col("_m"), True).alias("_items"), of(F.col("_m"), False).alias("_alike"), of(F.lit(1), False).alias("_values"))
    told = groups.select(F.col("_gh").alias("_gh2"), "_items", "_alike", _levels(F.col("_items"), LEAF).alias("_depth"), _levels(F.col("_values"), LEAF).alias("_depth2"))
    dealt = units.join(told, F.col("_gh") == F.col("_gh2")).drop("_gh2")
    items = dealt.where("_many").withColumns({"_h": F.xxhash64(F.lit(seed), *keys, "_i"), "_cuts": _levels(F.col("_kinds"), PIECE)})
    items = items.withColumn("_leaf", F.expr("_h & (shiftleft(1L, _depth) - 1)"))
    alike = dealt.where("NOT _many").withColumn("_leaf", F.expr(f"xxhash64({seed}L, _one) & (shiftleft(1L, _depth2) - 1)"))
    inside = Window.partitionBy("_gh", "_leaf")
    items = written(items.withColumns({"_at": F.row_number().over(inside.orderBy("_h", "_i")) - 1, "_in": F.count("*").over(inside)}).drop("_many", "_one", "_m", "_kinds", "_depth2"), "items")
    depth, cuts = items.agg(F.coalesce(F.max("_depth"), F.lit(0)), F.coalesce(F.max("_cuts"), F.lit(0))).first()
    leaves = _path(items.groupBy("_gh", "_leaf", "_depth").agg(F.count("*").alias("_size")), ["_gh"], "_leaf", "_depth", depth, "_size", "_sizes")
    items = items.join(leaves.select(F.col("_gh").alias("_gh2"), F.col("_leaf").alias("_leaf2"), "_sizes"), (F.col("_gh") == F.col("_gh2")) & (F.col("_leaf") == F.col("_leaf2"))).drop("_gh2", "_leaf2")
    cut = items.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_i").alias("_i_"), "_cuts")
    pieces = counts.join(cut, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] + [F.col("_i").eqNullSafe(F.col("_i_"))])
    pieces = pieces.withColumn("_piece", F.expr("xxhash64(_v) & (shiftleft(1L, _cuts) - 1)"))
    pieces = pieces.groupBy(*keys, "_i", "_piece", "_cuts").agg(F.array_sort(F.collect_list(F.struct("_v", "_w"))).alias("_values"), F.sum("_w").alias("_size"))
    pieces = _path(pieces, [*keys, "_i"], "_piece", "_cuts", cuts, "_size", "_parts")
    pieces = pieces.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_i").alias("_i_"), "_piece", F.transform("_values", lambda x: x["_v"]).alias("_values"), F.transform("_values", lambda x: x["_w"]).alias("_counts"), "_parts", F.col("_cuts").alias("_cuts_"))
    work = items.drop("_cuts").join(pieces, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] + [F.col("_i").eqNullSafe(F.col("_i_"))])
    work = work.select("_gh", "_items", "_alike", "_leaf", "_depth", "_sizes", "_at", "_in", "_n", "_h", "_piece", "_cuts_", "_parts", "_values", "_counts")
    alike = alike.groupBy("_gh", "_items", "_alike", "_leaf", F.col("_depth2").alias("_depth")).agg(F.array_sort(F.collect_list(F.struct("_one", "_m"))).alias("_values"), F.sum("_m").alias("_size"))
    deepest = groups.agg(F.coalesce(F.max(_levels(F.col("_values"), LEAF)), F.lit(0))).first()[0]
    alike = _path(alike, ["_gh"], "_leaf", "_depth", deepest, "_size", "_sizes")
    zero = lambda kind: F.lit(0).cast(kind)
    alike = alike.select(
        "_gh", "_items", "_alike", "_leaf", "_depth", "_sizes", F.lit(-1).alias("_at"), zero("long").alias("_in"), zero("long").alias("_n"), zero("long").alias("_h"), zero("long").alias("_piece"), zero("int").alias("_cuts_"),
        F.array().cast("array<long>").alias("_parts"), F.transform("_values", lambda x: x["_one"]).alias("_values"), F.transform("_values", lambda x: x["_m"]).alias("_counts"))
    work = work.unionByName(alike).repartition("_gh", "_leaf", "_piece").sortWithinPartitions("_gh", "_leaf", "_at")

    few = FEW

    def gather(batches):
        def generator(*path):
            return np.random.default_rng([int(x) & 0xFFFFFFFFFFFFFFFF for x in (seed, *path)])

        def walked(n, sizes, leaf, depth, *tag):
            """How many of n draws (an array) reach the leaf."""
            for d in range(depth):
                node, bit = leaf >> (depth - d), (leaf >> (depth - d - 1)) & 1
                left = sizes[d] - sizes[d + 1] if bit else sizes[d + 1]
                gone = generator(*tag, d, node).binomial(n, left / sizes[d])
                n = n - gone if bit else gone
            return n

        def split(gh, alike, others):
            """How many of a resample's draws fall to single-valued items."""
            return generator(gh, 1 << 44).binomial(np.full(draws, alike + others), alike / (alike + others))

        held, known, times = {}, None, None
        for part in batches:
            for r in part.itertuples(index=False, name=None):
                gh, others, alike, leaf, depth, sizes, at, inside, n, h, piece, cuts, parts, values, counts = r
                sums = held.setdefault(gh, np.zeros(draws))
                if at < 0:  # values of single-valued items
                    drawn = walked(split(gh, alike, others), sizes, leaf, depth, gh, 1 << 42)
                    weights = np.asarray(counts, float)
                    sums += generator(gh, leaf, 1 << 43).multinomial(drawn, weights / weights.sum()) @ np.asarray(values, float)
                    continue
                if known != (gh, leaf):
                    drawn = walked(alike + others - split(gh, alike, others), sizes, leaf, depth, gh)
                    times, known = generator(gh, leaf, 1 << 40).multinomial(drawn, np.full(inside, 1 / inside)), (gh, leaf)
                mine = times[:, at]
                weights = np.asarray(counts, float)
                if cuts == 0 and n <= few:  # one draw after the other costs less than a multinomial of each resample
                    drawn = np.flatnonzero(mine)
                    ends = np.cumsum(mine[drawn] * n)
                    if len(ends):
                        picks = np.repeat(np.asarray(values, float), weights.astype(int))[generator(h, piece, 1 << 41).integers(0, n, ends[-1])]
                        sums[drawn] += np.add.reduceat(picks, np.r_[0, ends[:-1]]) / n
                    continue
                here = walked(mine * n, parts, piece, cuts, h)
                sums += generator(h, piece, 1 << 41).multinomial(here, weights / weights.sum()) @ np.asarray(values, float) / n
        for gh, sums in held.items():
            yield pd.DataFrame({"_gh": gh, "draw": np.arange(draws), "x": sums})

    drawn = work.mapInPandas(gather, "_gh long, draw int, x double").groupBy("_gh", "draw").agg(F.sum("x").alias("x"))
    names = groups.select(*[F.col(k).alias(c) for c, k in zip(group, keys)], F.col("_gh").alias("_gh2"), (F.col("_items") + F.col("_alike")).alias("_all"))
    out = written(drawn.join(names, F.col("_gh") == F.col("_gh2")).select(*group, "draw", (F.col("x") / F.col("_all")).alias("m")), "means")
    for done in (counts, units, items):
        dropped(done)
    return out


def bootstrap_interval(rows: DataFrame, group: list[str], item: str, value: str, draws: int = 2000, level: float = 0.95, seed: int = 1729) -> DataFrame:
    """Percentile interval of the item-equal mean by bootstrap_draws, with the mean itself and the number of items."""
    tail = (1 - level) / 2
    drawn = bootstrap_draws(rows, group, item, value, draws, seed)
    told = drawn.groupBy(*group).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    points = item_equal_mean(rows, group, item, value).select(*group, "mean", "n_items")
    if not group:
        return told.crossJoin(points)  # two single rows
    named = points.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(group)], "mean", "n_items")
    return told.join(named, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(group)]).select(*group, "low", "high", "mean", "n_items")


def mean_bootstrap(rows: DataFrame, group: list[str], key: str, value: str, draws: int = 2000, seed: int = 1729) -> DataFrame:
    """Percentile bootstrap of a mean over keys: the draws at places int(draws x 0.025) and int(draws x 0.975), from 0."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("m", "draw")) - 1  # `draws` rows a group
    drawn = bootstrap_draws(rows, group, key, value, draws, seed).withColumn("nth", nth)
    at = lambda p: F.max(F.when(F.col("nth") == int(draws * p), F.col("m")))
    return drawn.groupBy(*group).agg(at(0.025).alias("low"), at(0.975).alias("high"))


def difference_bootstrap(rows: DataFrame, group: list[str], item: str, value: str, draws: int = 2000, seed: int = 1729) -> DataFrame:
    """Per group of differences: their mean, its percentile interval, and the two-sided p-value: the share of resamples whose
    mean lies as far from the observed one as that does from 0."""
    observed = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(group)]).agg(F.avg(value).alias("diff"), F.count("*").alias("n_items"))
    drawn = bootstrap_draws(rows, group, item, value, draws, seed).join(observed, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(group)])
    at = lambda p: F.percentile("m", F.lit(p))
    return drawn.groupBy(*group, "diff", "n_items").agg(
        F.avg((F.abs(F.col("m") - F.col("diff")) >= F.abs("diff") * F.lit(1 - 1e-12)).cast("double")).alias("p_value"), at(0.025).alias("low"), at(0.975).alias("high"))


def paired_bootstrap(rows: DataFrame, model: str, item: str, value: str, draws: int = 2000, seed: int = 1729) -> DataFrame:
    """For each pair of models a < b: difference_bootstrap of their item means over shared items."""
    means = item_means(rows, [model], item, value)
    a, b = means.select(F.col(model).alias("a"), F.col(item).alias("i"), F.col("item_mean").alias("x")), means.select(F.col(model).alias("b"), F.col(item).alias("j"), F.col("item_mean").alias("y"))
    pairs = a.join(b, (F.col("i") == F.col("j")) & (F.col("a") < F.col("b"))).select("a", "b", "i", (F.col("x") - F.col("y")).alias("d"))
    return difference_bootstrap(pairs, ["a", "b"], "i", "d", draws, seed)
