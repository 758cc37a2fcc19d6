"""Ranking quality of a list of ids against the set of relevant ids, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _top(ranked: Column, k: int) -> Column:
    return F.slice(ranked, 1, max(k, 0)) if k > 0 else F.slice(ranked, 1, 0)


def _gain(ranked: Column, gold: Column) -> Column:
    """Discounted gain of the hits: sum of 1 / log2(place + 1)."""
    gains = F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)


def precision_at_k(ranked: Column, gold: Column, k: int) -> Column:
    """Hits in the first k places over k, even if the list is shorter; repeats count each; 0 for k <= 0."""
    if k <= 0:
        return F.lit(0.0)
    return F.size(F.filter(_top(ranked, k), lambda x: F.array_contains(gold, x))) / F.lit(float(k))


def recall_at_k(ranked: Column, gold: Column, k: int) -> Column:
    """Distinct relevant ids in the first k places over all distinct relevant ids; 0 if there are none."""
    wanted = F.array_distinct(gold)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(_top(ranked, k), wanted)).cast("double"), F.size(wanted).cast("double")), F.lit(0.0))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    """1 over the place of the first hit in the whole list, 0 without one."""
    places = F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    return F.coalesce(F.lit(1.0) / F.array_min(F.filter(places, lambda p: p.isNotNull())), F.lit(0.0))


def ndcg_at_k(ranked: Column, gold: Column, k: int) -> Column:
    """Binary gain of the first k places over that of an ideal list of min(k, number of relevant ids) hits."""
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.size(F.array_distinct(gold))), F.lit(1))), lambda i: 1.0 / F.log2(i + F.lit(1.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(gold) == 0) | (F.lit(k) <= 0), F.lit(0.0)).otherwise(_gain(_top(ranked, k), gold) / ideal)


def ndcg_of_labels(labels: Column, k: int) -> Column:
    """Gain of the first k relevance labels over that of all labels sorted, 0 if that is 0."""
    def dcg(c: Column) -> Column:
        return F.aggregate(F.transform(F.slice(c, 1, k), lambda x, i: x / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)

    return F.coalesce(F.try_divide(dcg(labels), dcg(F.sort_array(labels, asc=False))), F.lit(0.0))


def average_precision(ranked: Column, gold: Column) -> Column:
    """Mean of the precision at each hit, 0 without one."""
    seen = F.transform(ranked, lambda x: F.array_contains(gold, x).cast("int"))
    parts = F.transform(seen, lambda h, i: h * F.aggregate(F.slice(seen, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) / (i + F.lit(1.0)))
    hits = F.aggregate(seen, F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), hits.cast("double")), F.lit(0.0))


def gold_presence(ranked: Column, gold: Column) -> Column:
    """Whether any relevant id was ranked; null if there is none to find."""
    return F.when(F.size(gold) > 0, F.arrays_overlap(ranked, gold))


def unavailable_if_no_gold(metric: Column, gold: Column) -> Column:
    """The metric, or null where it does not apply, which averages skip."""
    return F.when(F.size(gold) > 0, metric)


def retrieval_class(ranked: Column, gold: Column) -> Column:
    """unanswerable, answerable_not_retrieved or answerable_retrievable."""
    return F.when(F.size(gold) == 0, "unanswerable").when(F.arrays_overlap(ranked, gold), "answerable_retrievable").otherwise("answerable_not_retrieved")


def retrievable_recall_at_k(ranked: Column, gold: Column, k: int) -> Column:
    """Distinct relevant ids in the first k places over those ranked anywhere, 0 if none is."""
    found = F.array_intersect(gold, ranked)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(_top(ranked, k), found)).cast("double"), F.size(found).cast("double")), F.lit(0.0))


def reciprocal_rank_at_k(ranked: Column, gold: Column, k: int) -> Column:
    """1 over the place of the first hit, 0 if that is beyond k."""
    return reciprocal_rank(_top(ranked, k), gold)
