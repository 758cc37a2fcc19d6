"""Edges between rows whose sets of tokens are alike."""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dropped, written

#: Tokens up to which a set is small: it meets others in its subsets, at most some dozens.
SMALL = 6


def token_classes(rows: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(class_id, id, tokens): rows of equal token sets share a class, named by its smallest id. Null sets count as empty."""
    own = rows.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda t: t.isNotNull()))).alias("tokens"))
    named = own.groupBy("tokens").agg(F.min("id").alias("class_id"))
    return own.join(named.withColumnRenamed("tokens", "_t"), F.col("tokens") == F.col("_t")).select("class_id", "id", "tokens")


def small_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, shared, n): pairs of small sets (class_id, tokens in one order) that may be alike, n being their sizes' sum.

    Sets of m and n tokens that are alike share at least so many: similarity / (1 + similarity) x (m + n). They meet in their
    subsets of just that size, and are told where the subset holds the first of what they share. A group of sets that hold
    the same subset is small where tokens are frequent: those that hold one token are many, those that hold four are few.
    """
    places = []
    for n in range(1, SMALL + 1):
        for other in range(1, SMALL + 1):
            least = max(ceil(round(similarity / (1 + similarity) * (n + other), 9)), 1)
            places += [(n, min(n, other), max(n, other), list(c)) for c in combinations(range(n), least)] if least <= min(n, other) else []
    if not places:
        return sets.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(0).alias("shared"), F.lit(0).alias("n")).where(F.lit(False))
    told = F.broadcast(sets.sparkSession.createDataFrame(places, "size int, low int, high int, places array<int>"))
    kept = sets.withColumn("size", F.size("tokens")).join(told, "size").withColumn("part", F.transform("places", lambda i: F.get("tokens", i)))
    a = kept.where("size = low").select("low", "high", "part", F.col("class_id").alias("a"), F.col("tokens").alias("t_a"))
    b = kept.where("size = high").select("low", "high", "part", F.col("class_id").alias("b"), F.col("tokens").alias("t_b"))
    both = a.join(b, ["low", "high", "part"]).where((F.col("low") < F.col("high")) | (F.col("a") < F.col("b")))
    both = both.withColumn("shared", F.array_intersect("t_a", "t_b")).where(F.slice("shared", F.lit(1), F.size("part")) == F.col("part"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.size("shared").alias("shared"), (F.col("low") + F.col("high")).alias("n"))


def similarity_edges(rows: DataFrame, id_col: str, tokens: str, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((a, b, jaccard) between classes a < b, (class_id, id) of every row): every pair of different sets at least so alike.

    Sets of at most SMALL tokens meet in subsets (small_pairs). For pairs with a larger one tokens are ordered from rare to
    common over the classes. Two sets at least `similarity` alike share a token among the first
    |set| - ceil(similarity x |set|) + 1 of each, and their sizes are within that ratio; such pairs are found by a join on
    the token and counted once, at the first token that both prefixes hold, then measured whole. Equal sets are one class
    and need no edge, so copies are never paired; empty sets have no edges. A frequent token stands last in every set and
    so in few prefixes, unless large sets hold little else.
    """
    members = written(token_classes(rows, id_col, tokens), "classes")
    sets = members.where(F.col("id") == F.col("class_id")).dropDuplicates(["class_id"]).select("class_id", "tokens").where(F.size("tokens") > 0)
    pairs, ordered = small_pairs(sets.where(F.size("tokens") <= SMALL), similarity), None
    if not sets.where(F.size("tokens") > SMALL).isEmpty():
        single = sets.select("class_id", F.explode("tokens").alias("token"))
        often = single.groupBy("token").agg(F.count("*").alias("often"))
        ordered = single.join(often, "token").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("o"))
        ordered = written(ordered.select("class_id", F.transform("o", lambda x: x["token"]).alias("tokens"), F.size("o").alias("n")), "ordered")
        first = F.col("n") - F.ceil(F.round(F.col("n") * F.lit(similarity), 9)) + 1
        prefixes = ordered.select("class_id", "n", "tokens", F.posexplode(F.slice("tokens", F.lit(1), first.cast("int"))).alias("at", "token"))
        a = prefixes.select("token", F.col("class_id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"), F.col("at").alias("at_a"))
        b = prefixes.where(F.col("n") > SMALL).select("token", F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"), F.col("at").alias("at_b"))
        near = ((F.col("n_a") <= SMALL) | (F.col("a") < F.col("b"))) & (F.col("n_a") >= F.round(similarity * F.col("n_b"), 9)) & (F.col("n_b") >= F.round(similarity * F.col("n_a"), 9))
        once = ~F.arrays_overlap(F.slice("t_a", F.lit(1), F.col("at_a")), F.slice("t_b", F.lit(1), F.col("at_b")))  # no earlier token in common
        shared = F.size(F.array_intersect("t_a", "t_b"))
        pairs = pairs.unionByName(a.join(b, "token").where(near & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), shared.alias("shared"), (F.col("n_a") + F.col("n_b")).alias("n")))
    edges = written(pairs.select("a", "b", (F.col("shared") / (F.col("n") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= similarity - 1e-12), "edges")
    if ordered is not None:
        dropped(ordered)
    return edges, members.select("class_id", "id")
