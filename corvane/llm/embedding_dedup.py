"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components of the links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .vectors import matrix, usable

#: Chance of missing a pair right at the threshold, over all tables.
MISS = 1e-4
#: Rows that a bucket of one table has on average, and rows of a block: a cell compares two blocks at most.
BUCKET, BLOCK = 256, 1024


def plan_tables(largest: int, threshold: float, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables): bits so that the largest label has buckets of about `bucket`, tables so that `miss` holds."""
    bits = min(24, max(2, math.ceil(math.log2(max(2, largest / bucket)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(miss) / math.log1p(-same)))


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def sign_keys(bits: int, tables: int, seed: int):
    """Column function: a vector's bucket in every table."""
    weights = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made: dict[int, np.ndarray] = {}
        for vectors in batches:
            out, dims = np.empty(len(vectors), object), vectors.map(len).to_numpy()
            for dim in np.unique(dims):
                p = made.setdefault(int(dim), planes(int(dim), bits, tables, seed))
                at = np.flatnonzero(dims == dim)
                signs = (matrix(vectors.iloc[at]) @ p > 0).reshape(len(at), tables, bits)
                out[at] = list((signs @ weights).astype(np.int32))
            yield pd.Series(out)

    return keys


def compare_cell(cell: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one cell's classes: links of each (weighted by copies) and the smallest class it is connected to here.

    A pair counts in the first table in which its keys agree, hence once. Cells of two blocks compare across them only.
    """
    cell = cell.sort_values("cid", ignore_index=True)
    x, keys, table = matrix(cell["embedding"]), np.array(cell["keys"].tolist()), int(cell["t"].iloc[0])
    norm = np.sqrt((x * x).sum(1))
    u = x / norm[:, None]
    side, cid, copies = cell["side"].to_numpy(), cell["cid"].to_numpy(), cell["copies"].to_numpy()
    across = cell["a"].iloc[0] != cell["b"].iloc[0]
    cosine = u @ u.T
    i, j = np.nonzero(np.triu(cosine >= threshold - 1e-9, 1))
    if across:
        i, j = i[side[i] != side[j]], j[side[i] != side[j]]
    if table and len(i):
        new = ~(keys[i, :table] == keys[j, :table]).any(1)
        i, j = i[new], j[new]
    near = np.abs(cosine[i, j] - threshold) < 1e-9  # the product's rounding must not decide
    if near.any():
        exact = (x[i[near]] * x[j[near]]).sum(1) / (norm[i[near]] * norm[j[near]])
        keep = ~near
        keep[near] = exact >= threshold
        i, j = i[keep], j[keep]
    links = np.bincount(i, copies[j], len(cid)) + np.bincount(j, copies[i], len(cid))
    root, before = np.arange(len(cid)), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, j, root[i])
        np.minimum.at(root, i, root[j])
    had = links > 0
    return pd.DataFrame({"cid": cid[had], "links": links[had].astype(np.int64), "root": cid[root[had]]})


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, seed: int = 7) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Vectors of equal label (not null) and length link at a cosine of `threshold` or more. Equal vectors are one class
    first, so copies cost one row and link by arithmetic. Classes meet in the buckets of each table; a bucket larger
    than BLOCK is dealt out over pairs of its blocks, each a cell of its own, so no task holds a whole bucket. A cell
    returns a row per class, not per pair. n_links counts the other vectors linked directly, component_id is the
    smallest vec_id reachable, kept marks it. Vectors that are null, empty, zero or hold null or non-finite components,
    and those without a label or id, link with nothing; without an id kept is false. Rows that share an id are one node.
    A hash can miss a pair: at the threshold with chance MISS, above it less. Pairs of near but unequal vectors within
    one tight group are all verified, so that part costs the square of the group's distinct vectors.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    valid = rows.where(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold)
    keyed = classes.select("label", F.size("embedding").alias("dim"), "embedding", "cid", "copies", sign_keys(bits, tables, seed)("embedding").alias("keys"))
    keyed = cut(keyed, "keyed")
    bucket = ["label", "dim", "t", "key"]
    sizes = keyed.select("label", "dim", F.posexplode("keys").alias("t", "key")).groupBy(*bucket).count()
    sizes = sizes.where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in bucket], F.ceil(F.col("count") / BLOCK).cast("int").alias("_blocks"))
    members = keyed.select("*", F.posexplode("keys").alias("t", "key"))
    members = members.join(sizes, [F.col(c) == F.col(f"_{c}") for c in bucket]).withColumn("side", F.pmod(F.xxhash64("cid"), "_blocks").cast("int"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    members = members.withColumns({"a": F.least("side", "_other"), "b": F.greatest("side", "_other")})
    found = cut(
        members.select(*bucket, "a", "b", "side", "cid", "copies", "keys", "embedding").groupBy(*bucket, "a", "b").applyInPandas(
            lambda cell: compare_cell(cell, threshold), "cid long, links long, root long"
        ),
        "found",
    )
    roots = connected_components(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links")).join(roots, F.col("cid") == F.col("node")).select(F.col("cid").alias("_cid"), "links", "root")
    told = classes.join(counted, F.col("cid") == F.col("_cid"), "left").where("copies > 1 OR links > 0")
    told = told.select(
        F.col("label").alias("_label"), F.col("embedding").alias("_vec"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("root", "cid").alias("_root"),
    )
    ok = usable("embedding") & F.col("vec_id").isNotNull()
    out = rows.withColumn("_ok", ok).join(told, F.col("_ok") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_vec")), "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
