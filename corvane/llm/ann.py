"""Nearest neighbours by a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, local, thin, unused
from .vectors import matrix, usable

#: Rows that the tree is fitted on, about, and queries that the number of visits is calibrated with, at most.
FIT_ROWS, CALIBRATION_QUERIES = 32768, 256
#: Rows of a cell: members and queries.
MEMBERS, QUERIES = 8192, 4096
#: Rows up to which a tree of one level more is not needed: leaves hold some thousand rows at most, as far as the levels go.
LEVEL_ROWS, LEVELS = 1 << 20, 3


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, own centre of each row); fewer centres than k if some stay empty."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        live = np.unique(own)
        centres = np.array([x[own == c].mean(0) for c in live])
    return centres, nearest(x, centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


class Tree:
    """Nodes by number, the root is 0. children[n]: its nodes (none: a leaf), centres[n]: theirs; branch: below the root."""

    def __init__(self, sample: np.ndarray, branching: int, depth: int, seed: int):
        self.children: list[list[int]] = [[]]
        self.centres: list[np.ndarray | None] = [None]
        rng = np.random.default_rng(seed)
        todo = [(0, sample, 0)]
        while todo:
            node, x, level = todo.pop()
            if level == depth or len(x) < 2 * branching:
                continue
            centres, own = k_means(x, branching, rng)
            if len(centres) < 2:
                continue
            for c in range(len(centres)):
                self.children[node].append(len(self.children))
                self.children.append([])
                self.centres.append(None)
                todo.append((self.children[node][-1], x[own == c], level + 1))
            self.centres[node] = centres

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.centres[node] is None:
                out[rows] = node
            elif len(rows):
                own = nearest(x[rows], self.centres[node])
                todo += [(child, rows[own == c]) for c, child in enumerate(self.children[node])]
        return out

    def groups(self, sizes: dict[int, int], most: int) -> dict[int, int]:
        """The node that each leaf is searched under: the highest that holds at most `most` rows, else the leaf itself."""
        held: dict[int, int] = {}
        for node in range(len(self.children) - 1, -1, -1):  # children have higher numbers
            held[node] = sizes.get(node, 0) + sum(held[c] for c in self.children[node])
        out, todo = {}, [(0, -1)]
        while todo:
            node, above = todo.pop()
            own = above if above >= 0 else node if held[node] <= most or not self.children[node] else -1
            if self.children[node]:
                todo += [(c, own) for c in self.children[node]]
            else:
                out[node] = own
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a priority queue keyed by the inner product with the node's centre."""
        queue = [(-np.inf, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.centres[node] is None:
                yield node
                continue
            for child, near in zip(self.children[node], (self.centres[node] @ q).tolist(), strict=True):
                heapq.heappush(queue, (-near, child))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each row summed alike wherever it stands, so that equal vectors tie."""
    return (x * q).sum(1)


def top(q: np.ndarray, approx: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows, ties to the smaller id; rows at -inf take no part."""
    live = int((approx > -np.inf).sum())
    if not live:
        return ids[:0], approx[:0]
    if live > k:
        least = np.partition(approx, -k)[-k]
        at = np.flatnonzero(approx >= least - 1e-9 * max(1.0, abs(least)))
    else:
        at = np.flatnonzero(approx > -np.inf)
    scores = exact_scores(q, x[at])
    order = np.lexsort((ids[at], -scores))[:k]
    return ids[at][order], scores[order]


def search_cell(members: pd.DataFrame, queries: pd.DataFrame, k: int, chunk: int = 256) -> pd.DataFrame:
    """The k best members for each query of a cell, of the leaves that the query visits."""
    if members.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    members = members.sort_values("leaf", kind="stable", ignore_index=True)
    x, ids, leaf = matrix(members["embedding"]), members["vec_id"].to_numpy(), members["leaf"].to_numpy()
    leaves, starts = np.unique(leaf, return_index=True)
    stops = [*starts[1:], len(leaf)]
    out = []
    for c in range(0, len(queries), chunk):
        part = queries.iloc[c : c + chunk]
        q, qids = matrix(part["embedding"]), part["vec_id"].to_numpy()
        visits = [set(v) for v in part["leaves"]]
        approx = np.full((len(part), len(ids)), -np.inf)
        for one, a, b in zip(leaves.tolist(), starts, stops, strict=True):
            rows = [i for i, v in enumerate(visits) if one in v]
            if rows:
                approx[rows, a:b] = q[rows] @ x[a:b].T
        approx[qids[:, None] == ids[None, :]] = -np.inf
        for i in range(len(part)):
            got, scores = top(q[i], approx[i], x, ids, k)
            out.append(pd.DataFrame({"query_id": np.full(len(got), qids[i]), "vec_id": got, "score": scores}))
    return pd.concat(out)


def best_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated_visits(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The fewest leaves with which the calibration queries' mean recall against brute force reaches `recall`."""
    chosen = queries.orderBy(F.xxhash64("vec_id")).limit(CALIBRATION_QUERIES).select("vec_id", "embedding").toPandas()
    if chosen.empty:
        return 1
    q, qids = matrix(chosen["embedding"]), chosen["vec_id"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x, ids = matrix(part["embedding"]), part["vec_id"].to_numpy()
            leaf = dict(zip(ids.tolist(), part["leaf"].tolist(), strict=True))
            approx = q @ x.T
            approx[qids[:, None] == ids[None, :]] = -np.inf
            for i in range(len(q)):
                got, scores = top(q[i], approx[i], x, ids, k)
                yield pd.DataFrame({"query_id": np.full(len(got), qids[i]), "vec_id": got, "score": scores, "leaf": [leaf[v] for v in got.tolist()]})

    true = best_k(indexed.select("vec_id", "embedding", "leaf").mapInPandas(scan, "query_id long, vec_id long, score double, leaf int"), k)
    place: list[int] = []
    order = {i: {leaf: n for n, leaf in enumerate(tree.best_first(v), 1)} for i, v in zip(qids.tolist(), q, strict=True)}
    for r in true.select("query_id", "leaf").collect():
        place.append(order[r.query_id][r.leaf])
    if not place:
        return 1
    return int(np.sort(place)[max(0, int(np.ceil(recall * len(place))) - 1)])


def ann_search(df: DataFrame, is_query: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = 0.96, branching: int = 16, depth: int | None = None, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets the SQL condition is_query, its k best other rows.

    The measure is the inner product. A tree of branching ** depth leaves at most (depth: 2, and LEVELS from LEVEL_ROWS
    rows on) is fitted on about FIT_ROWS rows and sent to the executors (its size depends on these parameters only);
    every row is assigned to its leaf. A query visits leaves best bin first: as many as brings the recall of
    CALIBRATION_QUERIES queries, measured against brute force over all rows, to `recall`, and more until they hold k
    other rows. Leaves are searched together under the highest node of at most MEMBERS rows; a query's vector goes only
    to the nodes that it visits, and a node's rows are repeated only for each QUERIES queries that visit it, so both
    grow with the input as long as queries visit a bounded number of nodes. A leaf beyond MEMBERS rows is dealt out in
    blocks, so a leaf with a third of all rows is no single task.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part.
    Vectors are searched among those of their length: by the tree for the most frequent length, all of them in blocks
    for the others. Ties go to the smaller vec_id; of rows that share an id each is a candidate. No rows give no rows.
    """
    spark = df.sparkSession
    asks = unused(df, "asks")
    rows = df.where(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.coalesce(F.expr(is_query), F.lit(False)).alias(asks))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = lengths[0].d, lengths[0]["count"]
    of_dim = F.size("embedding") == dim
    sample = local(thin(rows.where(of_dim), "vec_id", FIT_ROWS, n, seed).select("embedding"))
    levels = depth or (LEVELS if n > LEVEL_ROWS else 2)
    tree = Tree(matrix(sample["embedding"]) if len(sample) else np.zeros((1, dim)), branching, levels, seed)
    sent = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            own = vectors.map(len).to_numpy() == dim
            leaf = -vectors.map(len).to_numpy().astype(np.int32)  # another length is a leaf of its own
            if own.any():
                leaf[own] = sent.value.leaf_of(matrix(vectors[own]))
            yield pd.Series(leaf)

    indexed = cut(rows.withColumn("leaf", leaf_of("embedding")), "indexed")
    asking = indexed.where(F.col(asks))
    visits = calibrated_visits(indexed.where(of_dim), asking.where(of_dim), tree, k, recall)
    sizes = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one row per leaf of the tree
    node_of = {leaf: node for leaf, node in tree.groups(sizes, MEMBERS).items() if leaf in sizes} | {leaf: leaf for leaf in sizes if leaf < 0}
    in_node: dict[int, int] = {}
    for leaf, size in sizes.items():
        in_node[node_of[leaf]] = in_node.get(node_of[leaf], 0) + size

    @F.pandas_udf("array<struct<node:int,leaves:array<int>>>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = []
            for v in vectors:
                if len(v) != dim:
                    out.append([{"node": -len(v), "leaves": [-len(v)]}])
                    continue
                seen, held, chosen = 0, 0, {}
                for leaf in sent.value.best_first(np.asarray(v, np.float64)):
                    if leaf in sizes:
                        chosen.setdefault(node_of[leaf], []).append(leaf)
                        held += sizes[leaf]
                    seen += 1
                    if seen >= visits and held > k:
                        break
                out.append([{"node": b, "leaves": leaves} for b, leaves in chosen.items()])
            yield pd.Series(out)

    asked = cut(asking.select("vec_id", "embedding", walk("embedding").alias("to")), "asked")
    asked_of = {r.node: r["count"] for r in asked.select(F.explode("to.node").alias("node")).groupBy("node").count().collect()}
    table = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    nodes = table(node_of)
    blocks = F.element_at(table({b: -(-size // MEMBERS) for b, size in in_node.items()}), F.col("node"))
    parts = F.element_at(table({b: -(-asked_of.get(b, 0) // QUERIES) for b in in_node}), F.col("node"))
    members = indexed.withColumn("node", F.element_at(nodes, F.col("leaf"))).withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    members = members.where(parts > 0).select("vec_id", "embedding", "leaf", "node", "block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("q_part"))
    asked = asked.select("vec_id", "embedding", F.explode("to").alias("to")).select("vec_id", "embedding", "to.*")
    asked = asked.withColumn("q_part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), parts).cast("int"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    cell = ["node", "block", "q_part"]
    found = members.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(lambda m, q: search_cell(m, q, k), "query_id long, vec_id long, score double")
    return best_k(found, k).select("query_id", "rank", "vec_id", "score")
