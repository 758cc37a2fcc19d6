"""Lexical and dense retrieval, fusion and reranking over DataFrames of queries and documents."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..shared import dropped, observed, written


def scoped(docs: DataFrame, wanted: dict[str, str | list[str] | None], everyone: str = "all") -> DataFrame:
    """Rows whose tag array of every wanted field holds a wanted value or the tag for everyone; blank wishes are ignored."""
    for field, values in wanted.items():
        if values and field in docs.columns:
            values = [values] if isinstance(values, str) else list(values)
            docs = docs.where(F.arrays_overlap(F.col(field), F.array(*[F.lit(v) for v in dict.fromkeys([*values, everyone])])))
    return docs


def top_k(scored: DataFrame, k: int, by: list[str], group: str = "query_id") -> DataFrame:
    """The first k rows of each group with their rank; by: columns, "-" before one for descending."""
    order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in by]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


class Postings(NamedTuple):
    """Term counts of the documents for the terms of some queries: (row, doc_id, n, term, tf), n being the document's length
    in words; how many documents there are in all, and their mean length."""

    rows: DataFrame
    docs: int
    mean: float


#: Rows up to which a table of query terms is broadcast; beyond, Spark joins it like any other.
TERMS = 200_000


def bounded(small: DataFrame, n: int) -> DataFrame:
    """small, broadcast if its n rows are within TERMS."""
    return F.broadcast(small) if n <= TERMS else small


def query_terms(queries: DataFrame, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
    return queries.select(F.col(query_col).alias("query_id"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("term"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Postings:
    """Postings of docs for terms (query_id, term), in one pass over the texts.

    Words that no query asks for go before anything is shuffled; what is shuffled and written grows with the hits. The
    number of documents and their lengths are observed in the same pass. Rows of equal ids are documents of their own;
    null and empty texts are documents without words.
    """
    wanted = terms.select("term").distinct()
    seen = Observation()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    figures = [F.count("*").alias("docs"), F.avg(F.size("w")).alias("mean")]
    held = rows.observe(seen, *figures).select("row", "doc_id", F.size("w").alias("n"), F.explode("w").alias("term")).join(bounded(wanted, wanted.count()), "term", "left_semi")
    out = written(held.groupBy("row", "doc_id", "n", "term").agg(F.count("*").alias("tf")), "postings")
    told = observed(seen, lambda: rows.agg(*figures).first().asDict())  # read anew only if no document holds any term
    return Postings(out, told["docs"], told["mean"] or 0.0)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text: str = "text", k1: float = 1.2, b: float = 0.75, posted: Postings | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by Okapi BM25 with idf ln(1 + (N - df + .5) / (df + .5)), ties to the smaller id.

    Postings are dealt by document once; scores are added up where the document lies, and each task keeps its k best a
    query before those meet. Postings made here are deleted at the end, those that are given are not.
    """
    terms = query_terms(queries, query_col, query_text)
    post = postings(docs, terms, doc_col, text_col) if posted is None else posted
    idf = F.log(1 + (F.lit(post.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(post.rows.groupBy("term").agg(F.count("*").alias("df")), "term").select("query_id", "term", idf.alias("idf"))
    hits = post.rows.repartition("row").join(bounded(asked, terms.count()), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(post.mean or 1.0)))
    scored = hits.groupBy("row", "query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score")).drop("row")
    out = top_k(scored, k, ["-score", "doc_id"])
    if posted is None:
        out = written(out, "bm25")
        dropped(post.rows)
    return out


def overlap(docs: DataFrame, queries: DataFrame, k: int = 10, posted: Postings | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by the number of distinct words shared."""
    terms = query_terms(queries)
    post = postings(docs, terms) if posted is None else posted
    hits = post.rows.select("row", "doc_id", "term").repartition("row").join(bounded(terms, terms.count()), "term")
    out = top_k(hits.groupBy("row", "query_id", "doc_id").agg(F.count("*").cast("double").alias("score")).drop("row"), k, ["-score", "doc_id"])
    if posted is None:
        out = written(out, "overlap")
        dropped(post.rows)
    return out


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", where: str | None = None, batch: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank) by cosine: every query against every row, in blocks.

    A stated set of queries: they are dealt into blocks of `batch`, each block is joined to the rows' blocks, and a task
    keeps the k best of its rows for each query, so neither side is held whole and pairs are never rows. Vectors that
    are null, empty or hold null or non-finite components take no part; a vector is near those of its own length only.
    A matrix product finds the candidates; the scores of those that can be among the k best are summed component by
    component, so that equal vectors score alike in whatever block they lie.
    """
    usable = lambda df: df.where(F.coalesce((F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    rows, queries = usable(vectors.where(where) if where else vectors), usable(queries)
    ask = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    n_q, n_r = max(1, -(-ask.count() // batch)), max(1, -(-rows.count() // (4 * batch)))
    # block numbers of one type on both sides: an int and a long of the same value are dealt to different tasks
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), dealt(id_col, n_r).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"))
    right = ask.select("id", "v", dealt("id", n_q).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("r"))

    def in_turn(products: np.ndarray) -> np.ndarray:
        """Sums of the rows, added from left to right."""
        return np.add.accumulate(products, axis=1)[:, -1]

    def whole(y: np.ndarray) -> np.ndarray:
        """The nearest whole numbers, halves away from zero."""
        return (t := np.trunc(y)) + np.sign(y) * (np.abs(y - t) >= 0.5)

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if x.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        parts = [block(x[x["v"].map(len) == n], own) for n, own in q.groupby(q["v"].map(len))]
        return pd.concat([p for p in parts if len(p)] or [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})])

    def block(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        m, ask_m = np.array(x["v"].tolist(), float), np.array(q["v"].tolist(), float)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
        near, ids, out = unit(ask_m) @ unit(m).T, x["id"].to_numpy(), []
        squares, ask_squares = in_turn(m * m), in_turn(ask_m * ask_m)
        for i, own in enumerate(q["id"]):
            at = np.flatnonzero(ids != own)
            if len(at) > k:
                at = at[near[i, at] >= np.partition(near[i, at], len(at) - k)[len(at) - k] - 1e-8]
            both = squares[at] * ask_squares[i]
            exact = (both > 1e-280) & (both < 1e280)
            s = whole(np.where(exact, np.clip(in_turn(m[at] * ask_m[i]) / np.sqrt(np.where(exact, both, 1.0)), -1, 1), near[i, at]) * 1e9) / 1e9
            best = np.lexsort((ids[at], -s))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at[best]], "score": s[best]}))
        return pd.concat(out)

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(search, "query_id long, vec_id long, score double")
    return top_k(found, k, ["-score", "vec_id"])


def rrf(legs: list[DataFrame], k: int = 60, n: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_id, doc_id, rank)."""
    both = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("query_id", "doc_id", "rank"))
    return top_k(both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score")), n, ["-score", "doc_id"])


def min_max_fusion(legs: list[DataFrame], n: int = 10) -> DataFrame:
    """Mean over the legs of scores scaled to [0, 1] per query (1 if all are equal); absent from a leg counts 0."""
    w = Window.partitionBy("query_id")
    scaled = None
    for leg in legs:
        low, high = F.min("score").over(w), F.max("score").over(w)
        one = leg.select("query_id", "doc_id", F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(1.0)).alias("s"))
        scaled = one if scaled is None else scaled.unionByName(one)
    return top_k(scaled.groupBy("query_id", "doc_id").agg(F.round(F.sum("s") / len(legs), 9).alias("score")), n, ["-score", "doc_id"])


def arms(legs: dict[str, DataFrame]) -> DataFrame:
    """Candidates of all legs with their arm's label and their rank in it, from 1."""
    out = None
    for name, leg in legs.items():
        one = leg.select("query_id", "doc_id", F.lit(name).alias("arm"), F.col("rank").alias("arm_rank"))
        out = one if out is None else out.unionByName(one)
    return out


def lexical_rerank(candidates: DataFrame, query_text: Column, doc_text: Column, k: int = 10, miss: float = -5.0) -> DataFrame:
    """Reorders candidates (query_id, doc_id, rank) by shared distinct words, `miss` if none; ties keep their order."""
    shared = F.size(F.array_intersect(words(query_text), words(doc_text))).cast("double")
    scored = candidates.withColumn("rerank_score", F.when(shared == 0, miss).otherwise(shared)).withColumnRenamed("rank", "arm_rank")
    return top_k(scored, k, ["-rerank_score", "arm_rank"])
