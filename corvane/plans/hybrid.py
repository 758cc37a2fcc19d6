"""The hybrid retrieval plan: scope filter, lexical and dense leg, fusion, rerank; results can be kept between calls."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import bm25, knn, lexical_rerank, rrf, scoped
from ..shared import written
from ..streaming.keyed import ledger, store, stored

#: What is kept of a search: a row a result, and one of rank 0 for the question itself, so that one without results is known.
KEPT = "setting string, query_text string, doc_id long, rank int, rerank_score double"


def searched(docs: DataFrame, unique: DataFrame, candidates: int, k: int) -> DataFrame:
    """(query_text, doc_id, rank, rerank_score) of questions (query_id, text, vector) with different texts."""
    vectors = lambda rows, name: rows.where("vector IS NOT NULL").select(F.col(name).alias("vec_id"), F.col("vector").alias("embedding"))
    dense = knn(vectors(docs, "doc_id"), vectors(unique, "query_id"), candidates).withColumnRenamed("vec_id", "doc_id")
    fused = rrf([bm25(docs, unique, candidates), dense], n=candidates)
    texts = fused.join(unique.select("query_id", F.col("text").alias("query_text")), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    return lexical_rerank(texts, F.col("query_text"), F.col("text"), k).select("query_text", "doc_id", "rank", "rerank_score")


def hybrid_search(docs: DataFrame, queries: DataFrame, wanted: dict | None = None, candidates: int = 20, k: int = 5, memo: str | None = None, corpus: str = "") -> DataFrame:
    """(query_id, doc_id, rank, rerank_score) of queries (query_id, text, vector) among docs (doc_id, text, vector, ...).

    Equal texts are searched once, with the vector of the smallest id. With a memo (a folder), results are kept by text,
    filters, candidates, k and the corpus's name, and only questions that it lacks are searched; one writer at a time.
    A null vector takes no part in the dense leg, a document is not near a question of its own id there; a null text has
    no words. A question without any result has no row.
    """
    spark = queries.sparkSession
    unique = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"), "vector").groupBy("text").agg(F.min("query_id").alias("query_id"), F.min_by("vector", "query_id").alias("vector"))
    docs = scoped(docs, wanted or {})
    if memo is None:
        best = searched(docs, unique, candidates, k)
    else:
        setting = json.dumps([corpus, {c: sorted([v] if isinstance(v, str) else v) for c, v in (wanted or {}).items() if v}, candidates, k], sort_keys=True)
        known = stored(spark, memo, KEPT).where(F.col("setting") == setting).drop("batch")
        missing = written(unique.join(known.select(F.col("query_text").alias("text")).distinct(), "text", "left_anti"), "missing")
        if not missing.isEmpty():
            found = searched(docs, missing, candidates, k).unionByName(missing.select(F.col("text").alias("query_text"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("rerank_score")))
            store(found.select(F.lit(setting).alias("setting"), "query_text", "doc_id", "rank", "rerank_score"), max(ledger(spark, memo), default=-1) + 1, memo)
        best = stored(spark, memo, KEPT).where((F.col("setting") == setting) & (F.col("rank") > 0)).select("query_text", "doc_id", "rank", "rerank_score")
    return queries.join(best, F.coalesce(queries["text"], F.lit("")) == best["query_text"]).select("query_id", "doc_id", "rank", "rerank_score")
