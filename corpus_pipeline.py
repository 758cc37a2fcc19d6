"""The corpus pipeline: language, quality, near-duplicates, mixture, packing. Counted as part of corvane.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import remainder, scratch, ship, table
from corvane.llm.lang_id import identify_language
from corvane.llm.mixing import mix_sources
from corvane.llm.packing import pack
from corvane.llm.quality import score_quality
from corvane.llm.simhash import drop_near_duplicates

#: No SQL expresses the learned stages and the fingerprints; tests compare each stage with brute force.
ORACLE_SQL = None
#: Share of its documents that a learned stage does not learn from, as in the single queries.
FOLDS, HELD_OUT = 4, 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter or too far from every language's centroids.

    A null or empty text has no letter and goes. Rows with a null id stay by their text but teach nothing; repeated rows
    stay as often as they occur; no documents give none. Further columns pass through.
    """
    ship(spark)
    named = identify_language(docs, remainder("doc_id", FOLDS) != HELD_OUT)
    return named.where(~F.col("rejected")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold.

    A null or empty text has a score like any other. Rows with a null id are scored but teach nothing; ties at the
    threshold stay; repeated rows stay as often as they occur; without documents there are none; without labels of both
    kinds every score is 0.5 and no document stays. Further columns pass through.
    """
    ship(spark)
    scored = score_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", FOLDS) != HELD_OUT)
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document of the smallest id of each near-duplicate group: shingles of five words, similarity 0.8.

    Null and empty texts are one group. Rows with a null id stay only in groups without any id, one a text; of rows that
    repeat an id one stays; a text of any length is compared whole; no documents give none. Further columns pass through.
    """
    ship(spark)
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by their sources' target weights, whole and repeated where a source is short.

    Null and empty texts have no tokens and are left out; a null source is a source; ties in the order are told apart by
    id; repeated rows go together; no documents give none. Further columns pass through.
    """
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bucket, batch and slot.

    Null and empty texts have length 0 and are placed like others; a null id is placed by its text; repeated rows have a
    slot each; no documents give none. Further columns stay behind.
    """
    return pack(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
