"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan as ls
from .common import remainder, ship, table
from .lm_score import lm_score
from .mixing import mix_plan
from .mixing import oracle as mixing_oracle
from .packing import pack
from .quality import score_quality
from .lang_id import identify_language
from .ann import ann_search
from .embedding_dedup import embedding_dedup
from .importance import importance_resample
from .importance import oracle as importance_oracle
from .simhash import hex_print, simhash_components
from .spelling import oracle as spelling_oracle
from .spelling import spelling_variants
from .substring_dedup import oracle as repeats_oracle
from .substring_dedup import without_repeats
from .token_count import count_tokens


def held_out(n: int, left: int) -> Column:
    """Whether the fold of a document is kept out of learning; false for a null id, which nothing is learned from."""
    return F.coalesce(remainder("doc_id", n) == left, F.lit(False)).alias("held_out")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = simhash_components(table(spark, sf_dir, "documents"), shingle=4, threshold=4)
    return rows.select("doc_id", hex_print("fp").alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ls.license_scan(table(spark, sf_dir, "documents"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    rows = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ann_search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = identify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), remainder("doc_id", 4) != 2)
    return rows.select("doc_id", held_out(4, 2), "lang_pred", "score", "rejected")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2, keep=["doc_id"])
    return rows.select("doc_id", held_out(4, 2), "score", "predicted")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = lm_score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return rows.select("doc_id", held_out(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return without_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_dedup, op5_license_scan, op10_token_count, op3_embedding_dedup, op7_ann_search, op4_language_id, op8_quality_classifier, op9_source_mixing, op2_packing, op6_lm_scoring, op11_spelling_variants, op12_importance_resampling, op13_substring_dedup)
}
ORACLE_SQL: dict[str, str] = {"op5_license_scan": ls.oracle(), "op9_source_mixing": mixing_oracle(), "op11_spelling_variants": spelling_oracle(), "op12_importance_resampling": importance_oracle(), "op13_substring_dedup": repeats_oracle()}
