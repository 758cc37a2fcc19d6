import math

from pyspark.sql import functions as F

from corvane.llm.ann import ann_search
from corvane.llm.common import share_below, ship
from corvane.llm.lang_id import FIT_PER_LANG, quotas
from corvane.llm.lm_score import lm_score
from corvane.llm.mixing import mix_sources
from corvane.llm.quality import score_quality


def test_samples_of_any_table_have_their_bound():
    for n in (10**6, 10**12):
        assert abs((quotas({"a": n})["a"] + 2**63) / 2**64 * n - FIT_PER_LANG) < 1
    assert share_below(2.0) == 2**63 - 1


def test_scores_without_training_are_finite(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    rows = lm_score(docs, F.lit(False)).collect()
    assert len(rows) == 3 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)


def test_columns_of_any_name_stay(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "some words here", "s", 1, 2, 3, 4)], "doc_id long, text string, source string, _id int, _x int, _train int, _n int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert set(docs.columns) <= set(score_quality(docs, labels, F.lit(True)).columns)
    assert mix_sources(docs).columns == docs.columns


def test_vectors_are_searched_among_their_length(spark):
    ship(spark)
    rows = [(i, [float(i), 1.0]) for i in range(1, 9)] + [(20, [1.0, 2.0, 3.0]), (21, [2.0, 2.0, 3.0])]
    got = ann_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", k=3).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(20, 21, 15.0)]
