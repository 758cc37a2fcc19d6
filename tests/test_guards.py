"""Guards that raise, and windows of time, on small inputs."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import reports as rp
from corvane.sources import logs
from corvane.streaming import live


def test_a_group_that_blends_kinds_raises(spark):
    rows = spark.createDataFrame([("a", "full", 1.0), ("a", "full", 2.0), ("b", "none", None), ("b", "full", 1.0), (None, "full", 3.0)], "m string, k string, v double")
    assert rp.unblended(rows, ["m"], "k", "v").count() == 5  # a null score blends nothing
    mixed = rows.unionByName(spark.createDataFrame([("a", "none", 0.0)], rows.schema))
    with pytest.raises(Exception, match="blends several"):
        rp.unblended(mixed, ["m"], "k", "v").collect()


def test_totals_of_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "t string, g string, v double").withColumn("t", F.to_timestamp("t"))
    got = sorted((r.start.hour, r.n, r.total) for r in live.windowed(rows, "t", "1 hour", ["g"], "v").collect())
    assert got == [(0, 2, 3.0), (1, 1, 4.0)]


def test_a_history_is_cut_and_filtered(spark):
    rows = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "at int, island string")
    assert [r.at for r in logs.history(rows, 3, 8, island="x").orderBy("at").collect()] == [3, 5, 7]
    assert logs.history(rows, island=None).count() == 10


def test_a_cohort_takes_its_turn_type_from_the_stratum(spark):
    rows = spark.createDataFrame([("a", "multi"), ("a", "single"), ("b", "multi"), (None, "multi")], "tone string, turn_type string")
    assert rp.in_cohort(rows, {"tone": "a"}, "multi").count() == 1 and rp.in_cohort(rows, {"tone": "a"}).count() == 2
    assert rp.in_cohort(rows, {"tone": None}, "multi").count() == 1 and rp.in_cohort(rows, {"turn_type": "single"}, "multi").count() == 1
