import numpy as np
from pyspark.sql import functions as F

from corvane.operators.retrieval import knn
from corvane.operators.selection import largest_remainder
from corvane.operators.bootstrap import bootstrap_interval, paired_bootstrap
from corvane.operators.statistics import discordance
from corvane.sources.corpus import latest_keys


def two_stage(items, draws=4000):
    rng = np.random.default_rng(3)
    means = []
    for _ in range(draws):
        chosen = rng.integers(0, len(items), len(items))
        means.append(np.mean([np.mean(rng.choice(items[i], len(items[i]))) for i in chosen]))
    return np.quantile(means, [0.025, 0.975])


def test_bootstrap_equals_a_two_stage_resample(spark):
    rng = np.random.default_rng(1)
    for sizes in ([1] * 60, [2] * 60, [1, 2, 5] * 20):
        items = [rng.choice([0.0, 2.0], n) for n in sizes]
        rows = spark.createDataFrame([("m", i, float(v)) for i, vs in enumerate(items) for v in vs], "g string, i int, v double")
        got = bootstrap_interval(rows, ["g"], "i", "v").first()
        low, high = two_stage(items)
        assert abs(got.low - low) < 0.05 and abs(got.high - high) < 0.05, sizes


def test_one_item_has_an_interval_of_no_width(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "g string, i int, v double")
    assert {(r.low, r.high) for r in bootstrap_interval(rows, ["g"], "i", "v").collect()} == {(1.0, 1.0), (2.0, 2.0)}
    assert paired_bootstrap(rows, "g", "i", "v").first().diff == -1.0


def test_seats_of_nothing_and_of_too_much(spark):
    empty = spark.createDataFrame([("a", 0), ("b", 0)], "name string, size long")
    assert [r.seats for r in largest_remainder(empty, "name", "size", 5).collect()] == [0, 0]
    some = spark.createDataFrame([("a", 2), ("b", 3)], "name string, size long")
    assert sorted(r.seats for r in largest_remainder(some, "name", "size", 9).collect()) == [2, 3]


def test_unusable_vectors_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.9, 0.1]), (5, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in knn(rows, rows.where("vec_id = 1")).collect()] == [(1, 4)]


def test_latest_keys_with_ties_and_long_numbers(spark):
    row = spark.createDataFrame([({"a-1": "x", "a-01": "y", "b": "z", "b-20240101120000": "w"},)], "m map<string,string>")
    got = row.select(latest_keys(F.col("m")).alias("m")).first().m
    assert got["b"] == "w" and got["a"] in ("x", "y") and len(got) == 2


def test_discordance_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = rng.integers(0, 30, (200, 2)).astype(float)
    want = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for i, a in enumerate(points) for b in points[:i]) / (200 * 199 / 2)
    assert abs(discordance(spark.createDataFrame(points.tolist(), "x double, y double"), "x", "y", run=40).first().divergence - want) < 1e-9


def in_blocks(spark, batch, **more):
    """knn with blocks of `batch` queries that Spark may not put together in one task, against plain Python."""
    rng = np.random.default_rng(5)
    vectors = [(i, v, i % 3) for i, v in enumerate(np.repeat(rng.normal(size=(150, 6)), 2, axis=0).tolist())]  # each twice: ties
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn(rows, rows.where("vec_id % 5 = 0"), 7, batch=batch, **more).collect())
    finally:
        spark.conf.set(key, before)
    want = []
    for i, a, _ in vectors[::5]:
        near = [(-round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9), j) for j, b, label in vectors if j != i and (not more or label == 1)]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(near)[:7], 1)]
    return got, want


def test_nearest_neighbours_in_many_blocks(spark):
    got, want = in_blocks(spark, 8)  # 60 queries, 300 rows: 8 blocks by 10
    assert got == want


def test_nearest_neighbours_of_one_label_in_many_blocks(spark):
    got, want = in_blocks(spark, 2, where="label = 1")
    assert got == want
