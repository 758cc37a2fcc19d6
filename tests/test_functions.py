"""Column functions and operators against plain Python on small and odd inputs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from corvane.functions import ranking as rk
from corvane.functions import scores as sc
from corvane.functions import text as tx
from corvane.operators import selection as sel
from corvane.operators import statistics as st
from corvane.operators.bootstrap import bootstrap_interval

LISTS = [([], []), (["a"], []), ([], ["a"]), (["a", "b", "c"], ["b"]), (["a", "a", "b"], ["a", "c"]), (["x", "y"], ["a", "b", "c"]), (["c", "b", "a"], ["a", "b", "c"])]


def gain(hits):
    return sum(h / math.log2(i + 2) for i, h in enumerate(hits))


def slow(ranked, gold, k):
    top = ranked[:k] if k > 0 else []
    hit = [x in gold for x in ranked]
    first = next((i for i, h in enumerate(hit, 1) if h), None)
    found = [sum(hit[:i]) / i for i, h in enumerate(hit, 1) if h]
    return {
        "p": sum(x in gold for x in top) / k if k > 0 else 0.0,
        "r": len(set(top) & set(gold)) / len(set(gold)) if gold else 0.0,
        "rr": 1 / first if first else 0.0,
        "n": gain([x in gold for x in top]) / gain([1] * min(k, len(set(gold)))) if gold and k > 0 else 0.0,
        "ap": sum(found) / len(found) if found else 0.0,
    }


@pytest.mark.parametrize("k", [0, 1, 2, 10])
def test_rankings(spark, k):
    df = spark.createDataFrame([(i, r, g) for i, (r, g) in enumerate(LISTS)], "i int, ranked array<string>, gold array<string>")
    r, g = F.col("ranked"), F.col("gold")
    rows = df.select("i", rk.precision_at_k(r, g, k).alias("p"), rk.recall_at_k(r, g, k).alias("r"), rk.reciprocal_rank(r, g).alias("rr"), rk.ndcg_at_k(r, g, k).alias("n"), rk.average_precision(r, g).alias("ap"), rk.gold_presence(r, g).alias("has"), rk.unavailable_if_no_gold(F.lit(1.0), g).alias("u")).collect()
    for row in rows:
        ranked, gold = LISTS[row.i]
        assert {c: row[c] for c in ("p", "r", "rr", "n", "ap")} == pytest.approx(slow(ranked, gold, k))
        assert row.has == (None if not gold else bool(set(ranked) & set(gold))) and (row.u is None) == (not gold)


def test_scores(spark):
    values = [0.5, -3.0, 7.0, float("nan"), float("inf"), float("-inf"), None, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    rows = df.select("x", sc.clip(x).alias("c"), sc.finite(x).alias("f"), sc.sigmoid(x).alias("s"), sc.weighted_mean([(x, 0.5), (F.lit(1.0), 0.5)]).alias("w"), sc.weighted_mean([(x, 1.0)]).alias("one")).collect()
    assert [r.f for r in rows] == [0.5, -3.0, 7.0, 0.0, 0.0, 0.0, None, 0.0]
    assert rows[6].c is None and rows[6].w == 1.0 and rows[6].one is None and rows[1].c == 0.0 and rows[2].c == 1.0
    assert rows[4].s == 1.0 and rows[5].s == 0.0 and rows[0].s == pytest.approx(1 / (1 + math.exp(-0.5)))


def test_cosine(spark):
    pairs = [([1.0, 0.0], [1.0, 1.0]), ([], []), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), ([2.0, 2.0], [1.0, 1.0])]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<float>, b array<float>").select(sc.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 0.0, 0.0, 0.0, 1.0])


def test_texts(spark):
    df = spark.createDataFrame([("The Cat, the É-dog! Again. See [2] or n1", ["n1", "n2"])], "t string, ids array<string>")
    x = F.col("t")
    row = df.select(
        tx.words(x).alias("w"), tx.content_words(x, ["the", "or"]).alias("c"), F.size(tx.sentence_words(x)).alias("n"), tx.any_phrase(x, ["see [2]"]).alias("p"), tx.cited_places(x, F.col("ids")).alias("cited"),
        tx.split_tags(F.lit(" a, b,,a ,none"), ",", ("none",)).alias("tags"), tx.plain_title(F.lit("Big Title - North (old)")).alias("title"), tx.first_number(F.lit("score: -3.5 of 5")).alias("num"), tx.first_number(F.lit("no")).alias("none"),
    ).first()
    assert row.w == ["the", "cat", "the", "É", "dog", "again", "see", "2", "or", "n1"] and "the" not in row.c and row.n == 3
    assert row.p and sorted(row.cited) == ["n1", "n2"] and row.tags == ["a", "b"] and row.title == "big title" and row.num == -3.5 and row.none is None


def test_variance_of_unequal_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [("m", i, float(rng.normal(i % 5, 1))) for i in range(40) for _ in range(1 + i % 4)] + [("m", 0, None), ("one", 1, 2.0)]
    got = {r.g: r for r in st.variance_components(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "i", "v").collect()}
    groups = {}
    for g, i, v in rows:
        if g == "m" and v is not None:
            groups.setdefault(i, []).append(v)
    n, reps = sum(map(len, groups.values())), [len(x) for x in groups.values()]
    grand = sum(map(sum, groups.values())) / n
    within = sum(sum((v - np.mean(x)) ** 2 for v in x) for x in groups.values()) / (n - len(groups))
    between = sum(len(x) * (np.mean(x) - grand) ** 2 for x in groups.values()) / (len(groups) - 1)
    r0 = (n - sum(r * r for r in reps) / n) / (len(groups) - 1)
    assert got["m"].within == pytest.approx(within) and got["m"].between == pytest.approx(max(0, (between - within) / r0))
    assert (got["one"].within, got["one"].between) == (0.0, 0.0)
    assert st.normal_interval(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "i", "v").where("g = 'one'").first().insufficient


def test_bootstrap_is_near_the_normal_interval(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("m", i, float(v)) for i in range(300) for v in rng.normal(10, 2, 1)], "g string, i int, v double")
    a, b = bootstrap_interval(df, ["g"], "i", "v").first(), st.normal_interval(df, ["g"], "i", "v").first()
    assert abs(a.low - b.low) < 0.1 and abs(a.high - b.high) < 0.1
    again = bootstrap_interval(df, ["g"], "i", "v").first()
    assert (again.low, again.high) == pytest.approx((a.low, a.high), abs=1e-12)


def test_agreement_of_constants_and_ties(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("t", 1.0, 1.0), ("t", 1.0, 2.0), ("t", 2.0, 3.0), ("n", None, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in st.agreement(df, ["g"], "x", "y").collect()}
    assert got["c"].spearman is None and got["t"].spearman == pytest.approx(np.corrcoef([1.5, 1.5, 3], [1, 2, 3])[0, 1]) and "n" not in got


@settings(max_examples=8, deadline=None)
@given(s.lists(s.integers(1, 40), min_size=1, max_size=6), s.integers(0, 60))
def test_seats(spark, sizes, total):
    total = min(total, sum(sizes))
    rows = sel.largest_remainder(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "name string, size long"), "name", "size", total).collect()
    assert sum(r.seats for r in rows) == total and all(0 <= r.seats <= r.size for r in rows)


def test_pareto_with_ties(spark):
    points = [("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("d", 2.0, 3.0), ("e", 0.5, 0.5), ("f", None, 1.0)]
    got = {r.k for r in st.pareto(spark.createDataFrame(points, "k string, cost double, q double"), "q", "cost").collect() if r.on_front}
    assert got == {"a", "b", "d", "e"}


def test_scores_are_rounded_as_in_sql(spark, tmp_path):
    from corvane.functions.scores import rounded
    from corvane.queries_scoring import answer_scores

    x = [9.58199, 4.67221, 23.83619, -9.58199, 12.29175443950000, 0.0]
    half = lambda v, n: math.copysign(math.floor(abs(v * 10.0**n) + 0.5) / 10.0**n, v)
    close = [0.35 * (v / 100) + (1 - 0.35) * (v / 200) for v in x]
    odd = [float("inf"), float("nan"), 1e305, None, 0.49999999999999994]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*close, *odd])], "i int, v double")
    got = [r.r for r in df.select("i", rounded(F.col("v"), 9).alias("r")).orderBy("i").collect()]
    assert got[:6] == [half(v, 9) for v in close] and got[6] == odd[0] and math.isnan(got[7]) and got[8:] == [1e305, None, 0.5]
    assert [r.r for r in df.where("i = 10").select(rounded(F.col("v"), 0).alias("r")).collect()] == [0.0]
    spark.createDataFrame([(i, "click", v, '{"k": 1}') for i, v in enumerate(x) if v >= 0], "event_id long, event_type string, value double, props string").write.parquet(f"file://{tmp_path}/events.parquet")
    told = {r.event_id: r.closeness for r in answer_scores(spark, f"file://{tmp_path}").collect()}
    assert told == {i: half(close[i], 9) for i, v in enumerate(x) if v >= 0}
