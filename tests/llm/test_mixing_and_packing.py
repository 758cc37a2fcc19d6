import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.mixing import bisect_exponent, mix_plan, mix_sources, source_weights
from corvane.llm.packing import boundaries, pack



def skewed(spark):
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else f"s{i % 5}"), 1 + i * 7 % 50) for i in range(600)] + [(9000, None, 11), (9001, None, 4), (None, "big", 5), (5, "big", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, n long").withColumns({"tokens": F.lit(1), "quota": F.lit(2), "text": F.lit("x"), "pass": F.lit(1)})


def slow_exponent(totals, target, budget, most):
    p = np.array(totals) / sum(totals)

    def entropy(a):
        q = p**a / (p**a).sum()
        return -(q * np.log(q)).sum()

    def repeats(a):
        q = p**a / (p**a).sum()
        return (q * budget / np.array(totals)).max()

    ok = [a for a in np.linspace(0, 1, 200_001) if entropy(a) >= target * math.log(len(p)) - 1e-12]
    fine = [a for a in np.linspace(0, 1, 200_001) if repeats(a) <= most * (1 + 1e-12)]
    return max(max(ok, default=0.0), min(fine, default=1.0))


@pytest.mark.parametrize(("target", "most"), [(0.9, 100.0), (0.99, 2.0), (0.2, 4.0), (1.0, 1000.0)])
def test_exponent(spark, target, most):
    totals = [5000, 900, 300, 40, 10]
    sources = spark.createDataFrame([(f"s{i}", float(t)) for i, t in enumerate(totals)], "source string, tokens double")
    got = bisect_exponent(sources, 5, float(sum(totals)), target, float(sum(totals)), most)
    assert got == pytest.approx(slow_exponent(totals, target, sum(totals), most), abs=1e-5)


@pytest.mark.parametrize("run", [2000, 7])
def test_plan_equals_brute_force(spark, run, monkeypatch):
    from corvane.llm import mixing

    monkeypatch.setattr(mixing, "RUN", run)
    docs = skewed(spark)
    how = {"tokens": F.col("n"), "target_entropy": 0.95, "max_repeat": 3.0, "blocks": 8}
    got = sorted(((r.doc_id, r.source, r["pass"], r.block) for r in mix_plan(docs, **how).collect()), key=str)
    weights, _ = source_weights(docs, "source", F.col("n"), 0.95, 1.0, 3.0)
    want = []
    for w in weights.collect():
        rows = [r for r in docs.collect() if r.source == w.source and r.n > 0]
        start = 0
        for p in range(max(1, math.ceil(w.repeats))):
            keyed = sorted((hashlib.md5(f"17:{p}:{'' if r.doc_id is None else r.doc_id}:{r.n}".encode()).hexdigest(), r.doc_id, r.n) for r in rows)
            for _, i, n in keyed:
                if start < w.quota:
                    want.append((i, w.source, p, min(7, int(start / w.quota * 8))))
                start += n
    assert got == sorted(want, key=str)
    shares = {w.source: w.weight for w in weights.collect()}
    assert sum(shares.values()) == pytest.approx(1) and all(w.repeats <= 3.0 + 1e-6 for w in weights.collect())


def test_mixture_keeps_columns_and_repeats(spark):
    docs = skewed(spark).withColumn("text", F.repeat(F.lit("w "), F.col("n").cast("int")))
    mixed = mix_sources(docs, target_entropy=0.95, max_repeat=3.0)
    assert mixed.columns == docs.columns
    plan = mix_plan(docs, target_entropy=0.95, max_repeat=3.0)
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]
    twice = docs.unionByName(docs)
    assert mix_sources(twice, target_entropy=0.95, max_repeat=3.0).count() == mix_plan(twice, target_entropy=0.95, max_repeat=3.0).agg(F.sum("copies")).first()[0]
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_boundaries_have_least_padding():
    rng = np.random.default_rng(4)
    for _ in range(20):
        tops = np.sort(rng.choice(60, 9, replace=False)) + 1
        counts = rng.integers(1, 30, 9)
        best = min(
            (sum(c * (min(b for b in (*some, tops[-1]) if b >= t) - t) for t, c in zip(tops, counts, strict=True)))
            for k in range(0, 3) for some in itertools.combinations(tops[:-1].tolist(), k)
        )
        got = boundaries(tops, counts, counts * tops, 3)
        assert len(got) <= 3 and got[-1] == tops[-1]
        assert sum(c * (min(b for b in got if b >= t) - t) for t, c in zip(tops, counts, strict=True)) == best


def test_packing(spark, monkeypatch):
    from corvane.llm import packing

    monkeypatch.setattr(packing, "RUN", 13)
    rows = [(i, 1 + i * i % 97) for i in range(300)] + [(None, 5), (7, 5), (7, 5), (1000, 100_000), (1001, 0), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, n long").withColumn("text", F.when(F.col("n").isNotNull(), F.repeat(F.lit("é\t"), F.col("n").cast("int")))).withColumns({"bucket": F.lit(1), "batch": F.lit(0)})
    got = pack(docs, budget=512, buckets=6).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got if r.doc_id) == sorted((i, n or 0) for i, n in rows if i)
    assert len(got) == len(rows) and len({(r.bucket, r.batch, r.slot) for r in got}) == len(rows)
    assert all(0 <= r.padding == r.bucket_len - r.n_tokens for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), held in batches.items():
        assert len(held) == 1 or sum(r.bucket_len for r in held) <= 512
        if (bucket, batch + 1) in batches:  # only the last batch of a bucket may be short
            assert len(held) == max(1, 512 // max(1, held[0].bucket_len))
        assert sorted(r.slot for r in held) == list(range(len(held)))
    assert pack(docs.limit(0)).count() == 0


def test_long_lengths_are_told_apart_exactly(spark):
    lengths = [5000, 5001, 5003, 9000, 9001, 40_000, 40_007, 3, 4, 4, None]
    docs = spark.createDataFrame([(i if i % 4 else None, n, 1) for i, n in enumerate(lengths)], "doc_id long, n long, bucket int")
    for buckets in (1, 2, 3, 5):
        rows = pack(docs, tokens=F.coalesce("n", F.lit(0)), buckets=buckets, budget=10_000).collect()
        have = sorted({n or 0 for n in lengths})
        best = min(sum(min(t for t in tops if t >= (n or 0)) - (n or 0) for n in lengths) for k in range(1, buckets + 1) for tops in itertools.combinations(have, min(k, len(have))) if max(tops) == max(have))
        assert sum(r.padding for r in rows) == best and len(rows) == len(lengths)
        assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
