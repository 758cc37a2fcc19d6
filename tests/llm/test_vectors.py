import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, embedding_dedup as ed
from corvane.llm.common import ship


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        c = rng.standard_normal(dim)
        out += [(c + s * rng.standard_normal(dim)).astype(np.float32).tolist() for s in rng.choice([0.02, 0.1, 0.14, 0.3], 5)]
    return out[:n]


def brute_links(rows, threshold=0.98):
    usable = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x, la) in enumerate(usable):
        for b, y, lb in usable[:n]:
            if la == lb and len(x) == len(y):
                u, v = np.array(x, float), np.array(y, float)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("block", [1024, 7])
def test_dedup_equals_brute_force(spark, block, monkeypatch):
    ship(spark)
    monkeypatch.setattr(ed, "BLOCK", block)
    vectors = clustered(260, 16, 1)
    rows = [(1000 - i, v, i % 2) for i, v in enumerate(vectors)] + [(2000 + i, vectors[3], 1) for i in range(30)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(3000 + i, v, 1) for i, v in enumerate(odd)] + [(4000, vectors[0], None), (4001, vectors[0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"t": F.lit(1), "keys": F.lit("x"), "links": F.lit(2)})
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.embedding_dedup(df).collect()}
    want = brute_links(rows)
    assert set(got) == set(want) and {i for i in got if got[i] != want[i]} == set()
    nameless = spark.createDataFrame([(None, vectors[0], 1)], df.select("vec_id", "embedding", "label").schema)
    assert [tuple(r) for r in ed.embedding_dedup(nameless).collect()] == [(None, 0, None, False)]
    assert ed.embedding_dedup(df.limit(0)).count() == 0


def brute_top(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {i: sorted(((-float((q * v).sum()), j) for j, v in ok if j != i))[:k] for i, q in ok if i % 20 == 0}


def test_search_against_brute_force(spark, monkeypatch):
    ship(spark)
    vectors = clustered(600, 12, 2)
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[5]) for i in range(40)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 12), (2060, [float("nan")] * 12), (2080, [1.0, 2.0]), (2100, [None] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_top(rows, 20)
    exact = ann.ann_search(df, "vec_id % 20 = 0", recall=1.0, branching=4).collect()
    recall = np.mean([len({j for _, j in want[i]} & {r.vec_id for r in exact if r.query_id == i}) / 20 for i in want])
    assert recall == 1.0 and len(exact) == 20 * len(want)
    for i in want:
        got = sorted((r.rank, r.vec_id, r.score) for r in exact if r.query_id == i)
        assert [r[1] for r in got] == [j for _, j in want[i]] and [r[0] for r in got] == list(range(1, 21))
        assert np.allclose([r[2] for r in got], [-s for s, _ in want[i]], rtol=0, atol=1e-12)
    monkeypatch.setattr(ann, "MEMBERS", 50)
    monkeypatch.setattr(ann, "QUERIES", 9)
    some = ann.ann_search(df, "vec_id % 20 = 0", branching=4).collect()
    recall = np.mean([len({j for _, j in want[i]} & {r.vec_id for r in some if r.query_id == i}) / 20 for i in want])
    assert recall >= 0.9 and len(some) == len(exact)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.ann_search(df, "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert ann.ann_search(df.limit(0), "vec_id % 20 = 0").count() == 0
