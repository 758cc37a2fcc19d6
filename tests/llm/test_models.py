import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import lang_id, quality, queries
from corvane.llm.common import remainder, ship
from corvane.llm.lm_score import Hmm, lm_score, maximised


def model(k=3, v=5, seed=0):
    rng = np.random.default_rng(seed)
    return Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T)


def paths(m, seq):
    for z in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[z[0]] * m.emit[seq[0], z[0]]
        for t in range(1, len(seq)):
            p *= m.move[z[t - 1], z[t]] * m.emit[seq[t], z[t]]
        yield z, p


def test_likelihood_and_expected_counts_equal_sums_over_paths():
    m = model()
    seqs = [np.array(s, np.int32) for s in ([0, 1, 2, 4, 4, 0], [3], [1, 1, 3], [2, 0, 2, 0, 1])]
    got = m.log10(seqs)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    m.expect(seqs, starts, moves, emits)
    s2, m2, e2 = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for seq, g in zip(seqs, got, strict=True):
        total = sum(p for _, p in paths(m, seq))
        assert g == pytest.approx(math.log10(total))
        for z, p in paths(m, seq):
            s2[z[0]] += p / total
            for t, s in enumerate(seq):
                e2[s, z[t]] += p / total
                if t:
                    m2[z[t - 1], z[t]] += p / total
    assert np.allclose(starts, s2) and np.allclose(moves, m2) and np.allclose(emits, e2)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(1)
    true = model(2, 6, 3)
    seqs = [rng.choice(6, 40, p=true.emit[:, i % 2]).astype(np.int32) for i in range(60)]
    overall = np.bincount(np.concatenate(seqs), minlength=6) + 0.5
    overall /= overall.sum()
    m, before = model(2, 6, 9), -np.inf
    for _ in range(6):
        now = m.log10(seqs).sum()
        assert now >= before - 1
        before = now
        s, mv, e = np.zeros(2), np.zeros((2, 2)), np.zeros((6, 2))
        m.expect(seqs, s, mv, e)
        m = maximised(s, mv, e, overall)


@pytest.mark.parametrize(("head", "symbols"), [(131072, 32768), (3, 2), (1, 5)])
def test_base_scores_equal_brute_force(spark, head, symbols):
    ship(spark)
    texts = ["the cat sat on the mat", "The CAT", None, "", "unseen words only", "the dog\tsat\x1cx on é É", "mat " * 3000, "the cat sat on the mat"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "the cat")], "doc_id long, text string").withColumns({"row": F.lit(1), "c": F.lit(2), "word": F.lit("w")})
    train = F.col("doc_id") % 3 != 1
    got = lm_score(docs, train, head=head, symbols=symbols).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + ["\n"]
    c = Counter(w for i, t in enumerate(texts) if i % 3 != 1 for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 6)) for i, t in [*enumerate(texts), (None, "the cat")]), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score(docs.limit(0), train).count() == 0
    assert lm_score(docs, F.lit(False), head=head).count() == len(want)


def test_gram_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Der schöne  Wald, 12 und das Haus. " * 20
    whole, n = lang_id.gram_counts(text)
    for size in (7, 64, 333):
        monkeypatch.setattr(lang_id, "_BLOCK", size)
        parts, m = lang_id.gram_counts(text)
        assert m == n and np.array_equal(parts, whole)


def test_languages(spark, sf_dir):
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op4_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (4, "the words and the house", "en"), (5, "der die und das haus", "de"), (None, "the and of", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    named = {r.doc_id: r for r in lang_id.identify_language(odd, F.lit(True)).collect()}
    assert [named[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(named[i].rejected and named[i].score == 0 for i in (1, 2, 3))
    assert (named[4].lang_pred, named[5].lang_pred) == ("en", "de") and 0 <= named[None].score <= 1
    assert lang_id.identify_language(odd.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in lang_id.identify_language(odd, F.lit(False)).collect()} == {"und"}


def test_discriminant_equals_the_density_ratio():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((400, 3)), np.repeat([0, 1], [100, 300])
    x[y == 1] = x[y == 1] @ np.array([[1, 0.5, 0], [0, 2, 0], [0, 0, 0.3]]) + 1
    n, sums = np.array([100.0, 300.0]), np.array([x[y == c].sum(0) for c in (0, 1)])
    d = quality.discriminant(n, sums, np.array([x[y == c].T @ x[y == c] for c in (0, 1)]))
    logs = []
    for c in range(2):
        cov = np.linalg.inv(d.factors[c].T @ d.factors[c])
        diff = x - d.means[c]
        logs.append(np.log(n[c] / 400) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(d.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality(spark, sf_dir):
    ship(spark)
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    got = queries.op8_quality_classifier(spark, sf_dir).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.85 * len(got)
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a b c"), (3, "a b c")], "doc_id long, text string").withColumns({"y": F.lit(1), "score": F.lit("s")})
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (9, 1), (None, 1), (2, 5)], "doc_id long, quality int")
    rows = quality.score_quality(docs, labels, remainder("doc_id", 4) != 9).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in quality.score_quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels, F.lit(True)).count() == 0


def test_pipeline_stages_narrow_their_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34", "en", "s", 5), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    first = corpus_pipeline.language(spark, docs.unionByName(junk), sf_dir)
    assert first.columns == docs.columns and first.where(f"doc_id >= {10**6}").count() == 0
    assert first.count() >= 0.97 * docs.count()
    second = corpus_pipeline.quality(spark, docs, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    assert second.columns == docs.columns and second.join(good, "doc_id").count() >= 0.9 * good.join(docs, "doc_id").count()
    third = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs), sf_dir)
    assert third.count() == third.select("text").distinct().count() <= docs.count()
    assert queries.QUERIES["op2_packing"](spark, sf_dir).count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
