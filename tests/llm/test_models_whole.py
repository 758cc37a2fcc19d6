"""Whole predictions of the learned operators against plain numpy."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import lang_id, lm_score, quality
from corvane.llm.common import ship


@pytest.mark.parametrize("head", [0, 1, 2, 3, 5, 6, 7, 100])
def test_the_head_never_holds_more_words_than_it_may(spark, head):
    counts = [100_002, 100_002, 100_003, 7, 7, 10**12 + 1, 10**12]
    df = spark.createDataFrame([(f"w{i}".encode(), c) for i, c in enumerate(counts)], "word binary, c long")
    least = lm_score.least_count(df, head)
    taken = sum(c >= least for c in counts)
    assert taken <= head and (taken == len(counts) or sum(c >= max(x for x in counts if x < least) for c in counts) > head)


def test_a_long_sequence_is_one_sequence(monkeypatch):
    rng = np.random.default_rng(3)
    m = lm_score.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T)
    for n in (9, 10, 11, 47):
        s = rng.integers(0, 6, n).astype(np.int32)
        want, got = [(np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))) for _ in range(2)]
        m.expect([s], *want)
        monkeypatch.setattr(lm_score, "SEGMENT", 5)
        m.expect([s], *got)
        monkeypatch.undo()
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(want, got))


def test_the_model_is_that_of_rounds_over_all_training_texts(spark):
    """More texts than any sample of a thousand: every training text counts in every round, from overall frequencies on."""
    ship(spark)
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"] if i % 2 else ["c", "e", "f", "g"], 1 + i % 6)) for i in range(1600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.lm_score(docs, F.col("doc_id") % 4 != 1, states=2, rounds=3, seed=5).collect()}
    split = lambda t: [*t.split(), "\n"]
    c = Counter(w for i, t in enumerate(texts) if i % 4 != 1 for w in split(t))
    listed = sorted(c, key=lambda w: (-c[w], w))
    overall = np.array([c[w] + 0.5 for w in listed] + [0.5]) / (sum(c.values()) + 0.5 * len(c) + 0.5)

    def model(starts, moves, emits):
        emits = emits + 50 * overall[:, None]
        return (starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emits / emits.sum(0)

    def chances(m, line):
        alphas = [m[0] * m[2][line[0]]]
        for s in line[1:]:
            alphas.append(alphas[-1] @ m[1] * m[2][s])
        return alphas

    lines = [[listed.index(w) for w in split(t)] for t in texts]
    m = model(np.ones(2), 3000 * np.eye(2), overall[:, None] * np.random.default_rng(5).gamma(1.0, 1.0, (len(overall), 2)) * 5000)
    for _ in range(3):
        starts, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((len(overall), 2))
        for line in (x for i, x in enumerate(lines) if i % 4 != 1):
            alphas, beta = chances(m, line), np.ones(2)
            p = alphas[-1].sum()
            for t in range(len(line) - 1, -1, -1):
                emits[line[t]] += alphas[t] * beta / p
                if t:
                    moves += np.outer(alphas[t - 1], m[2][line[t]] * beta) * m[1] / p
                    beta = m[1] @ (m[2][line[t]] * beta)
                else:
                    starts += alphas[0] * beta / p
        m = model(starts, moves, emits)
    assert abs(m[2][:, 0] - m[2][:, 1]).max() > 0.05  # the states have parted
    for i, line in enumerate(lines):
        assert abs(got[i] - math.log10(chances(m, line)[-1].sum())) < 1e-4, i


def test_likelihoods_of_long_and_unlikely_sequences(monkeypatch):
    rng = np.random.default_rng(4)
    emit = np.array([[1.0, 1e-13, 1e-13], [1e-13, 1.0, 1e-13], [1e-13, 1e-13, 1.0], [1e-12, 1e-11, 1e-10]])
    m = lm_score.Hmm(np.full(3, 1 / 3), np.full((3, 3), 1e-13) + np.eye(3), emit)
    for n in (1, 2, 9, 300):
        s = rng.integers(0, 4, n).astype(np.int32)
        log = np.log(m.start) + np.log(emit[s[0]])
        for x in s[1:]:
            log = np.logaddexp.reduce(log[:, None] + np.log(m.move), axis=0) + np.log(emit[x])
        want = np.logaddexp.reduce(log) / math.log(10)
        assert m.log10([s])[0] == pytest.approx(want)
        monkeypatch.setattr(lm_score, "SEGMENT", 5)
        assert m.log10([s[:1], s, s[:4]])[1] == pytest.approx(want)
        sums = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
        m.expect([s], *sums)
        monkeypatch.undo()
        assert np.isfinite(sums[2]).all() and sums[0].sum() == pytest.approx(1) and sums[1].sum() == pytest.approx(n - 1)
        assert np.allclose(sums[2].sum(1), np.bincount(s, minlength=4))


@pytest.mark.parametrize(("head", "symbols"), [(100, 50), (4, 2), (3, 9)])
def test_scores_of_one_state_are_shares_of_words(spark, head, symbols, monkeypatch):
    ship(spark)
    monkeypatch.setattr(lm_score, "LONG_WORD", 8)
    texts = ["the cat sat on the mat", "The CAT", None, "", "unseen words only", "the dog sat", "abcdefghij " * 20, "the abcdefghij", "mat mat the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.lm_score(docs, F.col("doc_id") % 4 != 1, head=head, symbols=symbols, states=1).collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"]
    c = Counter(w for i, t in enumerate(texts) if i % 4 != 1 for w in split(t))
    n = sum(c.values())
    brief = sorted((w for w in c if len(w.encode()) <= 8), key=lambda w: -c[w])
    least = next((x for x in sorted(set(c.values())) if sum(c[w] >= x for w in brief) <= head), max(c.values()) + 1)
    listed = sorted({w for w in brief if c[w] >= least} | {"\n"}, key=lambda w: (-c[w], w.encode()))
    own = listed[:symbols]
    overall = {w: c[w] + 0.5 for w in own}
    rest = n - sum(c[w] for w in own)
    total = sum(overall.values()) + rest + 0.5
    emit = {w: (c[w] + 50 * overall[w] / total) / (n + 50) for w in own}
    rare = (rest + 50 * (rest + 0.5) / total) / (n + 50)
    one = lambda w: math.log10(emit[w]) if w in emit else math.log10(rare) + math.log10((c[w] + 0.5) / (rest + 0.5 * (len(c) - len(own) + 1)))
    for i, t in enumerate(texts):
        assert abs(got[i] - sum(map(one, split(t)))) < 1e-4, (i, t)


def test_quality_scores_equal_the_densities(spark, sf_dir):
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Wort! " * 200_000), (10**6 + 3, "Wort! " * 200_000), (None, "a b")], docs.schema))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").unionByName(spark.createDataFrame([(10**6, 1), (10**6 + 1, None), (10**6 + 2, 7)], "doc_id long, quality int"))
    train = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r for r in quality.score_quality(docs, labels, train).collect()}
    rows = {r.doc_id: np.clip(quality.statistics(r.text), -20, 20) for r in docs.collect()}
    marked = [(r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in rows and r.doc_id % 3 != 0]
    x, y = np.array([rows[i] for i, _ in marked]), np.array([q for _, q in marked])
    means = [x[y == c].mean(0) for c in (0, 1)]
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    shared = sum(np.mean(y == c) * covs[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        w = min(1.0, quality.SHRINK_SHARED + x.shape[1] / (y == c).sum())
        cov = (1 - w) * covs[c] + w * shared
        cov = (1 - quality.SHRINK_DIAGONAL) * cov + quality.SHRINK_DIAGONAL * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(len(cov))
        solved = {i: np.linalg.solve(cov, v - means[c]) for i, v in rows.items()}
        logs.append({i: np.log(np.mean(y == c)) - np.linalg.slogdet(cov)[1] / 2 - (v - means[c]) @ solved[i] / 2 for i, v in rows.items()})
    assert len(got) == len(rows)
    for i in rows:
        want = 1 / (1 + math.exp(-np.clip(logs[1][i] - logs[0][i], -700, 700)))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == (got[i].score >= 0.7)
    assert got[10**6 + 2].score == got[10**6 + 3].score  # equal texts, long ones


def test_languages_are_those_of_the_nearest_centroid(spark, sf_dir):
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 :", "en"), (10**6 + 2, "viele Worte " * 50_000, None)], docs.schema))
    train = F.col("doc_id") % 4 != 2
    model = lang_id.fit(docs.where(train))
    got = {r.doc_id: r for r in lang_id.identify_language(docs, train).collect()}
    for r in docs.collect():
        told = got[r.doc_id]
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (told.lang_pred, told.score, told.rejected) == ("und", 0.0, True)
            continue
        counts, _ = lang_id.gram_counts(r.text)
        v = np.log1p(counts) * model.idf
        near = model.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        best = near.max()
        assert abs(told.score - np.clip(best, 0, 1)) < 1e-4
        close = {model.langs[model.lang_of[k]] for k in np.flatnonzero(near >= best - 1e-5)}
        assert told.lang_pred in close


def test_a_tie_between_centroids_goes_to_the_first_language():
    one = np.zeros((2, lang_id.FEATURES))
    counts, _ = lang_id.gram_counts("same words")
    one[:] = np.log1p(counts) / np.linalg.norm(np.log1p(counts))
    m = lang_id.Model(["aa", "bb"], np.ones(lang_id.FEATURES), one, np.array([0, 1]), np.zeros(13))
    assert m.predict("same words")[0] == "aa"
