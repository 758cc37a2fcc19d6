"""Calibration, bootstrap, discordance, similarity, combinations, orders, planning and markup against plain Python."""

import json
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import answers as an
from corvane.functions import markup as mk
from corvane.functions import text as tx
from corvane.operators import planning as pl
from corvane.operators import reports as rp
from corvane.operators import selection as sel
from corvane.operators import statistics as st
from corvane.operators.bootstrap import bootstrap_interval, difference_bootstrap, mean_bootstrap
from corvane.operators.calibration import calibrated, platt
from corvane.operators.ordering import running
from corvane.operators.retrieval import bm25
from corvane.operators.similarity import similarity_edges
from corvane.sources import corpus


def descended(x, y, steps=20_000, rate=0.5):
    """Slope and intercept by full-batch gradient descent on standardised scores."""
    mean, sd = x.mean(), x.std()
    z, a, b = (x - mean) / sd, 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - rate * np.mean((p - y) * z), b - rate * np.mean(p - y)
    return a / sd, b - a * mean / sd


def test_curves_are_where_gradient_descent_goes(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, (slope, shift, n) in {"a": (0.8, -1.0, 400), "b": (-3.0, 0.5, 90), "c": (0.0, 2.0, 300), None: (1.5, 10.0, 200)}.items():
        x = rng.normal(5, 3, n)
        y = (rng.random(n) < 1 / (1 + np.exp(-np.clip(slope * (x - 5) - shift + 1, -9, 9)))).astype(int)
        y[:2] = [0, 1]
        want[g] = descended(x, y)
        rows += [(g, float(v), int(k), 1, 2) for v, k in zip(x, y)]
    rows += [("one", 1.0, 1, 0, 0), ("one", 2.0, 1, 0, 0), ("flat", 3.0, 1, 0, 0), ("flat", 3.0, 0, 0, 0), ("a", None, 1, 0, 0), ("a", 1.0, None, 0, 0), ("split", 1.0, 0, 0, 0), ("split", 2.0, 1, 0, 0)]
    df = spark.createDataFrame(rows, "g string, score double, label int, _a int, w int")
    got = {r.g: r for r in platt(df, ["g"], "score", "label").collect()}
    for g, (slope, intercept) in want.items():
        assert got[g].settled and abs(got[g].slope - slope) < 1e-6 and abs(got[g].intercept - intercept) < 1e-5
    assert (got["one"].slope, got["one"].intercept, got["flat"].slope, got["flat"].intercept) == (1, 0, 1, 0)
    assert not got["split"].settled and got["split"].slope > 1
    told = calibrated(df, platt(df, ["g"], "score", "label"), ["g"], "score").where("g = 'one'").collect()
    assert all(abs(r.calibrated - 1 / (1 + math.exp(-r.score))) < 1e-12 for r in told)
    assert platt(df.where("false"), ["g"], "score", "label").count() == 0


def two_stage(items, draws=4000):
    rng = np.random.default_rng(3)
    return np.quantile([np.mean([np.mean(rng.choice(items[i], len(items[i]))) for i in rng.integers(0, len(items), len(items))]) for _ in range(draws)], [0.025, 0.975])


@pytest.mark.parametrize(("sizes", "few"), [([1] * 1500, 9), ([2] * 40, 1024), ([2000] * 3, 1024), ([1, 5, 300] * 8, 0), ([1, 5, 300] * 8, 1024)])
def test_bootstrap_at_any_number_of_repeats(spark, sizes, few, monkeypatch):
    monkeypatch.setattr("corvane.operators.bootstrap.FEW", few)
    monkeypatch.setattr("corvane.operators.bootstrap.LEAF", 7)  # trees of several levels over items, and over an item's values
    monkeypatch.setattr("corvane.operators.bootstrap.PIECE", 20)
    rng = np.random.default_rng(1)
    items = [rng.normal(rng.normal(0, 1), 2, n).round(2) for n in sizes]
    rows = spark.createDataFrame([("m", i, float(v)) for i, vs in enumerate(items) for v in vs], "g string, i int, v double")
    got = bootstrap_interval(rows, ["g"], "i", "v", draws=1000).first()
    low, high = two_stage(items, 1000 if len(sizes) > 1000 else 4000)
    width = high - low
    assert abs(got.low - low) < 0.15 * width and abs(got.high - high) < 0.15 * width and got.n_items == len(sizes)


def test_resamples_draw_as_many_items_as_there_are(spark, monkeypatch):
    monkeypatch.setattr("corvane.operators.bootstrap.LEAF", 3)
    from corvane.operators.bootstrap import bootstrap_draws

    rows = spark.createDataFrame([(g, i, 1.0) for g in "ab" for i in range(50)], "g string, i int, v double")
    assert {round(r.m, 12) for r in bootstrap_draws(rows, ["g"], "i", "v", 40, 1).collect()} == {1.0}


def test_bootstrap_of_a_mean_and_of_differences(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.3, 1, 200)
    rows = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(d)], "g string, i int, v double")
    got = difference_bootstrap(rows, ["g"], "i", "v", 2000).first()
    draws = d[rng.integers(0, 200, (4000, 200))].mean(1)
    want = np.mean(np.abs(draws - d.mean()) >= abs(d.mean()))
    assert abs(got.p_value - want) < 0.02 and abs(got.low - np.quantile(draws, 0.025)) < 0.05
    one = mean_bootstrap(rows, ["g"], "i", "v", 2000).first()
    assert abs(one.low - np.quantile(draws, 0.025)) < 0.05 and abs(one.high - np.quantile(draws, 0.975)) < 0.05


@pytest.mark.parametrize("shape", ["ties", "one x", "apart"])
def test_discordance_counts_every_pair(spark, shape):
    rng = np.random.default_rng(2)
    points = rng.integers(0, 12, (300, 2)).astype(float) if shape == "ties" else rng.normal(0, 1, (300, 2))
    if shape == "one x":
        points[:120, 0] = 0.5  # two fifths of all rows share a score
    want = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for i, a in enumerate(points) for b in points[:i]) / (300 * 299 / 2)
    got = st.discordance(spark.createDataFrame(points.tolist(), "x double, y double"), "x", "y", run=25).first()
    assert abs(got.divergence - want) < 1e-9 and got.pairs == 300 * 299 // 2


def test_single_valued_items_are_drawn_by_their_values(spark, monkeypatch):
    """Their law depends on how many items have each value, so other ids give the same resamples; others are drawn beside them."""
    from corvane.operators.bootstrap import bootstrap_draws

    monkeypatch.setattr("corvane.operators.bootstrap.LEAF", 4)  # trees of several levels, over values and over items
    rng = np.random.default_rng(11)
    alike = [("g" if i % 3 else None, i, float(v)) for i, v in enumerate(rng.integers(0, 30, 900))] + [("h", 1, 2.0), ("h", 1, 2.0)]
    frame = lambda rows: spark.createDataFrame(rows, "g string, i long, v double")
    drawn = lambda rows: {(r.g, r.draw): r.m for r in bootstrap_draws(frame(rows), ["g"], "i", "v", 2000, 1).collect()}
    got = drawn(alike)
    assert got == drawn([(g, i + 10**6, v) for g, i, v in alike]) and len(got) == 3 * 2000 and {got["h", d] for d in range(2000)} == {2.0}
    for g in ("g", None):
        values = np.array([v for group, _, v in alike if group == g])
        m = np.array([got[g, d] for d in range(2000)])
        sd = values.std() / len(values) ** 0.5
        assert abs(m.mean() - values.mean()) < 5 * sd / 2000**0.5 and abs(m.std() / sd - 1) < 0.1
    mixed = alike[:60] + [("g", 1000 + i % 40, float(v)) for i, v in enumerate(rng.normal(8, 20, 200))]
    mixed = [("g", i, v) for _, i, v in mixed]
    held = {}
    for _, i, v in mixed:
        held.setdefault(i, []).append(v)
    m = np.array(list(drawn(mixed).values()))
    means = np.array([np.mean(x) for x in held.values()])
    sd = ((means.var() + np.mean([np.var(x) / len(x) for x in held.values()])) / len(held)) ** 0.5
    assert abs(m.mean() - means.mean()) < 5 * sd / 2000**0.5 and abs(m.std() / sd - 1) < 0.1


def test_similarity_edges_are_all_there_are(spark):
    rng = np.random.default_rng(7)
    tokens = [f"t{i}" for i in range(30)]
    sets = [sorted(set(rng.choice(tokens, rng.integers(0, 12)))) for _ in range(120)]
    sets += [sets[3], sets[3][::-1], None]
    edges, members = similarity_edges(spark.createDataFrame([(i, s, 1) for i, s in enumerate(sets)], "id int, tokens array<string>, class_id int"), "id", "tokens", 0.6)
    classes = {r.id: r.class_id for r in members.collect()}
    plain = [frozenset(s or []) for s in sets]
    assert all(classes[i] == min(j for j, t in enumerate(plain) if t == s) for i, s in enumerate(plain))
    want = {(a, b) for a, b in combinations(sorted(set(classes.values())), 2) if plain[a] and len(plain[a] & plain[b]) / len(plain[a] | plain[b]) >= 0.6 - 1e-12}
    assert {(r.a, r.b) for r in edges.collect()} == want


def test_small_sets_of_frequent_tokens_form_few_pairs(spark):
    """Every set holds only frequent tokens, so that a token in common says little."""
    from corvane.operators.similarity import small_pairs

    rng = np.random.default_rng(8)
    sets = sorted({tuple(sorted({f"b{rng.integers(0, 12)}", f"t{rng.integers(0, 6)}", f"n{rng.integers(0, 8)}", f"m{rng.integers(0, 8)}", f"s{rng.integers(0, 10)}"})) for _ in range(1500)})
    sets += [x[: 1 + i % 4] for i, x in enumerate(sets[:40])] + [(*x, *(f"z{i % 3}{j}" for j in range(1 + i % 5))) for i, x in enumerate(sets[:60])]  # 1 to 4 tokens, 6 to 10
    plain = list(dict.fromkeys(sets))
    rows = spark.createDataFrame([(i, list(x)) for i, x in enumerate(plain)], "id int, tokens array<string>")
    held = [frozenset(x) for x in plain]
    like = {(a, b): round(i / (len(held[a]) + len(held[b]) - i), 9) for a, b in combinations(range(len(held)), 2) if (i := len(held[a] & held[b]))}
    for similarity in (0.6, 0.8):
        got = [(r.a, r.b, round(r.jaccard, 9)) for r in similarity_edges(rows, "id", "tokens", similarity)[0].collect()]
        assert sorted(got) == sorted((a, b, x) for (a, b), x in like.items() if x >= similarity - 1e-9)
    few = [i for i, x in enumerate(held) if len(x) <= 6]
    looked_at = small_pairs(rows.where(F.size("tokens") <= 6).select(F.col("id").alias("class_id"), "tokens"), 0.6).count()
    assert looked_at == sum(like.get(p, 0) >= 0.6 - 1e-9 for p in combinations(few, 2))  # before, a share of all pairs


def test_combinations_of_a_large_pool_come_at_once(spark):
    rows = spark.createDataFrame([("p", i) for i in range(200)] + [("q", i) for i in range(5)] + [("r", 1)], "pool string, m int")
    got = rp.combinations_of(rows, "pool", "m", 3, 100).collect()
    for pool, n in (("p", 200), ("q", 5)):
        mine = [r.members for r in sorted((r for r in got if r.pool == pool), key=lambda r: r.nth)]
        assert mine == [list(c) for c, _ in zip(combinations(range(n), 3), range(100))]
    assert not [r for r in got if r.pool == "r"]
    assert rp.combinations_of(rows.where("pool = 'p'"), "pool", "m", 5, 100).count() == 100


def test_running_totals_of_one_large_group(spark):
    rows = spark.createDataFrame([("a" if i % 5 else None, i, i % 3) for i in range(200)], "g string, at int, w int").repartition(7)
    got = {r.at: (r.before, r.all) for r in running(rows, ["g"], ["at"], "before", F.col("w"), "all").collect()}
    for i in range(200):
        own = [j for j in range(200) if bool(j % 5) == bool(i % 5)]
        assert got[i] == (sum(j % 3 for j in own if j < i), sum(j % 3 for j in own))


def test_names_that_operators_use_themselves(spark):
    names = "_h _cost _best _before _nth _run _better _island _exact _room _left _at _size _part _own _every _whole _of".split()
    rows = spark.createDataFrame([(i, i % 2, float(i % 5), *range(len(names))) for i in range(20)], "k int, g int, v double, " + ", ".join(f"{n} int" for n in names))
    told = rows.select(*names).distinct().collect()
    for got in (
        st.pareto(rows, "v", "k"), sel.hold_out(rows, "g", "k", 0.3, "s"), sel.hash_sample(rows, ["g"], ["k"], 30, "s"), sel.losing_streaks(rows, "g", ["k"], "v"),
        sel.largest_remainder(rows, "k", "g", 7), running(rows, ["g"], ["k"], "n"), pl.ladder(rows, "g", ["k"], [4, 20]), corpus.layered([rows, rows], ["k"]),
    ):
        assert got.count() == 20 and set(rows.columns) <= set(got.columns)
        assert got.select(*names).distinct().collect() == told


def test_rows_of_one_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "red fish"), (1, "red fish"), (2, "blue"), (3, None)], "doc_id int, text string")
    got = bm25(docs, spark.createDataFrame([(9, "red")], "query_id int, text string")).collect()
    assert [r.doc_id for r in got] == [1, 1] and got[0].score == got[1].score == round(math.log(1 + (4 - 2 + 0.5) / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 1.25)), 9)


def test_promotion_escalation_tournament(spark):
    one = spark.range(1)
    yes = lambda c: one.select(c.alias("x")).first().x
    assert yes(pl.promotion(F.lit(0.5), F.lit(0.56), 0.05, F.lit(True))) and not yes(pl.promotion(F.lit(0.5), F.lit(0.54), 0.05, F.lit(True)))
    assert not yes(pl.promotion(F.lit(0.5), F.lit(0.9), 0.05, F.lit(False))) and not yes(pl.promotion(F.lit(None).cast("double"), F.lit(0.9), 0.05, F.lit(True)))
    assert yes(pl.escalates(F.lit(0.1), F.lit(None).cast("double"), F.lit(0.1), F.lit(True))) and not yes(pl.escalates(F.lit(0.9), F.lit(None).cast("double"), F.lit(0.1), F.lit(False)))
    assert yes(pl.escalates(F.lit(0.45), F.lit(0.5), F.lit(0.05), F.lit(True), 1.0)) and not yes(pl.escalates(F.lit(0.44), F.lit(0.5), F.lit(0.05), F.lit(True), 1.0))
    won = lambda *x: tuple(pl.tournament(spark.createDataFrame(list(x), "v int, s double, h double"), "v", "s", "h", 0.05).first())
    assert won((0, 0.5, 0.1), (1, 0.6, 0.3)) == (1, 0.6, 0.3, False)
    assert won((0, 0.58, 0.1), (1, 0.6, 0.3)) == (1, 0.6, 0.3, True)
    assert won((0, 0.6, 0.2), (1, 0.6, 0.1)) == (1, 0.6, 0.1, True) and won((0, 0.6, 0.1), (1, 0.6, 0.1)) == (0, 0.6, 0.1, True)
    assert won((0, 0.6, None), (1, 0.6, 0.4)) == (1, 0.6, 0.4, True) and won((3, 0.2, None)) == (3, 0.2, None, False)
    assert pl.tournament(spark.createDataFrame([], "v int, s double, h double"), "v", "s", "h", 0.05).count() == 0


def test_a_rung_holds_all_of_the_rungs_before(spark):
    items = spark.createDataFrame([(s, i) for s, n in (("a", 30), ("b", 3), ("c", 9)) for i in range(n)], "s string, i int")
    got = pl.ladder(items, "s", ["i"], [3, 12, 100]).collect()
    assert [sum(r.rung <= k for r in got) for k in range(3)] == [3, 12, 42]
    assert all({r.i for r in got if r.s == s and r.rung <= k} == set(range(sum(r.s == s and r.rung <= k for r in got))) for s in "abc" for k in range(3))


def test_abstention_has_three_kinds_of_question(spark):
    rows = [(0.1, "unanswerable"), (0.6, "unanswerable"), (0.2, "answerable_retrievable"), (0.9, "answerable_retrievable"), (0.0, "answerable_not_retrieved"), (None, "unanswerable")]
    curve = st.abstention_curve(spark.createDataFrame(rows, "s double, k string"), "s", "k", [0.2, 0.5, 0.7])
    got = {r.threshold: (r.recall, r.false_answer, r.false_abstain) for r in curve.collect()}
    assert got == {0.2: (0.5, 0.5, 0.0), 0.5: (0.5, 0.5, 0.5), 0.7: (1.0, 0.0, 0.5)}
    assert tuple(st.operating_point(curve, 0.5).first()) == (0.7, 1.0, 0.0, 0.5)
    assert tuple(st.operating_point(curve.where("threshold < 0.7"), 0.5).first())[0] == 0.2
    assert tuple(st.operating_point(curve.where("threshold < 0.7"), 0.1).first()) == (0, 0, 0, 0)


def test_answers_are_scored_by_content_words(spark):
    stop = ["the", "of", "to"]
    row = spark.createDataFrame([("The of to cat.", ["id1", "id2"], ["the of to dog runs fast", "cat cat the"], "a cat and dog", "")], "answer string, ids array<string>, texts array<string>, ref string, none string")
    used = an.used_fragments(F.col("answer"), F.col("ids"), F.col("texts"), stop)
    f, c = an.cross_checks(F.col("answer"), F.col("ref"), F.col("texts"), stop)
    f0, c0 = an.cross_checks(F.col("none"), F.col("ref"), F.col("texts"), stop)
    p, r = an.coverage(F.col("ref"), F.array().cast("array<string>"), stop)
    blank = an.grounded_fraction(F.array(F.lit("cat"), F.lit("  "), F.lit(None).cast("string")), F.col("answer"), stop)
    got = row.select(used.alias("u"), f.alias("f"), c.alias("c"), f0.alias("f0"), c0.alias("c0"), p.alias("p"), r.alias("r"), blank.alias("b"), an.gain(F.lit(0.0), F.lit(-1.0))[1].alias("g"), an.gain(F.lit(2.0), F.lit(3.0))[1].alias("g2")).first()
    assert got.u == [] and (got.f, got.c, got.f0, got.c0, got.p, got.r, got.b, got.g, got.g2) == (1.0, 0.25, 1.0, 0.0, 0.0, 0.0, 1.0, math.inf, 50.0)
    cited = an.used_fragments(F.concat("answer", F.lit(" see [2]")), F.col("ids"), F.col("texts"), stop)
    assert row.select(cited.alias("u")).first().u == ["id2"]


def test_markdown_comes_back_as_it_was(spark):
    text = "# Top **bold** [x](http://a)\n#### deep\n\nplain __b__ line\ngoes on\n- one\n- two [l](u)\n1. first\n2) second\n\n* open ** mark\n"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "  \n"), (4, "**a [l](u) b**")], "i int, t string")
    read = {r.i: r for r in rows.select("i", mk.blocks(F.col("t")).alias("b")).select("*", mk.markdown_of(F.col("b")).alias("m"), mk.plain_text(F.col("b")).alias("p")).collect()}
    assert [b.kind for b in read[1].b] == ["h1", "h3", "p", "ul", "ol", "ul"] and [len(b.lines) for b in read[1].b] == [1, 1, 1, 2, 2, 1]
    assert [(x.text, x.bold, x.url) for x in read[1].b[0].lines[0]] == [("Top ", False, None), ("bold", True, None), (" ", False, None), ("x", False, "http://a")]
    assert [(x.text, x.bold, x.url) for x in read[4].b[0].lines[0]] == [("a ", True, None), ("l", True, "u"), (" b", True, None)]
    assert read[2].b == [] and read[3].b == [] and read[1].b[5].lines[0][0].text == "open ** mark"
    again = spark.createDataFrame([(read[i].m, i) for i in read], "m string, i int").select("i", mk.blocks(F.col("m")).alias("b")).collect()
    assert {r.i: r.b for r in again if r.i < 4} == {i: read[i].b for i in (1, 2, 3)}
    assert read[1].p.startswith("Top bold x (http://a) deep plain b line goes on one two l (u) first")


def test_texts_of_fields_and_an_index(spark, tmp_path):
    tree = json.dumps([{"children": [{"text": "see\xa0this"}, {"url": "http://x", "children": [{"text": "link"}]}]}])
    rows = spark.createDataFrame([({"b": tree, "a": "plain  text", "c": None}, {"b": "rich_text"}), ({"b": json.dumps(tree)}, {"b": "rich_text"}), ({"b": "{bad"}, {"b": "rich_text"}), ({}, {})], "f map<string,string>, k map<string,string>")
    got = [r.t for r in rows.select(corpus.texts_of_fields(F.col("f"), F.col("k")).alias("t")).collect()]
    assert got == ["plain text see this link (http://x)", "see this link (http://x)", "{bad", ""]
    (tmp_path / "i.tsv").write_text('id\tsnippet\n1\ta "b\n \tgone\n2\t\n')
    assert [tuple(r) for r in corpus.read_index(spark, f"file://{tmp_path}/i.tsv", "id string, snippet string", "id", ["snippet"]).collect()] == [("1", 'a "b'), ("2", None)]


def test_totals_of_rerank_inputs(spark):
    row = spark.createDataFrame([("q" * 9, ["a" * 8, None, "é" * 40])], "q string, t array<string>")
    told = tx.pair_totals(F.col("q"), F.col("t"), 4.0, 10)
    assert row.select(*[c.alias(n) for n, c in told.items()]).first().asDict() == {"tokens": 12, "longest": 10, "pair_longest": 13, "over": 1, "bytes": 88}
    assert row.select(tx.rank_input(F.col("t"), 5).alias("x")).first().x == ["aaaaa", "", "ééééé"]
