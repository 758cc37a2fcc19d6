"""Reports over scored trials: guards, cards, leaderboards, recommendations, curves. Every figure is a grouped aggregate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .ordering import running
from .statistics import distribution, high_variance_items, item_means, paired_differences, pareto


def join_last(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """left with the columns of right's last row of its key; rows without one are left out. Combined before the shuffle."""
    rest = [c for c in right.columns if c not in key]
    last = right.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
    return left.join(last, key)


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, that of the lowest order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*").select(*rows.columns)


def positional(picks: DataFrame, candidates: DataFrame, group: str, at: str) -> DataFrame:
    """Candidates that picks (group, at, ...) name by their place from 0; places beyond the list are left out."""
    return picks.join(candidates, [group, at])


def equal_to(rows: DataFrame, wanted: dict[str, object], allowed: list[str] | None = None) -> DataFrame:
    """Rows whose columns equal all wanted values (None: ignored); a column that is not allowed is ignored."""
    for c, v in wanted.items():
        if v is not None and (allowed is None or c in allowed):
            rows = rows.where(F.col(c) == F.lit(v))
    return rows


def in_cohort(rows: DataFrame, predicate: dict[str, object], turn_type: str | None = None, axis: str = "turn_type") -> DataFrame:
    """Rows whose axes equal all values of a stratum's predicate, nulls equalling nulls. The stratum's own turn type holds as
    well where the predicate does not name that axis."""
    wanted = predicate if turn_type is None or axis in predicate else {**predicate, axis: turn_type}
    out = F.lit(True)
    for c, v in wanted.items():
        out = out & F.col(c).eqNullSafe(F.lit(v))
    return rows.where(out)


def chart_selection(rows: DataFrame, agents: list[str] = (), sessions: list | None = None, category: str | None = None) -> DataFrame:
    """rows with selected and the reason why not (agent, session, category); no agents or sessions: all."""
    out = F.when(~F.col("agent").isin(*agents), "agent") if agents else F.when(F.lit(False), "")
    if sessions is not None:
        out = out.when(~F.col("session").isin(*sessions), "session")
    if category is not None:
        out = out.when(~F.col("category").eqNullSafe(category), "category")
    return rows.withColumn("reason", out).withColumn("selected", F.col("reason").isNull())


def plottable(rows: DataFrame, axes: list[str], group: list[str]) -> DataFrame:
    """Per group: rows with every axis value, and rows that lack one."""
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull()
    return rows.groupBy(*group).agg(F.count(F.when(ok, 1)).alias("plottable"), F.count(F.when(~ok, 1)).alias("lacking"))


def rejected(rows: DataFrame, text: str, scopes: list[str]) -> DataFrame:
    """rows with the reason to leave them out: a blank text, or an empty scope; null where they stay."""
    reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "blank text")
    for s in scopes:
        reason = reason.when(F.coalesce(F.size(s), F.lit(0)) <= 0, f"no {s}")
    return rows.withColumn("reason", reason)


def retrieval_regressions(rows: DataFrame, recall: str, ndcg: str, score: str, keys: list[str], good: float = 0.75, bad: float = 0.35, n: int = 12) -> DataFrame:
    """The n worst answers to well-retrieved questions: found at `good` or more, scored below `bad`; a row that lacks a figure
    takes no part."""
    worst = rows.where(F.col(recall).isNotNull() & F.col(ndcg).isNotNull() & (F.greatest(recall, ndcg) >= good) & (F.col(score) < bad))
    return worst.orderBy(F.desc(F.col(recall) + F.col(ndcg)), score, *keys).limit(n)


def failures(rows: DataFrame, over_claim: str, score: str, keys: list[str], n: int) -> DataFrame:
    """The n worst rows: over-claims first, then the lowest scores, then by keys."""
    return rows.orderBy(F.desc(over_claim), score, *keys).limit(n)


def long_metrics(rows: DataFrame, keys: list[str], registry: dict[str, str], wanted: list[str] | None = None) -> DataFrame:
    """(keys, metric, value) of the registered metrics (name: column or path); an unknown name raises. Nulls are left out."""
    names = list(registry) if wanted is None else list(wanted)
    if unknown := [n for n in names if n not in registry]:
        raise ValueError(f"unknown metrics: {unknown}")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(registry[n]).cast("double").alias("value")) for n in names])
    return rows.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*").where("value IS NOT NULL")


def grouped(rows: DataFrame, dims: list[str], known: list[str], **measures: Column) -> DataFrame:
    """Aggregates by dimensions; one that is not known raises."""
    if unknown := [d for d in dims if d not in known]:
        raise ValueError(f"unknown dimensions: {unknown}")
    return rows.groupBy(*dims).agg(*[c.alias(n) for n, c in measures.items()])


def blended_groups(rows: DataFrame, group: list[str], kind: str, metric: str) -> DataFrame:
    """Groups whose metric spans several kinds of question, which no average should blend."""
    return rows.where(F.col(metric).isNotNull()).groupBy(*group).agg(F.count_distinct(kind).alias("kinds")).where("kinds > 1")


def unblended(rows: DataFrame, group: list[str], kind: str, metric: str) -> DataFrame:
    """rows, or an error once the plan meets a group that blends kinds."""
    told = blended_groups(rows, group, kind, metric).select(*[F.col(c).alias(f"_{c}") for c in group], "kinds")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    out = rows.join(told, same, "left").withColumn("kinds", F.when(F.col("kinds").isNotNull(), F.raise_error(F.lit(f"{metric} blends several {kind}"))).otherwise(F.lit(0)))
    return out.where("kinds = 0").select(*rows.columns)


def pareto_sweep(rows: DataFrame, group: list[str], cost: str, quality: str) -> DataFrame:
    """Rows in the order of cost whose quality is above that of all before them."""
    best = rows.groupBy(*group, cost).agg(F.max(quality).alias("_q"))
    before = F.max("_q").over(Window.partitionBy(*group).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_q") > F.col("_before")))
    return best.select(*group, cost, F.col("_q").alias(quality))


def recommend(models: DataFrame, accuracy: float, p99: float, false_answer: float) -> DataFrame:
    """The cheapest model (accuracy, p99, false_answer, cost) within the gates; no row if none is. A bounded list."""
    ok = (F.col("accuracy") >= accuracy) & (F.col("p99") <= p99) & (F.col("false_answer") <= false_answer)
    return models.where(ok).orderBy("cost", "model").limit(1)


def softened_weights(weights: DataFrame, agreement: DataFrame, low: float = 0.6, factor: float = 0.5) -> DataFrame:
    """Weights (dimension, weight): times factor where agreement (dimension, rho) is below low, 0 where it is null."""
    rho = F.when(F.col("rho").isNull(), 0.0).when(F.col("rho") < low, F.col("weight") * factor).otherwise(F.col("weight"))
    return weights.join(agreement, "dimension", "left").withColumn("softened", rho)


def judge_summary(rows: DataFrame, group: list[str], score: str, dims: list[str], key: str, passing: float = 0.6) -> DataFrame:
    """Per group: rows, means of score and dimensions, pass rate, and the keys of the worst, median and best row, in the order
    of score and key. Rows without a score take no part. A group is never sorted by one task."""
    scored = rows.where(F.col(score).isNotNull())
    sums = scored.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), *[F.avg(c).alias(f"mean_{c}") for c in dims], F.avg((F.col(score) >= passing).cast("double")).alias("pass_rate"),
        F.min_by(key, F.struct(score, key)).alias("worst"), F.max_by(key, F.struct(score, key)).alias("best"),
    )
    placed = running(scored.select(*group, score, key), group, [score, key], "_at", total="_n").where("_at = floor((_n + 1) / 2) - 1")
    middle = placed.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col(key).alias("median"))
    return sums.join(middle, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]).drop(*[f"_g{i}" for i in range(len(group))])


def turn_summary(turns: DataFrame, model: str, turn: str, score: str, kind: str, judged: str, failed: str, least: int = 2) -> DataFrame:
    """Per model and turn, and with a null turn per model: turns, mean score (null at a turn under `least`), insufficient, mean
    of the first turns and of the later ones, how many are held against gold, wants and an abstention, and the share judged of
    those that are no abstention (0 without any). Failed rows take no part. Both come from one pass over the turns."""
    ok = turns.where(~F.coalesce(F.col(failed), F.lit(False)))
    told = ok.groupingSets([[F.col(model), F.col(turn)], [F.col(model)]], F.col(model), F.col(turn)).agg(
        F.grouping(F.col(turn)).alias("_all"), F.count(score).alias("n"), F.avg(score).alias("mean"), F.avg(F.when(F.col(turn) == 1, F.col(score))).alias("first_mean"), F.avg(F.when(F.col(turn) > 1, F.col(score))).alias("later_mean"),
        *[F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in ("gold", "wants", "abstention")], F.coalesce(F.avg(F.when(F.col(kind) != "abstention", F.col(judged).cast("double"))), F.lit(0.0)).alias("judged_fraction"),
    )
    thin = (F.col("_all") == 0) & (F.col("n") < least)
    return told.withColumn("insufficient", thin).withColumn("mean", F.when(~thin, F.col("mean"))).drop("_all")


def turn_examples(turns: DataFrame, model: str, conversation: str, turn: str, score: str, answer: str, failed: str, excerpt: int = 280) -> DataFrame:
    """Per model its best, median and worst conversation by mean score, with every turn's score and the start of its answer."""
    ok = turns.where(~F.coalesce(F.col(failed), F.lit(False)))
    means = item_means(ok, [model], conversation, score)
    told = judge_summary(means, [model], "item_mean", [], conversation)
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("example"), F.col(c).alias("c")) for c in ("best", "median", "worst")])).alias("e")
    picks = told.select(F.col(model).alias("_m"), one).select("_m", "e.example", F.col("e.c").alias("_c"))
    shown = ok.join(picks, F.col(model).eqNullSafe(F.col("_m")) & (F.col(conversation) == F.col("_c")))
    return shown.select(model, "example", conversation, turn, score, F.left(answer, F.lit(excerpt)).alias("excerpt"))


def slice_scores(rows: DataFrame, slice_: str, conversation: str, score: str, dims: list[str] = (), rates: dict[str, str] | None = None, z: float = 1.96) -> DataFrame:
    """Per slice: mean of the conversations' means, their sample deviation, its half width (0 for one conversation) and bounds;
    over all of its turns the means of the dimensions (a null counts as 0) and of the rates (name: column; nulls are left out,
    no value at all is null)."""
    whole = [F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(f"_d{i}") for i, c in enumerate(dims)] + [x for i, c in enumerate((rates or {}).values()) for x in (F.sum(F.col(c).cast("double")).alias(f"_r{i}"), F.count(c).alias(f"_n{i}"))]
    means = rows.groupBy(slice_, conversation).agg(F.avg(score).alias("item_mean"), F.count("*").alias("_turns"), *whole)
    sd, n = F.coalesce(F.stddev_samp("item_mean"), F.lit(0.0)), F.count("item_mean")
    out = means.groupBy(slice_).agg(
        n.alias("conversations"), F.avg("item_mean").alias("mean"), sd.alias("sd"), F.coalesce(F.try_divide(z * sd, F.sqrt(n)), F.lit(0.0)).alias("half_width"),
        *[(F.sum(f"_d{i}") / F.sum("_turns")).alias(f"mean_{c}") for i, c in enumerate(dims)], *[F.try_divide(F.sum(f"_r{i}"), F.sum(f"_n{i}")).alias(name) for i, name in enumerate(rates or {})],
    )
    return out.withColumns({"low": F.col("mean") - F.col("half_width"), "high": F.col("mean") + F.col("half_width")})


def leaderboard(variants: DataFrame, variant: str, score: str, levers: str) -> DataFrame:
    """Variants by their mean score, fewer levers and name among equals; the first wins. One row a variant."""
    means = variants.groupBy(variant).agg(F.round(F.avg(score), 9).alias("mean"), F.max(levers).alias("levers"), F.count("*").alias("n"))
    placed = running(means, [], [F.desc("mean"), F.col("levers"), F.col(variant)], "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int")).withColumn("winner", F.col("place") == 1)


def seeded_stats(rows: DataFrame, seeds: DataFrame, model: str, value: str, error: str, first: str | None = None) -> DataFrame:
    """Per model of seeds, with or without rows: successes (n), errors, percentiles and mean of the successes' values, and
    the median of a second column, the time to the first token, where one is named."""
    ok = lambda c: F.when(~F.col(error), F.col(c))
    more = [F.percentile(ok(first), F.lit(0.5)).alias("first_p50")] if first else []
    stats = rows.groupBy(model).agg(F.count(F.when(~F.col(error), 1)).alias("n"), F.count(F.when(F.col(error), 1)).alias("errored"), F.percentile(ok(value), F.lit(0.5)).alias("p50"), F.percentile(ok(value), F.lit(0.9)).alias("p90"), F.avg(ok(value)).alias("mean"), *more)
    return seeds.select(model).join(stats, model, "left").na.fill(0, ["n", "errored"])


def size_curve(rows: DataFrame, agent: str, size: str, latency: str, quality: str) -> DataFrame:
    return rows.groupBy(agent, size).agg(F.avg(latency).alias("latency"), F.avg(quality).alias("quality"), F.count("*").alias("n"))


def model_cards(rows: DataFrame, model: str, item: str, timings: list[str] = (), tokens: list[str] = (), components: list[str] = (), classes: list[str] = ()) -> DataFrame:
    """Per model: n_trials, n_items, each timing's mean, p50, p90 and p95 (finite values), the means of tokens and components
    (nulls left out), and a map of counts for each class column. One pass over the rows; percentiles are exact and hold a
    model's different timings, so timings should be whole milliseconds or the like."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    spread = [x for c in timings for x in (F.avg(finite(c)).alias(f"{c}_mean"), *[F.percentile(finite(c), F.lit(p / 100)).alias(f"{c}_p{p}") for p in (50, 90, 95)])]
    out = rows.groupBy(model).agg(F.count("*").alias("n_trials"), F.count_distinct(item).alias("n_items"), *spread, *[F.avg(c).alias(f"mean_{c}") for c in [*tokens, *components]])
    if not classes:
        return out
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("name")) for c in classes])).alias("c")
    counts = rows.select(model, pair).select(model, "c.*").where("name IS NOT NULL").groupBy(model, "of", "name").agg(F.count("*").alias("n"))  # a model's classes are few
    maps = counts.groupBy(F.col(model).alias("_m")).agg(*[F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("of") == c, F.struct("name", "n"))), lambda x: x.isNotNull()))).alias(f"{c}_counts") for c in classes])
    return out.join(maps, F.col(model).eqNullSafe(F.col("_m"))).drop("_m")


def _item_sets(rows: DataFrame, sets: list[list[str]], item: str, value: str) -> DataFrame:
    """For each set of dimensions and its groups (null where a dimension takes no part, and which): what item-equal means and
    their normal intervals are made of. One expand, one exchange by group and item, one by group."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    cols = [F.col(d) for d in dims]
    told = rows.where(F.col(value).isNotNull()).groupingSets([[F.col(d) for d in s] + [F.col(item)] for s in sets], *cols, F.col(item)).agg(
        F.grouping_id().alias("_set"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"), F.count("*").alias("r"))
    n, reps = F.count("*"), F.sum("r")
    sums = told.groupBy("_set", *dims).agg(n.alias("n_items"), reps.alias("n_trials"), F.avg("m").alias("mean"), (F.sum(F.col("r") * F.col("m")) / reps).alias("_grand"), F.sum(F.col("v") * (F.col("r") - 1)).alias("_ssw"), F.sum(F.col("r") * F.col("m") * F.col("m")).alias("_ssa"), F.sum(F.col("r") * F.col("r")).alias("_sq"))
    within = F.coalesce(F.try_divide(F.col("_ssw"), (F.col("n_trials") - F.col("n_items")).cast("double")), F.lit(0.0))
    ms = F.try_divide(F.col("_ssa") - F.col("n_trials") * F.col("_grand") * F.col("_grand"), (F.col("n_items") - 1).cast("double"))
    r0 = F.try_divide(F.col("n_trials") - F.col("_sq") / F.col("n_trials"), (F.col("n_items") - 1).cast("double"))
    between = F.greatest(F.coalesce(F.try_divide(ms - within, r0), F.lit(0.0)), F.lit(0.0))
    half = 1.959963984540054 * F.sqrt(between / F.col("n_items") + within / F.col("n_trials"))
    enough = F.col("n_items") >= 2
    return sums.select("_set", *dims, "n_items", "n_trials", "mean", F.when(enough, F.col("mean") - half).alias("low"), F.when(enough, F.col("mean") + half).alias("high"), (~enough).alias("insufficient"))


def sliced_means(rows: DataFrame, model: str, dims: list[str], item: str, value: str) -> DataFrame:
    """(section, model, slice, n_items, n_trials, mean, low, high, insufficient): item-equal means with their intervals by model
    (section "model", null slice) and by model and each dimension (section: its name), all from one pass. A null dimension is
    a slice of its own, told as null."""
    told = _item_sets(rows, [[model], *[[model, d] for d in dims]], item, value)
    bits = {d: len(dims) - i for i, d in enumerate(dims)}  # grouping_id has the model's bit first and the item's last
    section, name = F.lit("model"), F.lit(None).cast("string")
    for d in dims:
        here = F.expr(f"(_set & {1 << bits[d]}) = 0")
        section, name = F.when(here, d).otherwise(section), F.when(here, F.col(d).cast("string")).otherwise(name)
    return told.select(section.alias("section"), F.col(model).cast("string").alias("model"), name.alias("slice"), "n_items", "n_trials", "mean", "low", "high", "insufficient")


def report(rows: DataFrame, model: str, kind: str, item: str, value: str, cost: str) -> DataFrame:
    """(section, name, metric, value): item-equal means by model, by kind and by both (the heat map), the frontier of models
    by mean and median cost, and where the figures come from (rows, items, failures are counted by model). Means come from one
    pass, costs from another."""
    told = _item_sets(rows, [[model], [kind], [model, kind]], item, value)
    section = F.when(F.expr("(_set & 6) = 2"), "models").when(F.expr("(_set & 6) = 4"), "kinds").otherwise("heat")
    name = F.concat_ws("/", F.when(F.expr("(_set & 4) = 0"), F.col(model).cast("string")), F.when(F.expr("(_set & 2) = 0"), F.col(kind).cast("string")))
    metrics = ["mean", "low", "high", "n_items", "n_trials"]
    part = lambda df, section, name, metrics: df.select(section.alias("section"), name.alias("name"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("section", "name", "m.*")
    out = part(told, section, name, metrics)
    costs = rows.groupBy(F.col(model).alias("_m")).agg(F.percentile(cost, F.lit(0.5)).alias("cost"), F.count("*").alias("rows"), F.count(value).alias("scored"))
    points = told.where("(_set & 6) = 2").select(F.col(model).alias("_n"), "mean").join(costs, F.col("_n").eqNullSafe(F.col("_m")))
    front = pareto(points, "mean", "cost").withColumn("on_front", F.col("on_front").cast("double"))
    out = out.unionByName(part(front, F.lit("frontier"), F.col("_m").cast("string"), ["cost", "on_front"]))
    return out.unionByName(part(costs, F.lit("provenance"), F.col("_m").cast("string"), ["rows", "scored"])).where("value IS NOT NULL")


def diagnostics(rows: DataFrame, model: str, item: str, value: str, limit: float, dims: list[str] = (), timings: list[str] = ()) -> DataFrame:
    """(section, name, metric, value): value distributions and mean timings by model, how many items vary too much, item-equal
    means by each dimension, and the paired difference of every two models."""
    part = lambda df, section, name, metrics: df.select(section.alias("section"), name.cast("string").alias("name"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("section", "name", "m.*")
    varied = high_variance_items(rows, [model], item, value, limit).groupBy(model).agg(F.count("*").alias("items"))
    out = part(distribution(rows, [model], value), F.lit("distribution"), F.col(model), ["n", "mean", "p50", "p90"]).unionByName(part(varied, F.lit("unsteady"), F.col(model), ["items"]))
    if timings:
        out = out.unionByName(part(rows.groupBy(model).agg(*[F.avg(c).alias(c) for c in timings]), F.lit("timings"), F.col(model), list(timings)))
    if dims:
        out = out.unionByName(part(sliced_means(rows, model, list(dims), item, value).where("section <> 'model'"), F.col("section"), F.concat_ws("/", "model", "slice"), ["mean", "low", "high", "n_items"]))
    deltas = paired_differences(rows, model, item, value)
    return out.unionByName(part(deltas, F.lit("paired"), F.concat_ws("/", "a", "b"), ["diff", "low", "high"])).where("value IS NOT NULL")


def slice_rollup(rows: DataFrame, slices: list[str], query_id: str, rels: str, retrievable: str, kind: str, score: str, latency: str, baseline: DataFrame | None = None, k: int = 10, ceiling: float = 0.05, draws: int = 2000) -> DataFrame:
    """Per slice: questions of each of the three kinds; mean nDCG and MRR over answerable ones with the bootstrap interval of
    nDCG, mean recall over those with something to find; latencies by nearest rank; the bootstrap p-value of nDCG against the
    baseline's on shared answerable questions (null without a baseline, 1 without shared ones); and the operating point of its
    abstention curve. rels is the list of labels in rank order, retrievable how many of a question's gold can be found."""
    from ..functions.ranking import ndcg_of_labels
    from .bootstrap import difference_bootstrap, mean_bootstrap
    from .statistics import UNANSWERABLE, abstention_curve, nearest_ranks, operating_point

    name = F.concat_ws("&", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(slices)])

    def told(df: DataFrame) -> DataFrame:
        labels = F.transform(rels, lambda x: x.cast("double"))
        top = F.slice(labels, 1, k)
        first = F.array_position(F.transform(top, lambda x: x > 0), True)
        found = F.size(F.filter(top, lambda x: x > 0))
        open_ = F.col(kind) != UNANSWERABLE
        return df.select(
            name.alias("slice"), F.col(query_id).alias("q"), F.col(kind).alias("kind"), F.col(score).alias("score"), F.col(latency).cast("double").alias("latency"),
            F.when(open_, ndcg_of_labels(labels, k)).alias("ndcg"), F.when(open_ & (F.col(retrievable) > 0), found / F.col(retrievable)).alias("recall"),
            F.when(open_, F.when(first > 0, 1.0 / first).otherwise(0.0)).alias("mrr"),
        )

    own = written(told(rows), "slices")
    kinds = ["unanswerable", "answerable_retrievable", "answerable_not_retrieved"]
    out = own.groupBy("slice").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("kind") == c, 1)).alias(c) for c in kinds], *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("ndcg", "recall", "mrr")])
    spread = mean_bootstrap(own, ["slice"], "q", "ndcg", draws).select(F.col("slice").alias("_b"), F.col("low").alias("ndcg_low"), F.col("high").alias("ndcg_high"))
    times = nearest_ranks(own, ["slice"], "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed("slice", "_t")
    curve = abstention_curve(own, "score", "kind", [i / 20 for i in range(1, 20)], ["slice"])
    point = operating_point(curve, ceiling, ["slice"]).select(F.col("slice").alias("_o"), F.col("threshold").alias("operating_t"), F.col("recall").alias("abstain_recall"), "false_answer", "false_abstain")
    out = out.join(spread, F.col("slice") == F.col("_b"), "left").join(times, F.col("slice") == F.col("_t"), "left").join(point, F.col("slice") == F.col("_o"), "left").drop("_b", "_t", "_o")
    if baseline is None:
        return out.withColumn("p_value", F.lit(None).cast("double"))
    base = told(baseline).where("ndcg IS NOT NULL").select(F.col("q").alias("_q"), F.col("ndcg").alias("_x"))
    shared = own.where("ndcg IS NOT NULL").join(base, F.col("q") == F.col("_q"))
    tests = difference_bootstrap(shared.select(F.col("slice").alias("_s"), "q", (F.col("ndcg") - F.col("_x")).alias("d")), ["_s"], "q", "d", draws).select("_s", "p_value")
    return out.join(tests, F.col("slice") == F.col("_s"), "left").drop("_s").na.fill({"p_value": 1.0})


def reference_agreement(choices: DataFrame, model: str, item: str, choice: str, reference: str) -> DataFrame:
    """Per other model: share of the items shared with the reference on which it chose the same."""
    ref = choices.where(F.col(model) == reference).select(F.col(item).alias("_i"), F.col(choice).alias("_c"))
    both = choices.where(F.col(model) != reference).join(ref, F.col(item) == F.col("_i"))
    return both.groupBy(model).agg(F.count("*").alias("n"), F.avg((F.col(choice) == F.col("_c")).cast("double")).alias("agreement"))


def pool_ranks(rows: DataFrame, pool: str, score: str, order: str, gold: str) -> DataFrame:
    """Per pool: whether its best row is gold, and 1 / place of the first gold row, 1 / (rows + 1) without one."""
    placed = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(pool).orderBy(F.desc(score), order)))
    first = F.min(F.when(F.col(gold), F.col("_nth")))
    return placed.groupBy(pool).agg(F.coalesce(first == 1, F.lit(False)).alias("top_1"), (1.0 / F.coalesce(first, F.count("*") + 1)).alias("rr"), F.count("*").alias("n"))


def combinations_of(rows: DataFrame, pool: str, member: str, k: int, most: int) -> DataFrame:
    """(pool, nth, members): the first `most` k-combinations of each pool's distinct members, in the order of their members.

    The nth one is told from n alone, by counting how many combinations begin with each choice, so no more than `most`
    rows a pool ever exist. A pool is held as one sorted list.
    """

    @F.pandas_udf("array<int>")
    def places(size: pd.Series, nth: pd.Series) -> pd.Series:
        from math import comb

        def unranked(n: int, at: int) -> list[int]:
            out, c = [], 0
            for left in range(k - 1, -1, -1):
                while at >= (behind := comb(n - 1 - c, left)):
                    at, c = at - behind, c + 1
                out.append(c)
                c += 1
            return out

        return pd.Series([unranked(n, at) for n, at in zip(size, nth, strict=True)])

    pools = rows.groupBy(pool).agg(F.array_sort(F.collect_set(member)).alias("_m")).withColumn("_n", F.size("_m")).where(F.col("_n") >= k)
    # as many as there are, or `most`: factors of the binomial coefficient, stopped once they pass it
    ways = F.lit(1.0)
    for i in range(k):
        ways = ways * (F.col("_n") - i) / (i + 1)
    nth = F.explode(F.sequence(F.lit(1), F.least(F.round(ways), F.lit(float(most))).cast("int"))).alias("nth")
    out = pools.select(pool, "_m", "_n", nth).withColumn("_at", places("_n", F.col("nth") - 1))
    return out.select(pool, "nth", F.transform("_at", lambda i: F.get("_m", i)).alias("members"))
