"""Mixing sources at a temperature: weights from token shares, realised as block permutations within a budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, unused

#: Bisection steps taken in one pass over the sources, and passes: together they halve [0, 1] this often.
STEPS, PASSES = 4, 10
#: Rows that a run of the permutation holds on average; a source is dealt out over as many runs as it needs.
RUN = 2_000


def bisect_exponent(sources: DataFrame, n_sources: int, total: float, target_entropy: float, budget: float, max_repeat: float) -> float:
    """The exponent in [0, 1] for the weights tokens ** exponent.

    The largest whose entropy is at least target_entropy x log(number of sources), raised, if that repeats some source
    more than max_repeat times, to the smallest that does not (1 if none does). Both measures fall with the exponent, so
    each is bisected; a pass over the sources' totals evaluates the 2 ** STEPS - 1 inner points of STEPS halvings.
    """
    if n_sources < 2:
        return 1.0
    share = F.col("tokens") / F.lit(total)
    goal = target_entropy * math.log(n_sources)

    def evaluate(points: list[float]) -> list[tuple[bool, bool]]:
        """(whether the entropy is still high enough, whether some source repeats too often) at each exponent."""
        aggregates = []
        for i, a in enumerate(points):
            p = F.pow(share, F.lit(a))
            aggregates += [F.sum(p).alias(f"z{i}"), F.sum(p * F.ln(share)).alias(f"l{i}"), F.max(p / F.col("tokens")).alias(f"m{i}")]
        r = sources.agg(*aggregates).first()
        out = []
        for i, a in enumerate(points):
            z = r[f"z{i}"]
            out.append((math.log(z) - a * r[f"l{i}"] / z >= goal - 1e-12, budget * r[f"m{i}"] / z > max_repeat * (1 + 1e-12)))
        return out

    def boundary(which: int) -> float:
        """Where the measure turns from true to false in [0, 1]."""
        low, high = 0.0, 1.0
        if evaluate([1.0])[0][which]:
            return 1.0
        if not evaluate([0.0])[0][which]:
            return 0.0
        for _ in range(PASSES):
            k = 1 << STEPS
            points = [low + (high - low) * i / k for i in range(1, k)]
            held = sum(x[which] for x in evaluate(points))  # true up to the boundary
            low, high = ([low, *points])[held], ([*points, high])[held]
        return low if which == 0 else high

    return max(boundary(0), boundary(1))


def source_weights(docs: DataFrame, source_col: str, tokens: Column, target_entropy: float, budget_share: float, max_repeat: float) -> tuple[DataFrame, float]:
    """One row per source with tokens: source, tokens, docs, weight, quota (tokens), repeats; and the exponent."""
    sources = cut(
        docs.select(F.col(source_col).alias("source"), tokens.alias("n")).where("n > 0").groupBy("source").agg(F.sum("n").cast("double").alias("tokens"), F.count("*").alias("docs")), "sources"
    )
    n_sources, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    total = total or 1.0
    exponent = bisect_exponent(sources, n_sources, total, target_entropy, budget_share * total, max_repeat)
    part = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent))
    z = sources.agg(F.sum(part)).first()[0] or 1.0
    out = sources.withColumn("weight", part / F.lit(z)).withColumn("quota", F.round(F.col("weight") * F.lit(budget_share * total), 3))
    return out.withColumn("repeats", F.col("quota") / F.col("tokens")), exponent


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, target_entropy: float = 0.97, budget_share: float = 1.0, max_repeat: float = 4.0, blocks: int = 64, seed: int = 17) -> DataFrame:
    """Which rows the mixture takes how often and where: doc_id, source, n_tokens, copies, pass, block, place.

    Source weights are token shares raised to one exponent, bisected to a target entropy (a share of the highest) or, if
    it binds, to at most max_repeat repeats of a source; the budget is budget_share of all tokens. Each pass over a
    source is a permutation by hash of the seed, pass and row; rows are taken while they start within the source's quota,
    so at most one row per source goes beyond it. Their places along the quota deal them to `blocks` blocks, each of
    which holds every source at its weight, permuted by hash (place). Running totals are taken in runs of the
    permutation of about RUN rows and offset by the totals of the runs before, so a source with a third of all rows is
    no single task. Rows that agree in id, source and tokens are one, of `copies`, and go together; rows without tokens
    carry no weight and are left out; a null source is a source. Nulls, no rows: no rows. Built-in functions only.
    """
    size = n_words(text_col) if tokens is None else tokens.cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("n_tokens")).where("n_tokens > 0")
    rows = cut(rows.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("copies")), "rows")
    weights, _ = source_weights(rows, "source", F.col("n_tokens") * F.col("copies"), target_entropy, budget_share, max_repeat)
    weights = cut(weights, "weights").select(F.col("source").alias("_source"), "tokens", "docs", "quota", "repeats")
    joined = rows.join(weights, F.col("source").eqNullSafe(F.col("_source")))
    passes = joined.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("repeats") - 1, F.lit(0)).cast("int"))).alias("pass"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string")))
    passes = passes.withColumn("place", place).withColumn("_cost", F.col("n_tokens") * F.col("copies"))
    at = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    passes = passes.withColumn("_run", F.floor(at * F.ceil(F.col("docs") / RUN)).cast("int"))
    passes = cut(passes.drop("_source", "docs"), "passes")
    sums = passes.groupBy("source", "pass", "_run").agg(F.sum("_cost").alias("_sum"))
    ordered = Window.partitionBy("source").orderBy("pass", "_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(ordered), F.lit(0))).select(F.col("source").alias("_s"), F.col("pass").alias("_p"), F.col("_run").alias("_r"), "_before")
    inside = Window.partitionBy("source", "pass", "_run").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = passes.withColumn("_here", F.coalesce(F.sum("_cost").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")) & (F.col("_run") == F.col("_r")))
    start = (F.col("_before") + F.col("_here")).cast("double")
    taken = placed.where(start < F.col("quota"))
    return taken.select("doc_id", "source", "n_tokens", "copies", "pass", F.least(F.floor(start / F.col("quota") * blocks), F.lit(blocks - 1)).cast("int").alias("block"), "place")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that mix_plan takes, each as often as it does, in all of their columns. Their texts are shuffled once."""
    ident, source, n, times, time = (unused(docs, c) for c in ("id", "source", "n", "times", "time"))
    plan = mix_plan(docs, id_col, source_col, text_col, **how).groupBy("doc_id", "source", "n_tokens").agg(F.count("*").cast("int").alias(times))
    plan = plan.select(F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("n_tokens").alias(n), times)
    same = F.col(id_col).eqNullSafe(F.col(ident)) & F.col(source_col).eqNullSafe(F.col(source)) & (n_words(text_col) == F.col(n))
    out = docs.join(plan, same)
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(time)).drop(time)


def oracle(target_entropy: float = 0.97, budget_share: float = 1.0, max_repeat: float = 4.0, blocks: int = 64, seed: int = 17) -> str:
    """mix_plan over documents as DuckDB SQL."""
    halvings = STEPS * PASSES
    return f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
r AS (SELECT doc_id, source, n_tokens, count(*)::BIGINT AS copies FROM rows_ WHERE n_tokens > 0 GROUP BY ALL),
s AS (SELECT source, sum(n_tokens * copies)::DOUBLE AS tokens, count(*) AS docs FROM r GROUP BY source),
l AS (SELECT list(tokens / total) AS ps, total, count(*) AS n FROM s, (SELECT sum(tokens) AS total FROM s) GROUP BY total),
h(i, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT i, low, high, mid, ln(z) - mid * list_sum(list_transform(ps, lambda p: pow(p, mid) * ln(p))) / z >= {target_entropy} * ln(n) - 1e-12 AS ok FROM (
      SELECT i, low, high, (low + high) / 2 AS mid, ps, n, list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2))) AS z FROM h, l WHERE i < {halvings}))),
m(i, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN over THEN mid ELSE low END, CASE WHEN over THEN high ELSE mid END FROM (
    SELECT i, low, high, mid, {budget_share} * list_max(list_transform(ps, lambda p: pow(p, mid) / p)) / z > {max_repeat} * (1 + 1e-12) AS over FROM (
      SELECT i, low, high, (low + high) / 2 AS mid, ps, n, list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2))) AS z FROM m, l WHERE i < {halvings}))),
e AS (SELECT greatest(
  CASE WHEN -list_sum(list_transform(ps, lambda p: p * ln(p))) >= {target_entropy} * ln(n) - 1e-12 THEN 1.0 ELSE (SELECT low FROM h WHERE i = {halvings}) END,
  CASE WHEN {budget_share} > {max_repeat} * (1 + 1e-12) THEN 1.0 WHEN {budget_share} * list_max(list_transform(ps, lambda p: 1 / p)) / n <= {max_repeat} * (1 + 1e-12) THEN 0.0 ELSE (SELECT high FROM m WHERE i = {halvings}) END) AS a FROM l),
w AS (SELECT source, tokens, round(pow(tokens / total, a) / (list_sum(list_transform(ps, lambda p: pow(p, a)))) * {budget_share} * total, 3) AS quota FROM s, l, e),
c AS (SELECT r.*, quota, unnest(range(0, greatest(ceil(quota / tokens), 1)::BIGINT)) AS pass FROM r JOIN w USING (source)),
p AS (SELECT *, md5('{seed}:' || pass || ':' || doc_id || ':' || n_tokens) AS place FROM c),
o AS (SELECT *, coalesce(sum(n_tokens * copies) OVER (PARTITION BY source ORDER BY pass, place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start FROM p)
SELECT doc_id, source, n_tokens, copies, pass::INTEGER AS pass, least(floor(start / quota * {blocks}), {blocks - 1})::INTEGER AS block, place FROM o WHERE start < quota"""
