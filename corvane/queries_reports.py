"""Queries of reports, filters, allocation, planning and sources, with SQL. Events stand for scored trials, orders for items."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import bootstrap as bs
from .operators import planning as pl
from .operators import reports as rp
from .operators import selection as sel
from .operators import statistics as st
from .queries import MEANS, VC, query, r6, t
from .shared import scratch, written
from .sources import corpus, logs


def events(spark, d):
    return t(spark, d, "events")


@query("""WITH j AS (SELECT l_orderkey, l_quantity, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC) AS nth FROM lineitem)
SELECT o_orderkey, o_orderpriority, l_quantity AS quantity, round(0.7 * l_quantity / 50 + 0.3 * l_discount * 10, 9) AS composite FROM orders JOIN j ON o_orderkey = l_orderkey AND nth = 1""")
def last_judgements(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]
    judged = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *order)
    rows = rp.join_last(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), judged, ["o_orderkey"], order)
    return rows.select("o_orderkey", "o_orderpriority", F.col("l_quantity").alias("quantity"), F.round(0.7 * F.col("l_quantity") / 50 + 0.3 * F.col("l_discount") * 10, 9).alias("composite"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_events(spark, d):
    return rp.first_wins(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 7, event_id) = 1")
def representative_events(spark, d):
    rows = events(spark, d).withColumn("rep", F.col("event_id") % 7)
    return sel.representative(rows, ["user_id", "event_type"], ["rep", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def requested_orders(spark, d):
    wanted = {"o_orderstatus": "F", "o_orderpriority": "5-LOW", "o_custkey": None, "page": 3}
    return rp.equal_to(t(spark, d, "orders"), wanted, ["o_orderstatus", "o_orderpriority", "o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_id FROM events WHERE event_type = 'view' AND user_id % 3 = 0")
def cohort_events(spark, d):
    """Events of a cohort of two axes, one of them told by the stratum and not by the predicate."""
    rows = events(spark, d).withColumns({"tone": F.col("event_type"), "turn_type": F.when(F.col("user_id") % 3 == 0, "multi").otherwise("single")})
    return rp.in_cohort(rows, {"tone": "view"}, "multi").select("user_id", "event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderpriority = '2-HIGH'")
def log_history(spark, d):
    return logs.history(t(spark, d, "orders"), "1997-01-01", "1999-01-01", "o_orderdate", o_orderpriority="2-HIGH", o_orderstatus=None).select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def exact_metadata(spark, d):
    return rp.equal_to(t(spark, d, "documents"), {"lang": "en", "source": "src1"}).select("doc_id")


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'agent' WHEN user_id NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9) THEN 'session' WHEN event_id % 2 <> 0 THEN 'category' END AS reason,
event_type IN ('click', 'view', 'error') AND user_id BETWEEN 1 AND 9 AND event_id % 2 = 0 AS selected FROM events""")
def chart_choices(spark, d):
    rows = events(spark, d).select("event_id", F.col("event_type").alias("agent"), F.col("user_id").alias("session"), (F.col("event_id") % 2).cast("string").alias("category"))
    return rp.chart_selection(rows, ["click", "view", "error"], list(range(1, 10)), "0").select("event_id", "reason", "selected")


@query("SELECT event_type, count(*) FILTER (nullif(event_id % 5, 0) IS NOT NULL)::BIGINT AS plottable, count(*) FILTER (event_id % 5 = 0)::BIGINT AS lacking FROM events WHERE value IS NOT NULL GROUP BY 1")
def plottable_events(spark, d):
    rows = events(spark, d).where("value IS NOT NULL").withColumn("x", F.when(F.col("event_id") % 5 != 0, F.col("event_id")))
    return rp.plottable(rows, ["x", "value"], ["event_type"])


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank text' WHEN lang = 'en' THEN 'no langs' END AS reason FROM documents")
def rejected_documents(spark, d):
    docs = t(spark, d, "documents").withColumn("langs", F.filter(F.array("lang"), lambda x: x != "en"))
    return rp.rejected(docs, "text", ["langs"]).select("doc_id", "reason")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN least(value / 100, 1) END AS recall, least(value / 150, 1) AS ndcg, (event_id % 10) / 10.0::DOUBLE AS score FROM events)
SELECT event_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, score FROM e WHERE recall IS NOT NULL AND greatest(recall, ndcg) >= 0.75 AND score < 0.35 ORDER BY e.recall + e.ndcg DESC, score, event_id LIMIT 12""")
def retrieval_regressions(spark, d):
    e = events(spark, d).select("event_id", F.when(F.col("event_id") % 5 > 0, F.least(F.col("value") / 100, F.lit(1.0))).alias("recall"), F.least(F.col("value") / 150, F.lit(1.0)).alias("ndcg"), (F.col("event_id") % 10 / 10.0).alias("score"))
    return rp.retrieval_regressions(e, "recall", "ndcg", "score", ["event_id"]).select("event_id", *r6("recall", "ndcg"), "score")


@query("SELECT event_id, event_type = 'error' AS over_claim, value FROM events ORDER BY (event_type = 'error') DESC, value, event_id LIMIT 30")
def failure_picks(spark, d):
    rows = events(spark, d).withColumn("over_claim", F.col("event_type") == "error")
    return rp.failures(rows, "over_claim", "value", ["event_id"], 30).select("event_id", "over_claim", "value")


@query("""WITH e AS (SELECT event_id, event_id % 3 AS c, CASE WHEN event_id % 4 > 0 THEN event_id % 2 END AS ab, CASE WHEN event_id % 5 > 0 THEN event_id % 2 END AS ref, value AS total, value * 0.4 AS r, value * (CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0.6 END) AS g FROM events)
SELECT event_id, CASE WHEN (ab IS NOT NULL) <> (c < 2) THEN 'abstention' WHEN (ref IS NOT NULL) <> (c = 2) THEN 'refusal' WHEN abs(total - (r + g)) > greatest(1e-6 * greatest(abs(total), abs(r + g)), 1e-3) THEN 'time' END AS violation FROM e""")
def event_violations(spark, d):
    i = F.col("event_id")
    rows = events(spark, d).select(
        "event_id", F.when(i % 3 == 0, "none").when(i % 3 == 1, "partial").otherwise("full").alias("kind"), F.when(i % 4 > 0, i % 2).alias("abstention"), F.when(i % 5 > 0, i % 2).alias("refusal"),
        F.col("value").alias("total"), (F.col("value") * 0.4).alias("r"), (F.col("value") * F.when(i % 7 == 0, 0.5).otherwise(0.6)).alias("g"), F.lit(None).cast("string").alias("error"),
    )
    return logs.violations(rows, "kind", "abstention", "refusal", "total", ["r", "g"]).select("event_id", "violation")


@query("SELECT event_id, 'value' AS metric, value FROM events UNION ALL SELECT event_id, 'user', user_id::DOUBLE FROM events WHERE user_id IS NOT NULL")
def long_metrics(spark, d):
    return rp.long_metrics(events(spark, d), ["event_id"], {"value": "value", "user": "user_id", "id": "event_id"}, ["value", "user"])


@query("SELECT user_id, count(DISTINCT event_type)::BIGINT AS kinds FROM events WHERE value > 100 GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def blended_groups(spark, d):
    return rp.blended_groups(events(spark, d).where("value > 100"), ["user_id"], "event_type", "value")


@query("""WITH b AS (SELECT p_brand, p_retailprice AS cost, max(p_size) AS q FROM part GROUP BY ALL), w AS (SELECT *, max(q) OVER (PARTITION BY p_brand ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT p_brand, cost, q AS p_size FROM w WHERE before IS NULL OR q > before""")
def pareto_sweeps(spark, d):
    return rp.pareto_sweep(t(spark, d, "part").withColumnRenamed("p_retailprice", "cost"), ["p_brand"], "cost", "p_size")


@query("""WITH m AS (SELECT l_suppkey AS model, avg(l_discount) * 10 AS accuracy, quantile_disc(l_quantity, 0.9) AS p99, avg((l_returnflag = 'R')::INTEGER) AS false_answer, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1)
SELECT model, cost FROM m WHERE accuracy >= 0.5 AND p99 <= 47 AND false_answer <= 0.4 ORDER BY m.cost, model LIMIT 1""")
def recommended(spark, d):
    m = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg((F.avg("l_discount") * 10).alias("accuracy"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p99"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("false_answer"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))
    return rp.recommend(m, 0.5, 47, 0.4).select("model", "cost")


@query("""SELECT o_orderpriority AS dimension, round(CASE WHEN n % 3 = 0 THEN 0 WHEN n % 3 = 1 THEN 0.5 * w ELSE w END, 9)::DOUBLE AS softened FROM (SELECT o_orderpriority, count(*) / 1000.0::DOUBLE AS w, count(*) AS n FROM orders GROUP BY 1)""")
def softened_weights(spark, d):
    w = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dimension")).agg((F.count("*") / 1000.0).alias("weight"), F.count("*").alias("n"))
    rho = w.select("dimension", F.when(F.col("n") % 3 == 1, 0.5).when(F.col("n") % 3 == 2, 0.9).alias("rho"))
    return rp.softened_weights(w.drop("n"), rho).select("dimension", F.round("softened", 9).alias("softened"))


@query("""WITH p AS (SELECT event_type, event_id, value / 100 AS s, value, row_number() OVER (PARTITION BY event_type ORDER BY value / 100, event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*)::BIGINT AS n, round(avg(s), 6) AS mean, round(avg(value), 6) AS mean_value, round(avg((s >= 0.6)::INTEGER), 6) AS pass_rate, max(event_id) FILTER (nth = 1) AS worst, max(event_id) FILTER (nth = (n + 1) // 2) AS median, max(event_id) FILTER (nth = n) AS best FROM p GROUP BY 1""")
def judge_summaries(spark, d):
    rows = events(spark, d).withColumn("s", F.col("value") / 100)
    return rp.judge_summary(rows, ["event_type"], "s", ["value"], "event_id").select("event_type", "n", *r6("mean", "mean_value", "pass_rate"), "worst", "median", "best")



#: Turns of conversations as answers of three models, some of them failed.
TURN_ROWS = """r AS (SELECT conv_id, 'm' || conv_id % 3 AS model, turn + 1 AS turn, length(text) / 100.0::DOUBLE AS score, text, CASE WHEN conv_id % 7 = 0 THEN 'abstention' WHEN turn = 0 THEN 'gold' ELSE 'wants' END AS kind, length(text) > 100 AS judged, (conv_id + turn) % 11 = 0 AS failed FROM conversations), ok AS (SELECT * FROM r WHERE NOT failed)"""


def turn_rows(spark, d):
    c, n = F.col("conv_id"), F.length("text")
    kind = F.when(c % 7 == 0, "abstention").when(F.col("turn") == 0, "gold").otherwise("wants")
    return t(spark, d, "conversations").select(
        "conv_id", F.concat(F.lit("m"), (c % 3).cast("string")).alias("model"), (F.col("turn") + 1).alias("turn"), (n / 100.0).alias("score"), "text", kind.alias("kind"), (n > 100).alias("judged"), ((c + F.col("turn")) % 11 == 0).alias("failed"))


@query(f"""WITH {TURN_ROWS}, s AS (SELECT model, turn, grouping(turn) AS all_, count(*) AS n, avg(score) AS mean, avg(score) FILTER (turn = 1) AS first_mean, avg(score) FILTER (turn > 1) AS later_mean, count(*) FILTER (kind = 'gold') AS gold, count(*) FILTER (kind = 'wants') AS wants, count(*) FILTER (kind = 'abstention') AS abstention,
coalesce(avg(judged::INTEGER) FILTER (kind <> 'abstention'), 0) AS judged_fraction FROM ok GROUP BY GROUPING SETS ((model, turn), (model)))
SELECT model, turn, n::BIGINT AS n, CASE WHEN all_ = 0 AND n < 2 THEN NULL ELSE round(mean, 6) END AS mean, round(first_mean, 6) AS first_mean, round(later_mean, 6) AS later_mean, gold::BIGINT AS gold, wants::BIGINT AS wants, abstention::BIGINT AS abstention, round(judged_fraction, 6)::DOUBLE AS judged_fraction, all_ = 0 AND n < 2 AS insufficient FROM s""")
def turn_summaries(spark, d):
    told = rp.turn_summary(turn_rows(spark, d), "model", "turn", "score", "kind", "judged", "failed")
    return told.select("model", "turn", "n", *r6("mean", "first_mean", "later_mean"), "gold", "wants", "abstention", *r6("judged_fraction"), "insufficient")


@query(f"""WITH {TURN_ROWS}, m AS (SELECT model, conv_id, avg(score) AS m FROM ok GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY m, conv_id) AS nth, count(*) OVER (PARTITION BY model) AS n FROM m),
e AS (SELECT model, conv_id, unnest(list_filter([CASE WHEN nth = 1 THEN 'worst' END, CASE WHEN nth = (n + 1) // 2 THEN 'median' END, CASE WHEN nth = n THEN 'best' END], lambda x: x IS NOT NULL)) AS example FROM p)
SELECT model, example, conv_id, turn, round(score, 6) AS score, left(text, 280) AS excerpt FROM e JOIN ok USING (model, conv_id)""")
def turn_examples(spark, d):
    return rp.turn_examples(turn_rows(spark, d), "model", "conv_id", "turn", "score", "text", "failed").select("model", "example", "conv_id", "turn", *r6("score"), "excerpt")


@query("""WITH r AS (SELECT event_type, user_id, value, CASE WHEN event_id % 3 > 0 THEN value / 10 END AS tone, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS right_, value > 80 AS unsure FROM events),
c AS (SELECT event_type, user_id, avg(value) AS m FROM r GROUP BY ALL), s AS (SELECT event_type, count(m) AS n, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS sd FROM c GROUP BY 1),
w AS (SELECT event_type, avg(coalesce(tone, 0)) AS tone, avg(right_::INTEGER) AS abstention_reward, avg(unsure::INTEGER) AS unsure_rate FROM r GROUP BY 1)
SELECT event_type, n::BIGINT AS conversations, round(mean, 6) AS mean, round(sd, 6) AS sd, round(1.96 * sd / sqrt(n), 6) AS half_width, round(mean - 1.96 * sd / sqrt(n), 6) AS low, round(tone, 6) AS mean_tone, round(abstention_reward, 6) AS abstention_reward, round(unsure_rate, 6) AS unsure_rate FROM s JOIN w USING (event_type)""")
def slice_scores(spark, d):
    i = F.col("event_id")
    rows = events(spark, d).select("event_type", "user_id", "value", F.when(i % 3 > 0, F.col("value") / 10).alias("tone"), F.when(i % 4 == 0, i % 8 == 0).alias("right"), (F.col("value") > 80).alias("unsure"))
    told = rp.slice_scores(rows, "event_type", "user_id", "value", ["tone"], {"abstention_reward": "right", "unsure_rate": "unsure"})
    return told.select("event_type", "conversations", *r6("mean", "sd", "half_width", "low", "mean_tone", "abstention_reward", "unsure_rate"))


@query("""WITH m AS (SELECT p_brand, round(avg(p_size), 9) AS mean, max(p_partkey % 4) AS levers, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand, round(mean, 6) AS mean, levers, n::BIGINT AS n, row_number() OVER (ORDER BY m.mean DESC, levers, p_brand)::INTEGER AS place, row_number() OVER (ORDER BY m.mean DESC, levers, p_brand) = 1 AS winner FROM m""")
def leaderboards(spark, d):
    rows = t(spark, d, "part").withColumn("levers", F.col("p_partkey") % 4)
    return rp.leaderboard(rows, "p_brand", "p_size", "levers").select("p_brand", *r6("mean"), "levers", "n", "place", "winner")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def category_counts(spark, d):
    return rp.grouped(t(spark, d, "orders"), ["o_orderstatus"], ["o_orderstatus", "o_orderpriority"], n=F.count("*"))


@query("""SELECT n_nationkey, count(*) FILTER (s_acctbal >= 0)::BIGINT AS n, count(*) FILTER (s_acctbal < 0)::BIGINT AS errored, round(quantile_cont(s_acctbal, 0.5) FILTER (s_acctbal >= 0), 6) AS p50, round(quantile_cont(s_acctbal, 0.9) FILTER (s_acctbal >= 0), 6) AS p90, round(avg(s_acctbal) FILTER (s_acctbal >= 0), 6) AS mean,
quantile_cont(s_suppkey, 0.5) FILTER (s_acctbal >= 0)::DOUBLE AS first_p50 FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1""")
def seeded_stats(spark, d):
    rows = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_acctbal", "s_suppkey", (F.col("s_acctbal") < 0).alias("error"))
    return rp.seeded_stats(rows, t(spark, d, "nation"), "n_nationkey", "s_acctbal", "error", "s_suppkey").select("n_nationkey", "n", "errored", *r6("p50", "p90", "mean"), "first_p50")


@query("SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS latency, round(avg(p_size), 6) AS quality, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def size_curves(spark, d):
    return rp.size_curve(t(spark, d, "part"), "p_brand", "p_type", "p_retailprice", "p_size").select("p_brand", "p_type", *r6("latency", "quality"), "n")


def sql_interval(name: str, dims: str) -> str:
    """CTE `name`: item-equal means of e by dims with their normal intervals."""
    return f"""{name}_i AS (SELECT {dims}, user_id, avg(value) AS m, coalesce(var_samp(value), 0) AS v, count(value) AS r FROM e WHERE value IS NOT NULL GROUP BY ALL),
{name}_s AS (SELECT {dims}, count(*) AS n_items, sum(r) AS n_trials, avg(m) AS mean, sum(r * m) / sum(r) AS grand, sum(v * (r - 1)) AS ssw, sum(r * m * m) AS ssa, sum(r * r) AS sq FROM {name}_i GROUP BY ALL),
{name}_v AS (SELECT *, coalesce(ssw / nullif(n_trials - n_items, 0), 0) AS within_ FROM {name}_s),
{name}_b AS (SELECT *, greatest(coalesce(((ssa - n_trials * grand * grand) / nullif(n_items - 1, 0) - within_) / nullif((n_trials - sq / n_trials) / nullif(n_items - 1, 0), 0), 0), 0) AS between_ FROM {name}_v),
{name} AS (SELECT {dims}, n_items, n_trials, mean, CASE WHEN n_items >= 2 THEN mean - 1.959963984540054 * sqrt(between_ / n_items + within_ / n_trials) END AS low, CASE WHEN n_items >= 2 THEN mean + 1.959963984540054 * sqrt(between_ / n_items + within_ / n_trials) END AS high FROM {name}_b)"""


def sql_metrics(section: str, name: str, source: str, *metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, '{m}' AS metric, {m}::DOUBLE AS value FROM {source}" for m in metrics)


@query(f"""WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, (event_id % 40)::DOUBLE AS ms FROM events), {sql_interval('a', 'event_type')}, {sql_interval('b', 'kind')}, {sql_interval('c', 'event_type, kind')},
p AS (SELECT event_type, quantile_cont(ms, 0.5) AS cost, count(*) AS rows, count(value) AS scored FROM e GROUP BY 1), q AS (SELECT event_type, mean, cost, rows, scored FROM a JOIN p USING (event_type)),
f AS (SELECT *, (NOT EXISTS (SELECT 1 FROM q o WHERE o.mean >= q.mean AND o.cost <= q.cost AND (o.mean > q.mean OR o.cost < q.cost)))::INTEGER AS on_front FROM q), u AS (
{sql_metrics('models', 'event_type', 'a', 'mean', 'low', 'high', 'n_items', 'n_trials')} UNION ALL {sql_metrics('kinds', 'kind', 'b', 'mean', 'low', 'high', 'n_items', 'n_trials')}
UNION ALL {sql_metrics('heat', "event_type || '/' || kind", 'c', 'mean', 'low', 'high', 'n_items', 'n_trials')} UNION ALL {sql_metrics('frontier', 'event_type', 'f', 'cost', 'on_front')} UNION ALL {sql_metrics('provenance', 'event_type', 'f', 'rows', 'scored')})
SELECT section, name, metric, round(value, 5) AS value FROM u WHERE value IS NOT NULL""")
def report_rows(spark, d):
    rows = events(spark, d).withColumn("kind", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")).withColumn("ms", (F.col("event_id") % 40).cast("double"))
    return rp.report(rows, "event_type", "kind", "user_id", "value", "ms").select("section", "name", "metric", F.round("value", 5).alias("value"))


@query(f"""WITH e AS (SELECT *, 'k' || event_id % 2 AS kind, 'z' || event_id % 3 AS zone, (event_id % 40)::DOUBLE AS ms FROM events), s AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, avg(ms) AS ms FROM e GROUP BY 1),
v AS (SELECT event_type, count(*) AS items FROM (SELECT event_type, user_id FROM events GROUP BY ALL HAVING count(value) >= 2 AND stddev_samp(value) > 40) GROUP BY 1), {sql_interval('a', 'event_type, kind')}, {sql_interval('b', 'event_type, zone')},
w AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL), p AS (SELECT x.event_type || '/' || y.event_type AS pair, count(*) AS n, avg(x.m - y.m) AS diff, coalesce(stddev_samp(x.m - y.m), 0) AS sd FROM w x JOIN w y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY 1),
pd AS (SELECT pair, diff, diff - 1.96 * sd / sqrt(n) AS low, diff + 1.96 * sd / sqrt(n) AS high FROM p), u AS (
{sql_metrics('distribution', 'event_type', 's', 'n', 'mean', 'p50', 'p90')} UNION ALL {sql_metrics('unsteady', 'event_type', 'v', 'items')} UNION ALL {sql_metrics('timings', 'event_type', 's', 'ms')}
UNION ALL {sql_metrics('kind', "event_type || '/' || kind", 'a', 'mean', 'low', 'high', 'n_items')} UNION ALL {sql_metrics('zone', "event_type || '/' || zone", 'b', 'mean', 'low', 'high', 'n_items')} UNION ALL {sql_metrics('paired', 'pair', 'pd', 'diff', 'low', 'high')})
SELECT section, name, metric, round(value, 5) AS value FROM u WHERE value IS NOT NULL""")
def diagnostic_rows(spark, d):
    i = F.col("event_id")
    rows = events(spark, d).withColumns({"kind": F.concat(F.lit("k"), (i % 2).cast("string")), "zone": F.concat(F.lit("z"), (i % 3).cast("string")), "ms": (i % 40).cast("double")})
    return rp.diagnostics(rows, "event_type", "user_id", "value", 40, ["kind", "zone"], ["ms"]).select("section", "name", "metric", F.round("value", 5).alias("value"))


@query("""WITH l AS (SELECT o_orderkey AS q, o_orderpriority AS pri, list(CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END ORDER BY l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS rels, any_value(o_totalprice) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
r AS (SELECT *, len(list_filter(rels, lambda x: x > 0)) AS found, q % 4 = 0 AS none_, (q % 100) / 100.0::DOUBLE AS score, CASE WHEN q % 4 = 0 THEN 'unanswerable' WHEN len(list_filter(rels, lambda x: x > 0)) > 0 THEN 'answerable_retrievable' ELSE 'answerable_not_retrieved' END AS kind FROM l),
m AS (SELECT *, CASE WHEN NOT none_ THEN coalesce(list_sum(list_transform(rels[1:3], lambda x, i: x / log2(i + 1))) / nullif(list_sum(list_transform(list_reverse_sort(rels)[1:3], lambda x, i: x / log2(i + 1))), 0), 0) END AS ndcg,
CASE WHEN NOT none_ AND found > 0 THEN len(list_filter(rels[1:3], lambda x: x > 0)) / found::DOUBLE END AS recall, CASE WHEN NOT none_ THEN coalesce(1.0 / nullif(list_position(list_transform(rels[1:3], lambda x: x > 0), true), 0), 0) END AS mrr FROM r),
c AS (SELECT pri, th, count(*) FILTER (kind = 'unanswerable' AND score < th) / count(*) FILTER (kind = 'unanswerable')::DOUBLE AS rec, count(*) FILTER (kind = 'unanswerable' AND score >= th) / count(*) FILTER (kind = 'unanswerable')::DOUBLE AS fa, count(*) FILTER (kind = 'answerable_retrievable' AND score < th) / count(*) FILTER (kind = 'answerable_retrievable')::DOUBLE AS fb FROM m, (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS th) GROUP BY ALL),
o AS (SELECT pri, th, rec, fa, fb FROM c WHERE fa <= 0.3 QUALIFY row_number() OVER (PARTITION BY pri ORDER BY rec DESC, th) = 1),
z AS (SELECT pri, list(price ORDER BY price) AS ps FROM m GROUP BY 1)
SELECT 'pri=' || pri AS slice, count(*)::BIGINT AS n, count(*) FILTER (kind = 'unanswerable')::BIGINT AS unanswerable, count(*) FILTER (kind = 'answerable_retrievable')::BIGINT AS answerable_retrievable, count(*) FILTER (kind = 'answerable_not_retrieved')::BIGINT AS answerable_not_retrieved,
round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6)::DOUBLE AS mrr, any_value(ps[len(ps) // 2 + 1]) AS p50, any_value(ps[floor(len(ps) * 0.95)::INTEGER + 1]) AS p95, coalesce(any_value(th), 0)::DOUBLE AS operating_t, round(coalesce(any_value(rec), 0), 6)::DOUBLE AS abstain_recall, round(coalesce(any_value(fb), 0), 6)::DOUBLE AS false_abstain
FROM m JOIN z USING (pri) LEFT JOIN o USING (pri) GROUP BY pri""")
def slice_rollups(spark, d):
    rows = slice_rows(spark, d)
    told = rp.slice_rollup(rows, ["pri"], "q", "rels", "found", "kind", "score", "price", k=3, ceiling=0.3, draws=50)
    return told.select("slice", "n", "unanswerable", "answerable_retrievable", "answerable_not_retrieved", *r6("ndcg", "recall", "mrr"), "p50", "p95", "operating_t", *r6("abstain_recall", "false_abstain"))


def slice_rows(spark, d):
    """Orders as questions, their lines as what was found, by priority."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 25, 1).otherwise(0).alias("y"))
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "y"))).alias("s"))  # an order's lines are few
    o = t(spark, d, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("pri"), F.transform("s", lambda x: x["y"]).alias("rels"), F.col("o_totalprice").alias("price"), ((F.col("o_orderkey") % 100) / 100.0).alias("score"))
    found = F.size(F.filter("rels", lambda x: x > 0))
    return o.select("*", found.alias("found"), F.when(F.col("q") % 4 == 0, "unanswerable").when(found > 0, "answerable_retrievable").otherwise("answerable_not_retrieved").alias("kind"))


@query()
def slice_tests(spark, d):
    """Each priority's lists against the same lists turned round."""
    rows = written(slice_rows(spark, d), "lists")
    return rp.slice_rollup(rows, ["pri"], "q", "rels", "found", "kind", "score", "price", rows.withColumn("rels", F.reverse("rels")), k=3).select("slice", "ndcg", "ndcg_low", "ndcg_high", "p_value")


@query("""WITH RECURSIVE s AS (SELECT o_orderpriority AS name, count(*) % 40 AS size FROM orders GROUP BY 1), f AS (SELECT *, (row_number() OVER (ORDER BY size DESC, name) <= 60 AND size > 0)::INTEGER AS one FROM s),
l AS (SELECT *, size - one AS spare, greatest(least(60, sum(size) OVER ()) - sum(one) OVER (), 0) AS rest FROM f), p AS (SELECT *, floor(coalesce(rest * spare / nullif(sum(spare) OVER (), 0), 0)) AS part FROM l),
n AS (SELECT *, rest - sum(part) OVER () AS over_, row_number() OVER (ORDER BY spare - part DESC, name) AS nth FROM p)
SELECT name, size::BIGINT AS size, (one + part + CASE WHEN nth <= over_ AND part < spare THEN 1 ELSE 0 END)::BIGINT AS seats FROM n""")
def rung_seats(spark, d):
    s = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.count("*") % 40).alias("size"))
    return pl.rungs(s, "name", "size", 60)


@query("SELECT s_suppkey AS id, (s_suppkey * 2) % 7 AS tone, (s_suppkey * 7 + 1) % 10 AS level FROM supplier")
def stride_coordinates(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).select("id", *pl.strides(7, {"tone": 7, "level": 10}))


@query("""WITH b AS (SELECT event_id, user_id, ts, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INTEGER AS better, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS at_ FROM events),
i AS (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS streak FROM i)
SELECT user_id, min(at_) FILTER (streak >= 10)::BIGINT AS stop_at FROM k GROUP BY 1""")
def stopping_points(spark, d):
    return sel.stops(events(spark, d), "user_id", ["ts", "event_id"], "value", 10)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY user_id, event_type, ts, event_id")
def canonical_events(spark, d):
    return sel.canonical(events(spark, d), ["user_id", "event_type", "ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(f"""WITH {VC}, q AS (SELECT *, 16.0::DOUBLE / (1.96 * 1.96) - between_ / n_items AS room FROM vc), j AS (SELECT event_type, n_items, least(greatest(coalesce(CASE WHEN room > 0 THEN ceil(within / (n_items * room)) END, 50), 2), 50)::BIGINT AS own FROM q), k AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN greatest(own, max(own) FILTER (event_type NOT IN ('click', 'view')) OVER ()) ELSE own END AS needed FROM j),
z AS (SELECT *, sum(needed * n_items) OVER () AS trials FROM k) SELECT event_type, needed, CASE WHEN trials > 3000 THEN greatest(floor(needed * 3000.0::DOUBLE / trials), 2)::BIGINT ELSE needed END AS reps FROM z""")
def strata_sizes(spark, d):
    parts = st.variance_components(events(spark, d), ["event_type"], "user_id", "value")
    return pl.sized_strata(parts, 4.0, 3000, multi=F.col("event_type").isin("click", "view")).select("event_type", "needed", "reps")


@query("""WITH RECURSIVE s AS (SELECT p_brand AS name, count(*) AS size FROM part GROUP BY 1), t_ AS (SELECT unnest([10, 60, 200]) AS total, unnest([0, 1, 2]) AS i),
f AS (SELECT i, total, name, size, (row_number() OVER (PARTITION BY i ORDER BY size DESC, name) <= total AND size > 0)::INTEGER AS one FROM s, t_),
l AS (SELECT *, size - one AS spare, greatest(least(total, sum(size) OVER (PARTITION BY i)) - sum(one) OVER (PARTITION BY i), 0) AS rest FROM f), p AS (SELECT *, floor(coalesce(rest * spare / nullif(sum(spare) OVER (PARTITION BY i), 0), 0)) AS part FROM l),
n AS (SELECT *, rest - sum(part) OVER (PARTITION BY i) AS over_, row_number() OVER (PARTITION BY i ORDER BY spare - part DESC, name) AS nth FROM p),
z AS (SELECT i, name, one + part + CASE WHEN nth <= over_ AND part < spare THEN 1 ELSE 0 END AS seats FROM n),
k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part)
SELECT p_partkey, p_brand, min(i)::INTEGER AS rung FROM k JOIN z ON name = p_brand AND nth <= seats GROUP BY ALL""")
def rung_ladder(spark, d):
    return pl.ladder(t(spark, d, "part"), "p_brand", ["p_partkey"], [10, 60, 200]).select("p_partkey", "p_brand", "rung")


@query(f"""WITH {MEANS}, m AS (SELECT event_type, avg(m) AS s, 1.96 * stddev_samp(m) / sqrt(count(*)) AS half FROM means GROUP BY 1)
SELECT x.event_type AS champion, y.event_type AS challenger, y.s - x.s >= 0.5 AND y.event_type <> 'view' AS promoted, y.event_type <> 'error' AND (x.event_type = 'click' OR y.s >= x.s - 0.25 * y.half) AS escalates FROM m x JOIN m y ON x.event_type <> y.event_type""")
def promotions(spark, d):
    """Every type as champion and challenger: one is not usable, one has had no promotion, one has no rung before it."""
    m = rp.slice_scores(events(spark, d), "event_type", "user_id", "value")
    x, y = m.select(F.col("event_type").alias("champion"), F.col("mean").alias("x")), m.select(F.col("event_type").alias("challenger"), F.col("mean").alias("y"), F.col("half_width").alias("half"))
    both = x.join(y, F.col("champion") != F.col("challenger"))  # five types
    prior = F.when(F.col("champion") != "click", F.col("x"))
    return both.select("champion", "challenger", pl.promotion(F.col("x"), F.col("y"), 0.5, F.col("challenger") != "view").alias("promoted"), pl.escalates(F.col("y"), prior, F.col("half"), F.col("challenger") != "error", 0.25).alias("escalates"))


@query("""WITH v AS (SELECT p_brand, round(avg(p_size), 0) AS score, 1.96 * stddev_samp(p_size) / sqrt(count(*)) AS half FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, half, p_brand) AS nth, lead(score) OVER (ORDER BY score DESC, half, p_brand) AS next FROM v)
SELECT p_brand, score, round(half, 6) AS half, score - next < 0.5 AS tie FROM r WHERE nth = 1""")
def tournament_winner(spark, d):
    v = t(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 0).alias("score"), (1.96 * F.stddev_samp("p_size") / F.sqrt(F.count("*"))).alias("half"))
    return pl.tournament(v, "p_brand", "score", "half", 0.5).select("p_brand", "score", *r6("half"), "tie")


@query("""WITH e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS x, b.s_nationkey AS y FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 40)
SELECT a, b, row_number() OVER (ORDER BY (x = y)::INTEGER, a, b)::INTEGER AS place, ['new', 'old', 'other'][(row_number() OVER (ORDER BY (x = y)::INTEGER, a, b) - 1) % 3 + 1] AS persona FROM e""")
def spec_pairs(spark, d):
    s = t(spark, d, "supplier")
    one = s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("x"), F.col("s_acctbal").alias("p"), F.explode(F.array(*[(F.floor(F.col("s_acctbal") / 40) + i) for i in (-1, 0, 1)])).alias("cell"))
    two = s.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("y"), F.col("s_acctbal").alias("q"), F.floor(F.col("s_acctbal") / 40).alias("cell"))
    near = one.join(two, "cell").where((F.col("a") < F.col("b")) & (F.abs(F.col("p") - F.col("q")) < 40))  # near balances share or neighbour a cell
    return pl.spec_pairs(near, "a", "b", "x", "y", ["new", "old", "other"]).select("a", "b", "place", "persona")


@query("SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 25")
def log_tail(spark, d):
    """Events written to a log, read back, and the last 25 of it."""
    path = f"{scratch(spark)}/log-{uuid.uuid4().hex}"
    logs.append_log(events(spark, d).select("event_id", "event_type", "value"), path)
    return logs.recent(logs.read_log(spark, path, "event_id long, event_type string, value double"), ["event_id"], 25)


@query("""SELECT o_orderpriority AS island, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS champion FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def last_champions(spark, d):
    return logs.last_champions(t(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"]).select(F.col("o_orderpriority").alias("island"), F.col("o_orderkey").alias("champion"))


@query("""WITH l AS (SELECT doc_id % 300 AS id, nullif(trim(text), '') AS body, doc_id AS pos FROM documents) SELECT id, length(arg_max(body, pos))::INTEGER AS length FROM l WHERE body IS NOT NULL GROUP BY 1""")
def body_lengths(spark, d):
    rows = t(spark, d, "documents").select((F.col("doc_id") % 300).alias("id"), F.col("text").alias("body"), F.col("doc_id").alias("pos"))
    return corpus.body_table(rows, "id", "body", ["pos"]).select("id", F.length("body").alias("length"))


@query("""WITH c AS (SELECT doc_id % 300 AS id, doc_id, lang, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id) AS nth FROM documents)
SELECT c.id, c.doc_id, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE 'all' END AS grade FROM c LEFT JOIN labels l ON l.doc_id = c.id WHERE nth = 1""")
def built_corpus(spark, d):
    rows = t(spark, d, "documents").select((F.col("doc_id") % 300).alias("id"), "doc_id")
    meta = t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("grade"))
    return corpus.build(rows, meta, "id", ["doc_id"], ["grade"])


@query("""WITH p AS (SELECT 1 AS rank, doc_id AS id, quality AS v FROM labels UNION ALL SELECT 2, doc_id, toxic FROM labels WHERE doc_id % 3 = 0) SELECT id, arg_max(v, rank) AS v FROM p GROUP BY 1""")
def layered_labels(spark, d):
    x = t(spark, d, "labels")
    return corpus.layered([x.select(F.col("doc_id").alias("id"), F.col("quality").alias("v")), x.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("toxic").alias("v"))], ["id"])


def backfill_of(spark, d):
    """Events as lines of a log, every 50th of them cut short, taken over; (where, counters)."""
    root = f"{scratch(spark)}/backfill-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", "props"))
    lines = events(spark, d).select(F.when(F.col("event_id") % 50 == 7, F.left(line, F.lit(20))).otherwise(line).alias("value"))
    judged = t(spark, d, "labels").select(F.col("doc_id").alias("event_id"), F.col("quality").alias("judged"))
    told = logs.backfill(lines, judged, root, "event_id long, user_id long, ts string, event_type string, props string", "event_id", "event_type", {"click": "m1", "view": "m2", "error": "m3"}, "user_id", ["ts", "event_id"], "props", 8)
    return root, told


LEFT_OUT = "CASE WHEN event_id % 50 = 7 THEN 'malformed' WHEN event_type NOT IN ('click', 'view', 'error') THEN 'unknown' WHEN length(props) > 8 THEN 'oversize' ELSE 'instance' END"


@query(f"""WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE event_type WHEN 'click' THEN 'm1' WHEN 'view' THEN 'm2' WHEN 'error' THEN 'm3' END AS model FROM events WHERE {LEFT_OUT} = 'instance')
SELECT event_id, model, row_number() OVER (PARTITION BY user_id, model ORDER BY ts, event_id)::BIGINT - 1 AS instance, quality AS judged FROM e LEFT JOIN labels ON doc_id = event_id""")
def backfilled(spark, d):
    root, _ = backfill_of(spark, d)
    return spark.read.parquet(f"{root}/outcome=instance").select("event_id", "model", "instance", "judged")


@query(f"""WITH o AS (SELECT {LEFT_OUT} AS outcome, event_type FROM events) SELECT outcome AS name, count(*)::BIGINT AS counted, CASE WHEN outcome <> 'instance' THEN count(*) ELSE 0 END::BIGINT AS written FROM o GROUP BY outcome
UNION ALL SELECT 'unknown/' || event_type, count(*), 0 FROM o WHERE outcome = 'unknown' GROUP BY event_type""")
def backfill_unknown(spark, d):
    """What the one pass counted, and what stands in the side outputs."""
    root, told = backfill_of(spark, d)
    counted = [("instance", told.instances), ("malformed", told.malformed), ("unknown", told.unknown), ("oversize", told.oversize), *((f"unknown/{m}", n) for m, n in told.unknown_models.items())]
    counts = spark.createDataFrame([c for c in counted if c[1]], "name string, counted long")
    sides = spark.read.parquet(root).where("line IS NOT NULL").groupBy(F.col("outcome").alias("name")).agg(F.count("*").alias("written"))
    return counts.join(sides, "name", "left").na.fill(0, ["written"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def customers_without_urgent(spark, d):
    done = t(spark, d, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return logs.pending(t(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))::BIGINT AS without_lines, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS without_labels")
def integrity_of_parts(spark, d):
    a = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("without_lines"))
    b = t(spark, d, "embeddings").join(t(spark, d, "labels"), F.col("vec_id") == F.col("doc_id"), "left_anti").agg(F.count("*").alias("without_labels"))
    return a.crossJoin(b)  # two single rows


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled_vectors(spark, d):
    good = t(spark, d, "labels").where("quality = 1")
    return t(spark, d, "embeddings").join(good, F.col("vec_id") == F.col("doc_id"), "left_semi").select("vec_id")


@query("SELECT event_id, user_id, count(*) OVER w AS done, sum((event_type = 'error')::INTEGER) OVER w::BIGINT AS failed, count(*) OVER w >= 8 AND sum((event_type = 'error')::INTEGER) OVER w > 0.5 * count(*) OVER w AS paused FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_counters(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    done, failed = F.count("*").over(w), F.sum((F.col("event_type") == "error").cast("int")).over(w)
    return events(spark, d).select("event_id", "user_id", done.alias("done"), failed.alias("failed"), ((done >= 8) & (failed > 0.5 * done)).alias("paused"))


@query()
def mean_intervals(spark, d):
    return bs.mean_bootstrap(events(spark, d), ["event_type"], "event_id", "value")
