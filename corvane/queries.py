"""Named queries over the tables, each with the SQL it is compared with.

Events stand for a trial log (event_type: model, user_id: item, value: score), benchmark texts for questions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ranking as rk
from .functions import scores as sc
from .functions import text as tx
from .operators import bootstrap as bs
from .operators import calibration as cal
from .operators import reports as rp
from .operators import retrieval as rt
from .operators import selection as sel
from .operators import statistics as st
from .plans.hybrid import hybrid_search
from .shared import scratch
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
WORDS = W.format("text")
MEANS = "means AS (SELECT event_type, user_id, avg(value) AS m, coalesce(var_samp(value), 0) AS v, count(value) AS r FROM events WHERE value IS NOT NULL GROUP BY ALL)"
VC = MEANS + """, s AS (SELECT event_type, count(*) AS n_items, sum(r) AS n_trials, avg(m) AS mean, sum(r * m) / sum(r) AS grand, sum(v * (r - 1)) AS ssw, sum(r * m * m) AS ssa, sum(r * r) AS sq FROM means GROUP BY 1),
vc AS (SELECT *, ssw / (n_trials - n_items) AS within, greatest(((ssa - n_trials * grand * grand) / (n_items - 1) - ssw / (n_trials - n_items)) / ((n_trials - sq / n_trials) / (n_items - 1)), 0) AS between_ FROM s)"""
LISTS = """lists AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS every, list(event_id ORDER BY ts, event_id) FILTER (event_type = 'purchase' AND value > 20) AS g FROM events GROUP BY 1),
l AS (SELECT user_id, every AS ranked, coalesce(g, []) AS gold FROM lists)"""
BM25 = f"""qt AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS})) AS term FROM benchmark),
d AS (SELECT doc_id, {WORDS} AS w FROM documents), c AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf, mean FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM p JOIN qt USING (term) JOIN idf USING (term) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)"""
OVERLAP = """ov AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank
FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM d) JOIN qt USING (term) GROUP BY query_id, doc_id QUALIFY rank <= 20)"""


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def questions(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def legs(spark, d):
    docs, ask = t(spark, d, "documents"), questions(spark, d)
    posted = rt.postings(docs, rt.query_terms(ask))
    return rt.bm25(docs, ask, 20, posted=posted), rt.overlap(docs, ask, 20, posted=posted)


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM bm WHERE rank <= 10")
def bm25_top10(spark, d):
    return rt.bm25(t(spark, d, "documents"), questions(spark, d), 10).select("query_id", "doc_id", *r6("score"), "rank")


@query(f"WITH {BM25}, {OVERLAP} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM ov")
def overlap_top20(spark, d):
    return legs(spark, d)[1].select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {BM25}, {OVERLAP}, u AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ov),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= 10""")
def rrf_top10(spark, d):
    return rt.rrf(list(legs(spark, d))).select("query_id", "doc_id", *r6("score"), "rank")


@query(f"""WITH {BM25}, {OVERLAP}, u AS (SELECT query_id, doc_id, score, 1 AS leg FROM bm UNION ALL SELECT query_id, doc_id, score, 2 FROM ov),
n AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM u WINDOW w AS (PARTITION BY leg, query_id)),
f AS (SELECT query_id, doc_id, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END) / 2, 9) AS score FROM n GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= 10""")
def min_max_top10(spark, d):
    return rt.min_max_fusion(list(legs(spark, d))).select("query_id", "doc_id", *r6("score"), "rank")


@query(f"""WITH {BM25}, x AS (SELECT query_id, bm.doc_id, bm.rank AS arm_rank, len(list_intersect({W.format('b.text')}, w)) AS shared FROM bm JOIN benchmark b ON item_id = query_id JOIN d USING (doc_id))
SELECT query_id, doc_id, arm_rank::INTEGER AS arm_rank, CASE WHEN shared = 0 THEN -5.0 ELSE shared END::DOUBLE AS rerank_score,
row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, arm_rank)::INTEGER AS rank FROM x QUALIFY rank <= 5""")
def lexical_rerank_top5(spark, d):
    docs, ask = t(spark, d, "documents"), questions(spark, d)
    pool = rt.bm25(docs, ask, 20).join(ask.withColumnRenamed("text", "q"), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    return rt.lexical_rerank(pool, F.col("q"), F.col("text"), 5).select("query_id", "doc_id", "arm_rank", "rerank_score", "rank")


@query(f"""WITH {BM25}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
k AS (SELECT item_id AS query_id, x.vec_id AS doc_id, round(list_cosine_similarity(q.e, x.e), 9) AS score FROM benchmark JOIN v q ON q.vec_id = item_id JOIN v x ON x.vec_id IN (SELECT doc_id FROM documents) AND x.vec_id <> item_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k QUALIFY rank <= 20),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM dense) GROUP BY ALL),
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS arm_rank FROM f QUALIFY arm_rank <= 20),
x AS (SELECT query_id, a.doc_id, arm_rank, len(list_intersect({W.format('b.text')}, w)) AS shared FROM a JOIN benchmark b ON item_id = query_id JOIN d USING (doc_id))
SELECT query_id, doc_id, CASE WHEN shared = 0 THEN -5.0 ELSE shared END::DOUBLE AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, arm_rank)::INTEGER AS rank FROM x QUALIFY rank <= 5""")
def hybrid_top5(spark, d):
    """Documents and questions go by the vector of their number; results are kept and asked for twice."""
    v = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    docs = t(spark, d, "documents").join(v, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "text", "vector")
    ask = questions(spark, d).join(v, F.col("query_id") == F.col("vec_id"), "left").select("query_id", "text", "vector")
    memo = f"{scratch(spark)}/memo-{uuid.uuid4().hex}"
    hybrid_search(docs, ask.where("query_id % 2 = 0"), memo=memo)
    return hybrid_search(docs, ask, memo=memo)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def knn_top10(spark, d):
    v = t(spark, d, "embeddings")
    return rt.knn(v, v.where("vec_id % 50 = 0")).select("query_id", "vec_id", sc.rounded(F.col("score"), 6).alias("score"), "rank")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q JOIN v ON v.label = 1 WHERE q.vec_id % 50 = 0 AND q.label <> 1)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 8""")
def hard_negatives(spark, d):
    v = t(spark, d, "embeddings")
    return rt.knn(v, v.where("vec_id % 50 = 0 AND label <> 1"), 8, where="label = 1").select("query_id", "vec_id", sc.rounded(F.col("score"), 6).alias("score"), "rank")


def ranked_lists(spark, d):
    """Each user's events in order of time, and the larger purchases among them as what is relevant."""
    e = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    g = F.array_sort(F.collect_list(F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), F.struct("ts", "event_id"))))
    ids = lambda c: F.transform(c, lambda x: x["event_id"])
    return t(spark, d, "events").groupBy("user_id").agg(e.alias("e"), g.alias("g")).select("user_id", ids(F.col("e")).alias("ranked"), ids(F.col("g")).alias("gold"))


@query(f"""WITH {LISTS}, h AS (SELECT user_id, ranked, gold, list_transform(ranked, lambda x: list_contains(gold, x)::INTEGER) AS hit, len(gold) AS ng FROM l)
SELECT user_id, list_sum(hit[1:5]) / 5.0::DOUBLE AS precision_5, CASE WHEN ng = 0 THEN 0.0 ELSE list_sum(hit[1:5]) / ng::DOUBLE END AS recall_5,
CASE WHEN list_sum(hit) = 0 THEN 0.0 ELSE round(1.0 / list_position(hit, 1), 6) END::DOUBLE AS mrr,
CASE WHEN ng = 0 THEN 0.0 ELSE round(list_sum(list_transform(hit[1:10], lambda x, i: x / log2(i + 1))) / list_sum(list_transform(range(1, least(10, ng) + 1), lambda i: 1 / log2(i + 1))), 6) END::DOUBLE AS ndcg_10,
CASE WHEN list_sum(hit) = 0 THEN 0.0 ELSE round(list_sum(list_transform(hit, lambda x, i: x * list_sum(hit[1:i]) / i)) / list_sum(hit), 6) END::DOUBLE AS ap,
CASE WHEN ng = 0 THEN NULL ELSE list_sum(hit) > 0 END AS present,
CASE WHEN ng = 0 THEN 'unanswerable' WHEN list_sum(hit) > 0 THEN 'answerable_retrievable' ELSE 'answerable_not_retrieved' END AS class FROM h""")
def ranking_metrics(spark, d):
    r, g = F.col("ranked"), F.col("gold")
    return ranked_lists(spark, d).select(
        "user_id", rk.precision_at_k(r, g, 5).alias("precision_5"), rk.recall_at_k(r, g, 5).alias("recall_5"), F.round(rk.reciprocal_rank(r, g), 6).alias("mrr"),
        F.round(rk.ndcg_at_k(r, g, 10), 6).alias("ndcg_10"), F.round(rk.average_precision(r, g), 6).alias("ap"), rk.gold_presence(r, g).alias("present"), rk.retrieval_class(r, g).alias("class"),
    )


@query("""WITH l AS (SELECT o_custkey, list(CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END ORDER BY o_orderkey) AS y FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(round(list_sum(list_transform(y[1:5], lambda x, i: x / log2(i + 1))) / nullif(list_sum(list_transform(list_reverse_sort(y)[1:5], lambda x, i: x / log2(i + 1))), 0), 6), 0)::DOUBLE AS ndcg_5 FROM l""")
def label_ndcg(spark, d):
    y = F.when(F.col("o_orderpriority") == "1-URGENT", 2.0).when(F.col("o_orderpriority") == "2-HIGH", 1.0).otherwise(0.0)
    rows = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", y.alias("y")))).alias("s"))
    return rows.select("o_custkey", F.round(rk.ndcg_of_labels(F.transform("s", lambda x: x["y"]), 5), 6).alias("ndcg_5"))


@query(f"WITH {MEANS} SELECT event_type, round(avg(m), 6) AS mean, count(*)::BIGINT AS n_items, sum(r)::BIGINT AS n_trials FROM means GROUP BY 1")
def item_equal_means(spark, d):
    return st.item_equal_mean(t(spark, d, "events"), ["event_type"], "user_id", "value").select("event_type", *r6("mean"), "n_items", "n_trials")


@query(f"WITH {VC} SELECT event_type, n_items::BIGINT AS n_items, n_trials::BIGINT AS n_trials, round(mean, 6) AS mean, round(between_, 4) AS between, round(within, 4) AS within FROM vc")
def variance_parts(spark, d):
    v = st.variance_components(t(spark, d, "events"), ["event_type"], "user_id", "value")
    return v.select("event_type", "n_items", "n_trials", *r6("mean"), F.round("between", 4).alias("between"), F.round("within", 4).alias("within"))


@query(f"""WITH {VC}, h AS (SELECT *, 1.959963984540054 * sqrt(between_ / n_items + within / n_trials) AS half FROM vc)
SELECT event_type, n_items::BIGINT AS n_items, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high, n_items < 2 AS insufficient FROM h""")
def normal_intervals(spark, d):
    return st.normal_interval(t(spark, d, "events"), ["event_type"], "user_id", "value").select("event_type", "n_items", *r6("mean", "low", "high"), "insufficient")


@query()
def bootstrap_intervals(spark, d):
    return bs.bootstrap_interval(t(spark, d, "events"), ["event_type"], "user_id", "value")


@query(f"""WITH {VC}, q AS (SELECT *, 16.0::DOUBLE / (1.96 * 1.96) - between_ / n_items AS room FROM vc)
SELECT event_type, least(greatest(coalesce(CASE WHEN room > 0 THEN ceil(within / (n_items * room)) END, 50), 2), 50)::BIGINT AS reps, room <= 0 AS unreachable FROM q""")
def required_repeats(spark, d):
    v = st.variance_components(t(spark, d, "events"), ["event_type"], "user_id", "value")
    return st.required_reps(v, 4.0).select("event_type", "reps", "unreachable")


@query(f"""WITH {MEANS}, p AS (SELECT x.event_type AS a, y.event_type AS b, count(*) AS n_items, avg(x.m - y.m) AS diff, coalesce(stddev_samp(x.m - y.m), 0) AS sd FROM means x JOIN means y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY ALL)
SELECT a, b, n_items::BIGINT AS n_items, round(diff, 6) AS diff, round(diff - 1.96 * sd / sqrt(n_items), 6) AS low, round(diff + 1.96 * sd / sqrt(n_items), 6) AS high,
CASE WHEN diff - 1.96 * sd / sqrt(n_items) > 0 THEN a WHEN diff + 1.96 * sd / sqrt(n_items) < 0 THEN b END AS winner FROM p""")
def paired_models(spark, d):
    return st.paired_differences(t(spark, d, "events"), "event_type", "user_id", "value").select("a", "b", "n_items", *r6("diff", "low", "high"), "winner")


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def value_distribution(spark, d):
    return st.distribution(t(spark, d, "events"), ["event_type"], "value").select("event_type", "n", *r6("mean", "p50", "p90", "p95"))


@query("WITH l AS (SELECT user_id, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT user_id, v[len(v) // 2 + 1] AS p50, v[least(floor(len(v) * 0.95), len(v) - 1)::INTEGER + 1] AS p95 FROM l")
def nearest_rank_percentiles(spark, d):
    return st.nearest_ranks(t(spark, d, "events"), ["user_id"], "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH p AS (SELECT p_brand, avg(p_retailprice) AS cost, avg(p_size) AS quality FROM part GROUP BY 1)
SELECT p_brand, round(cost, 6) AS cost, round(quality, 6) AS quality, NOT EXISTS (SELECT 1 FROM p o WHERE o.quality >= p.quality AND o.cost <= p.cost AND (o.quality > p.quality OR o.cost < p.cost)) AS on_front FROM p""")
def pareto_front(spark, d):
    p = t(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("cost"), F.avg("p_size").alias("quality"))
    return st.pareto(p, "quality", "cost").select("p_brand", *r6("cost", "quality"), "on_front")


@query("SELECT event_type, user_id, round(stddev_samp(value), 6) AS sd, count(value)::BIGINT AS reps FROM events GROUP BY ALL HAVING count(value) >= 2 AND stddev_samp(value) > 40")
def high_variance(spark, d):
    return st.high_variance_items(t(spark, d, "events"), ["event_type"], "user_id", "value", 40).select("event_type", "user_id", *r6("sd"), "reps")


#: The kinds of question that events stand for: nothing answers an error, what a click asks for was not found.
KINDS = "CASE event_type WHEN 'error' THEN 'unanswerable' WHEN 'click' THEN 'answerable_not_retrieved' ELSE 'answerable_retrievable' END"


def kinds(spark, d):
    kind = F.when(F.col("event_type") == "error", "unanswerable").when(F.col("event_type") == "click", "answerable_not_retrieved").otherwise("answerable_retrievable")
    return t(spark, d, "events").select("event_id", "user_id", "value", kind.alias("kind"))


def sql_curve(thresholds: str) -> str:
    return f"""e AS (SELECT value, {KINDS} AS kind FROM events), th AS (SELECT unnest({thresholds})::DOUBLE AS threshold),
k AS (SELECT threshold, count(*) FILTER (kind = 'unanswerable' AND value < threshold) / count(*) FILTER (kind = 'unanswerable')::DOUBLE AS recall, count(*) FILTER (kind = 'unanswerable' AND value >= threshold) / count(*) FILTER (kind = 'unanswerable')::DOUBLE AS false_answer,
count(*) FILTER (kind = 'answerable_retrievable' AND value < threshold) / count(*) FILTER (kind = 'answerable_retrievable')::DOUBLE AS false_abstain FROM e, th GROUP BY 1)"""


@query(f"WITH {sql_curve('[10.0, 50.0, 100.0, 200.0]')} SELECT threshold, round(recall, 6) AS recall, round(false_answer, 6) AS false_answer, round(false_abstain, 6) AS false_abstain FROM k")
def abstention(spark, d):
    return st.abstention_curve(kinds(spark, d), "value", "kind", [10.0, 50.0, 100.0, 200.0]).select("threshold", *r6("recall", "false_answer", "false_abstain"))


VERDICTS = "verdicts AS (SELECT x.event_type AS a, y.event_type AS b, CASE WHEN x.m > y.m THEN x.event_type WHEN y.m > x.m THEN y.event_type END AS w FROM means x JOIN means y ON x.user_id = y.user_id AND x.event_type < y.event_type)"


def verdicts(spark, d):
    m = st.item_means(t(spark, d, "events"), ["event_type"], "user_id", "value")
    x, y = m.select("user_id", F.col("event_type").alias("a"), F.col("item_mean").alias("x")), m.select("user_id", F.col("event_type").alias("b"), F.col("item_mean").alias("y"))
    return x.join(y, "user_id").where("a < b").select("user_id", "a", "b", F.when(F.col("x") > F.col("y"), F.col("a")).when(F.col("y") > F.col("x"), F.col("b")).alias("w"))


@query(f"""WITH {MEANS}, {VERDICTS}, u AS (SELECT a AS model, b AS other, CASE WHEN w IS NULL THEN 0.5 WHEN w = a THEN 1 ELSE 0 END AS s FROM verdicts UNION ALL SELECT b, a, CASE WHEN w IS NULL THEN 0.5 WHEN w = b THEN 1 ELSE 0 END FROM verdicts)
SELECT model, other, count(*)::BIGINT AS games, round(avg(s), 6)::DOUBLE AS rate FROM u GROUP BY ALL""")
def win_matrix(spark, d):
    return st.win_rates(verdicts(spark, d), "a", "b", "w").select("model", "other", "games", *r6("rate"))


@query(f"""WITH {MEANS}, {VERDICTS}, u AS (SELECT a AS model, CASE WHEN w IS NULL THEN 0.5 WHEN w = a THEN 1 ELSE 0 END AS s FROM verdicts UNION ALL SELECT b, CASE WHEN w IS NULL THEN 0.5 WHEN w = b THEN 1 ELSE 0 END FROM verdicts)
SELECT model, count(*)::BIGINT AS games, round(avg(s), 6)::DOUBLE AS score FROM u GROUP BY ALL UNION ALL SELECT 'unplayed', 0, 0.5""")
def pooled_win_scores(spark, d):
    """Every model's score over all of its games; one that never played has half."""
    models = t(spark, d, "events").select(F.col("event_type").alias("model")).distinct().unionByName(spark.createDataFrame([("unplayed",)], "model string"))
    return st.pooled_scores(st.win_rates(verdicts(spark, d), "a", "b", "w", models)).select("model", "games", *r6("score"))


@query(f"""WITH {MEANS}, {VERDICTS}, c AS (SELECT a, b, count(*) FILTER (w = a) AS hits, count(*) AS n FROM verdicts GROUP BY ALL), p AS (SELECT *, hits / n::DOUBLE AS p, 1.96 AS z FROM c)
SELECT a, b, n::BIGINT AS n, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM p""")
def wilson_intervals(spark, d):
    c = verdicts(spark, d).groupBy("a", "b").agg(F.count(F.when(F.col("w") == F.col("a"), 1)).alias("hits"), F.count("*").alias("n"))
    low, high = sc.wilson(F.col("hits"), F.col("n"))
    return c.select("a", "b", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


RANKED = "rows_ AS (SELECT l_returnflag AS g, l_quantity AS x, round(l_extendedprice, -3) AS y FROM lineitem), k AS (SELECT g, x, y, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM rows_)"


@query(f"WITH {RANKED} SELECT g, count(*)::BIGINT AS n, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson, round(avg(abs(x - y)), 4) AS mae, coalesce(corr(rx, ry) < 0.6, true) AS low FROM k GROUP BY 1")
def rank_agreement(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.round("l_extendedprice", -3).alias("y"))
    return st.agreement(rows, ["g"], "x", "y").select("g", "n", *r6("spearman", "pearson"), F.round("mae", 4).alias("mae"), "low")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def trend_lines(spark, d):
    o = st.trend(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return o.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query("""WITH c AS (SELECT l_returnflag AS model, l_shipmode AS kind, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS l_shipmode FROM lineitem) GROUP BY ALL), m AS (SELECT model, map_from_entries(list((kind, n) ORDER BY kind)) AS kind_counts FROM c GROUP BY 1)
SELECT l_returnflag, count(*)::BIGINT AS n_trials, count(DISTINCT l_orderkey)::BIGINT AS n_items, round(avg(l_quantity), 6)::DOUBLE AS l_quantity_mean, quantile_cont(l_quantity, 0.5)::DOUBLE AS l_quantity_p50, quantile_cont(l_quantity, 0.9)::DOUBLE AS l_quantity_p90, quantile_cont(l_quantity, 0.95)::DOUBLE AS l_quantity_p95,
round(avg(l_extendedprice), 4)::DOUBLE AS mean_l_extendedprice, round(avg(l_discount), 6)::DOUBLE AS mean_l_discount, any_value(kind_counts['large'])::BIGINT AS large, any_value(kind_counts['small'])::BIGINT AS small FROM lineitem JOIN m ON model = l_returnflag GROUP BY 1""")
def model_cards(spark, d):
    rows = t(spark, d, "lineitem").withColumn("kind", F.when(F.col("l_quantity") > 25, "large").otherwise("small"))
    cards = rp.model_cards(rows, "l_returnflag", "l_orderkey", ["l_quantity"], ["l_extendedprice"], ["l_discount"], ["kind"])
    spread = [f"l_quantity_{x}" for x in ("p50", "p90", "p95")]
    return cards.select("l_returnflag", "n_trials", "n_items", *r6("l_quantity_mean"), *spread, F.round("mean_l_extendedprice", 4).alias("mean_l_extendedprice"), *r6("mean_l_discount"), F.col("kind_counts")["large"].alias("large"), F.col("kind_counts")["small"].alias("small"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS moving_mean FROM events")
def moving_averages(spark, d):
    return sel.moving_average(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value", 5).select("event_id", *r6("moving_mean"))


@query("""WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, avg(value) AS m, min(ts) AS f FROM events GROUP BY ALL), p AS (SELECT *, m - lag(m) OVER (PARTITION BY user_id ORDER BY f, day) AS step FROM s)
SELECT user_id, coalesce(bool_and(step < -1e-9) FILTER (step IS NOT NULL), false) AND count(*) >= 2 AS drift, count(*)::BIGINT AS sessions FROM p GROUP BY 1""")
def drift_flags(spark, d):
    return sel.drifting(t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts")), "user_id", "day", "ts", "value")


@query("SELECT user_id, round(var_pop(value), 6) AS variance, var_pop(value) > 1000 AS inconsistent FROM events GROUP BY 1")
def inconsistency(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.round(F.var_pop("value"), 6).alias("variance"), (F.var_pop("value") > 1000).alias("inconsistent"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT - 1 AS session_index FROM events")
def session_index(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("session_index"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_events(spark, d):
    return sel.last_wins(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('s1' || chr(31) || event_id), event_id)::INTEGER AS pick FROM events QUALIFY pick <= 25")
def hash_samples(spark, d):
    return sel.hash_sample(t(spark, d, "events"), ["event_type"], ["event_id"], 25, "s1").select("event_type", "event_id", "pick")


@query("""WITH s AS (SELECT c_mktsegment AS name, count(*) AS size FROM customer GROUP BY 1), e AS (SELECT *, size * 97 / sum(size) OVER () AS x FROM s),
w AS (SELECT *, least(floor(x), size) AS whole, row_number() OVER (ORDER BY x - floor(x) DESC, name) AS nth FROM e), l AS (SELECT *, 97 - sum(whole) OVER () AS rest FROM w)
SELECT name, size::BIGINT AS size, (whole + CASE WHEN nth <= rest AND whole < size THEN 1 ELSE 0 END)::BIGINT AS seats FROM l""")
def seat_allocation(spark, d):
    s = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("size"))
    return sel.largest_remainder(s, "name", "size", 97)


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('h' || chr(31) || c_custkey), c_custkey) AS nth, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment, nth <= least(greatest(round_even(n * 0.2, 0), 1), n - 1) AS held_out FROM r""")
def hold_out_split(spark, d):
    return sel.hold_out(t(spark, d, "customer"), "c_mktsegment", "c_custkey", 0.2, "h").select("c_custkey", "c_mktsegment", "held_out")


@query("WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier) SELECT s_suppkey, s_nationkey, turn::INTEGER AS turn FROM r ORDER BY turn, s_nationkey, s_suppkey LIMIT 40")
def round_robin_pick(spark, d):
    return sel.round_robin(t(spark, d, "supplier"), "s_nationkey", ["s_suppkey"], 40).select("s_suppkey", "s_nationkey", "turn")


@query("""WITH b AS (SELECT event_id, user_id, ts, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INTEGER AS better FROM events),
i AS (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b)
SELECT event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT - 1 AS streak FROM i""")
def streaks(spark, d):
    return sel.losing_streaks(t(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "streak")


@query("""WITH a AS (SELECT p_brand, p_type, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL), b AS (SELECT p.* FROM part p JOIN a USING (p_brand, p_type) WHERE a.n >= 12),
c AS (SELECT p.* FROM part p JOIN a USING (p_brand, p_type) WHERE a.n < 12)
SELECT p_partkey, 0 AS level, '0' || chr(31) || p_brand || chr(31) || p_type AS stratum FROM b UNION ALL SELECT p_partkey, 1, '1' || chr(31) || p_brand FROM c""")
def collapsed_strata(spark, d):
    return sel.collapse(t(spark, d, "part"), [["p_brand", "p_type"], ["p_brand"]], "p_partkey", 12)


@query("SELECT event_id, left(sha256('v1' || chr(31) || event_type || chr(31) || user_id || chr(31) || event_id), 16) AS trial_id, round(('0x' || left(sha256(event_id::VARCHAR), 8))::BIGINT / 4294967295.0::DOUBLE, 9) AS jitter FROM events")
def trial_ids(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", tx.key_hash(F.lit("v1"), F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("trial_id"), F.round(tx.hash_share(F.col("event_id").cast("string")), 9).alias("jitter"))


@query("""SELECT event_id, least(greatest(value / 100, 0), 1) AS clipped, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS squashed, least(greatest((value - 1) / 4, 0), 1) AS rescaled,
round((0.5 * least(value / 100, 1) + CASE WHEN event_type = 'error' THEN 0 ELSE 0.3 * least(value / 50, 1) END) / CASE WHEN event_type = 'error' THEN 0.5 ELSE 0.8 END, 9)::DOUBLE AS composite FROM events""")
def score_columns(spark, d):
    v = F.col("value")
    part = F.when(F.col("event_type") != "error", sc.clip(v / 50))
    return t(spark, d, "events").select("event_id", sc.clip(v / 100).alias("clipped"), F.round(sc.sigmoid((v - 50) / 10), 9).alias("squashed"), sc.rescale(v, 1, 5).alias("rescaled"), F.round(sc.weighted_mean([(sc.clip(v / 100), 0.5), (part, 0.3)]), 9).alias("composite"))


@query(f"""WITH a AS (SELECT conv_id, turn, list_distinct({W.format('text')}) AS w FROM conversations), p AS (SELECT q.conv_id, q.turn, q.w AS x, a.w AS y FROM a q JOIN a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1)
SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(list_distinct(x || y))::DOUBLE, 9) AS jaccard, round(len(list_intersect(x, y)) / len(x)::DOUBLE, 9) AS contained FROM p WHERE len(x) > 0 AND len(y) > 0""")
def turn_overlap(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(tx.words(F.col("text"))).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y"))
    both = c.join(nxt, ["conv_id", "turn"]).where((F.size("w") > 0) & (F.size("y") > 0))
    return both.select("conv_id", "turn", F.round(tx.jaccard(F.col("w"), F.col("y")), 9).alias("jaccard"), F.round(tx.containment(F.col("w"), F.col("y")), 9).alias("contained"))


@query(r"""SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 200) AS snippet, ceil(length(text) / 4.0)::BIGINT AS tokens, strlen(text)::BIGINT AS bytes, length(text) > 5000 AS oversize FROM documents""")
def text_diagnostics(spark, d):
    x = F.col("text")
    return t(spark, d, "documents").select("doc_id", tx.snippet(x).alias("snippet"), tx.token_estimate(x, 4.0).alias("tokens"), F.octet_length(x).cast("long").alias("bytes"), (F.length(x) > 5000).alias("oversize"))


@query(r"""SELECT event_id, nullif(regexp_extract(props, '-?[0-9]+(\.[0-9]+)?', 0), '')::DOUBLE AS number FROM events""")
def first_numbers(spark, d):
    return t(spark, d, "events").select("event_id", tx.first_number(F.col("props")).alias("number"))


@query("SELECT doc_id, source, lang FROM documents WHERE lang IN ('en') AND source IN ('src1', 'src0')")
def scoped_documents(spark, d):
    docs = t(spark, d, "documents").withColumns({"langs": F.array("lang"), "sources": F.array("source")})
    return rt.scoped(docs, {"langs": "en", "sources": ["src1"], "unknown": "x", "text": None}, everyone="src0").select("doc_id", "source", "lang")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def pending_customers(spark, d):
    from .sources.logs import pending

    return pending(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(value) AS highest FROM events GROUP BY 1")
def live_aggregates(spark, d):
    schema = t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if _is_file(spark, d) else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    out = live.run_available(live.live_counts(live.once_each(stream, ["event_id"]), ["event_type"], "value"))
    return out.select("event_type", "n", F.round("total", 4).alias("total"), "highest")


def _is_file(spark, d) -> bool:
    """Whether the events table is one file: a stream reads folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


@query("""WITH m AS (SELECT event_type, user_id, avg(value) AS x FROM events GROUP BY ALL), r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, event_type) AS k FROM m)
SELECT event_type, round(avg(pow(2.0::DOUBLE, 1 - k)), 6) AS win_rate, count(*) FILTER (k = 1)::BIGINT AS firsts FROM r GROUP BY 1""")
def rank_win_rates(spark, d):
    m = st.item_means(t(spark, d, "events"), ["event_type"], "user_id", "value")
    r = m.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("item_mean"), "event_type")))
    return r.groupBy("event_type").agg(F.round(F.avg(F.pow(F.lit(2.0), 1 - F.col("k"))), 6).alias("win_rate"), F.count(F.when(F.col("k") == 1, 1)).alias("firsts"))


@query("""SELECT c.c_mktsegment, o.o_orderpriority, count(*)::BIGINT AS n, round(avg(o.o_totalprice), 4) AS mean, round(quantile_cont(o.o_totalprice, 0.5), 4) AS p50 FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL""")
def slices(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.percentile("o_totalprice", F.lit(0.5)), 4).alias("p50"))


@query("SELECT s_nationkey, count(*)::BIGINT AS n, round(avg(s_acctbal), 6) AS mean, round(stddev_pop(s_acctbal), 6) AS sd FROM supplier GROUP BY 1")
def sample_spread(spark, d):
    return t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean"), F.round(F.stddev_pop("s_acctbal"), 6).alias("sd"))


@query()
def paired_p_values(spark, d):
    return bs.paired_bootstrap(t(spark, d, "events"), "event_type", "user_id", "value")


@query(f"WITH {sql_curve('range(0, 300, 10)')} SELECT threshold, round(recall, 6) AS recall, round(false_answer, 6) AS false_answer, round(false_abstain, 6) AS false_abstain FROM k WHERE false_answer <= 0.3 ORDER BY k.recall DESC, threshold LIMIT 1")
def operating_point(spark, d):
    curve = st.abstention_curve(kinds(spark, d), "value", "kind", [float(x) for x in range(0, 300, 10)])
    return st.operating_point(curve, 0.3).select("threshold", *r6("recall", "false_answer", "false_abstain"))


@query("""WITH o AS (SELECT user_id, event_type AS m, CASE WHEN value > 50 THEN 'a' WHEN value > 20 THEN 'b' END AS w, value FROM events)
SELECT user_id, m, CASE WHEN count(w) = count(*) AND min(w) = max(w) THEN min(w) END AS winner, round(avg(value), 6) AS confidence, count(*)::BIGINT AS orders FROM o GROUP BY ALL""")
def merged_verdicts(spark, d):
    v = F.col("value")
    o = t(spark, d, "events").select("user_id", F.col("event_type").alias("m"), F.when(v > 50, "a").when(v > 20, "b").alias("w"), "value")
    return st.merge_orders(o, ["user_id", "m"], "w", "value").select("user_id", "m", "winner", *r6("confidence"), "orders")


@query("""WITH f AS (SELECT user_id, event_type, arg_max(event_id, value * 1000000 - event_id) % 2 AS pick FROM events GROUP BY ALL)
SELECT x.event_type AS a, y.event_type AS b, count(*)::BIGINT AS n, round(avg((x.pick <> y.pick)::INTEGER), 6) AS disagreement FROM f x JOIN f y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY ALL""")
def choice_disagreement(spark, d):
    f = t(spark, d, "events").groupBy("user_id", "event_type").agg((F.max_by("event_id", F.col("value") * 1000000 - F.col("event_id")) % 2).alias("pick"))
    return st.first_choice_disagreement(f, "event_type", "user_id", "pick").select("a", "b", "n", *r6("disagreement"))


@query(f"""WITH {BM25}, n AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS k FROM bm)
SELECT query_id, round(max(score) FILTER (k = 1) - avg(score) FILTER (k > 1), 6) AS top_to_rest, round(max(score) FILTER (k = 1) - max(score) FILTER (k = 2), 6) AS top_to_second FROM n GROUP BY 1""")
def score_separations(spark, d):
    return st.score_separation(legs(spark, d)[0], "query_id", "score").select("query_id", *r6("top_to_rest", "top_to_second"))


@query("""WITH b AS (SELECT p_brand, avg(p_retailprice) AS x, avg(p_size) AS y FROM part GROUP BY 1)
SELECT count(*)::INTEGER AS pairs, round(avg(((a.x - b.x) * (a.y - b.y) < 0)::INTEGER), 9) AS divergence FROM b a JOIN b ON a.p_brand < b.p_brand""")
def ranking_divergence(spark, d):
    b = t(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("x"), F.avg("p_size").alias("y"))
    return st.discordance(b, "x", "y").select("pairs", F.round("divergence", 9).alias("divergence"))


@query(f"WITH {BM25}, z AS (SELECT unnest([5, 10, 20]) AS size) SELECT size, query_id, count(*)::BIGINT AS pool, round(min(score), 6) AS least FROM bm JOIN z ON rank <= size GROUP BY ALL")
def pool_sweep(spark, d):
    rows = legs(spark, d)[0].select("*", F.explode(F.array(*[F.lit(n) for n in (5, 10, 20)])).alias("size")).where("rank <= size")
    return rows.groupBy("size", "query_id").agg(F.count("*").alias("pool"), F.round(F.min("score"), 6).alias("least"))


@query("""WITH m AS (SELECT unnest(['a', 'b']) AS model), p AS (SELECT unnest(range(0, 3)) AS rep)
SELECT model, p_brand, rep::INTEGER AS rep FROM (SELECT DISTINCT p_brand FROM part), m, p WHERE p_brand || model || rep <> 'Brand#1a0'""")
def planned_trials(spark, d):
    from .sources.logs import pending

    grid = t(spark, d, "part").select("p_brand").distinct().select("p_brand", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rep"))
    done = spark.createDataFrame([("Brand#1", "a", 0)], "p_brand string, model string, rep int")
    return pending(grid, done, ["p_brand", "model", "rep"]).select("model", "p_brand", "rep")


@query("SELECT count(DISTINCT event_type) * count(DISTINCT user_id) AS cells, count(DISTINCT event_type)::BIGINT AS models, count(DISTINCT user_id)::BIGINT AS items FROM events")
def cardinality(spark, d):
    e = t(spark, d, "events").agg(F.count_distinct("event_type").alias("models"), F.count_distinct("user_id").alias("items"))
    return e.select((F.col("models") * F.col("items")).alias("cells"), "models", "items")


@query("""SELECT event_type, sum(n)::BIGINT AS n, round(sum(errors) / sum(n)::DOUBLE, 6) AS error_rate, sum(n) >= 8 AND sum(errors) / sum(n)::DOUBLE > 0.5 AS pause FROM (SELECT event_type, 1 AS n, (value > 60)::INTEGER AS errors FROM events) GROUP BY 1""")
def run_counters(spark, d):
    g = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg((F.col("value") > 60).cast("double")).alias("rate"))
    return g.select("event_type", "n", F.round("rate", 6).alias("error_rate"), ((F.col("n") >= 8) & (F.col("rate") > 0.5)).alias("pause"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_totals(spark, d):
    e = t(spark, d, "events")
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS orders, coalesce(round(sum(o_totalprice), 4), 0)::DOUBLE AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def joined_totals(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce(F.round("spent", 4), F.lit(0.0)).alias("spent"))


@query("""SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))::BIGINT AS orphans, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'))::BIGINT AS lost_lines""")
def integrity(spark, d):
    o, c, li = t(spark, d, "orders"), t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), t(spark, d, "lineitem")
    a = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))
    return a.crossJoin(li.join(o.where("o_orderstatus <> 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("lost_lines")))  # two single rows


@query("SELECT event_id, user_id, round(value, 4) AS value FROM events WHERE event_type = 'error' AND value > 50 ORDER BY events.value DESC, event_id LIMIT 12")
def worst_failures(spark, d):
    e = t(spark, d, "events").where("event_type = 'error' AND value > 50")
    return e.orderBy(F.desc("value"), "event_id").limit(12).select("event_id", "user_id", F.round("value", 4).alias("value"))
