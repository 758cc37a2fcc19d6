"""Queries of calibration, similarity, live state and published versions, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import answers as an
from .functions import markup as mk
from .functions import ranking as rk
from .functions import scores as sc
from .functions import text as tx
from .operators import calibration as cal
from .operators import planning as pl
from .operators import retrieval as rt
from .operators import statistics as st
from .operators import similarity as sim
from .queries import BM25, OVERLAP, VC, legs, query, r6, t
from .shared import scratch, written
from .sources import corpus, logs, published
from .streaming import keyed, live

#: Newton steps that the SQL takes for a calibration; beyond about ten nothing moves.
NEWTON = 14


@query(f"""WITH RECURSIVE r AS (SELECT lang AS g, ln(greatest(n_chars, 1)) AS x, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
s AS (SELECT g, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd, min(y) <> max(y) AND min(x) < max(x) AS fits FROM r GROUP BY g),
l AS (SELECT g, list(struct_pack(z := (x - mean) / sd, y := y)) AS rows_ FROM r JOIN s USING (g) WHERE fits GROUP BY g),
f(g, i, a, b) AS (SELECT g, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM l UNION ALL
  SELECT g, i + 1, a - da / greatest(abs(da), abs(db), 4) * 4, b - db / greatest(abs(da), abs(db), 4) * 4 FROM (
    SELECT g, i, a, b, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM (
      SELECT g, i, a, b, list_sum(list_transform(q, lambda r: (r.p - r.y) * r.z)) AS ga, list_sum(list_transform(q, lambda r: r.p - r.y)) AS gb, list_sum(list_transform(q, lambda r: r.p * (1 - r.p) * r.z * r.z)) AS haa,
        list_sum(list_transform(q, lambda r: r.p * (1 - r.p) * r.z)) AS hab, list_sum(list_transform(q, lambda r: r.p * (1 - r.p))) AS hbb FROM (
        SELECT g, i, a, b, list_transform(rows_, lambda r: struct_pack(z := r.z, y := r.y, p := 1 / (1 + exp(-(a * r.z + b))))) AS q FROM f JOIN l USING (g) WHERE i < {NEWTON}))))
SELECT g AS lang, n::BIGINT AS n, round(CASE WHEN fits THEN a / sd ELSE 1 END, 6)::DOUBLE AS slope, round(CASE WHEN fits THEN b - a / sd * mean ELSE 0 END, 6)::DOUBLE AS intercept FROM s LEFT JOIN (FROM f WHERE i = {NEWTON}) k USING (g)""")
def platt_curves(spark, d):
    scored = t(spark, d, "documents").select("doc_id", "lang", F.log(F.greatest("n_chars", F.lit(1))).alias("score")).join(t(spark, d, "labels"), "doc_id")
    return cal.platt(scored, ["lang"], "score", "quality").select("lang", "n", *r6("slope", "intercept"))


@query("""WITH s AS (SELECT DISTINCT list_sort(list_distinct(list_concat(string_split(lower(p_brand || ' ' || p_type || ' ' || p_name), ' '), ['size' || p_size // 5]))) AS k, min(p_partkey) OVER (PARTITION BY list_sort(list_distinct(list_concat(string_split(lower(p_brand || ' ' || p_type || ' ' || p_name), ' '), ['size' || p_size // 5])))) AS id FROM part),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.k, b.k)) AS i, len(a.k) + len(b.k) AS n FROM s a JOIN s b ON a.id < b.id)
SELECT a, b, round(i / (n - i)::DOUBLE, 6) AS jaccard FROM p WHERE i / (n - i)::DOUBLE >= 0.6 - 1e-12""")
def similar_parts(spark, d):
    whole = F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name"))
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.split(whole, " "), F.array(F.concat(F.lit("size"), F.floor(F.col("p_size") / 5).cast("string")))).alias("tokens"))
    edges, _ = sim.similarity_edges(rows, "p_partkey", "tokens", 0.6)
    return edges.select("a", "b", *r6("jaccard"))


@query("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS changed, o_totalprice > 150000 AS dear FROM orders),
e AS (SELECT * FROM o WHERE changed < '1998-01-01'), s AS (SELECT (SELECT count(*) FROM e) AS early, (SELECT max(changed) FROM e) AS early_mark, (SELECT count(*) FROM o) AS every, (SELECT max(changed) FROM o) AS mark, (SELECT count(*) FROM o WHERE dear) AS dear)
SELECT 1 AS step, 'promoted' AS status, early::BIGINT AS indexed, 0::BIGINT AS skipped, early::BIGINT AS live_rows, early_mark AS live_mark FROM s
UNION ALL SELECT 2, 'unchanged', 0, 0, early, early_mark FROM s UNION ALL SELECT 3, 'kept', every - dear, dear, early, early_mark FROM s
UNION ALL SELECT 4, 'empty', 0, 0, early, early_mark FROM s UNION ALL SELECT 5, 'kept', every, 0, early, early_mark FROM s UNION ALL SELECT 6, 'promoted', every, 0, every, mark FROM s""")
def published_orders(spark, d):
    """An index of orders rebuilt six times: promoted, unchanged, held back by skipped rows, empty, short of what was expected, promoted."""
    root = f"{scratch(spark)}/published-{uuid.uuid4().hex}"
    orders = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("changed"), (F.col("o_totalprice") > 150000).alias("dear"))
    early, plain = orders.where("changed < '1998-01-01'"), lambda rows: rows.withColumn("skip_reason", F.lit(None).cast("string"))
    picky = lambda rows: rows.withColumn("skip_reason", F.when(F.col("dear"), "too dear"))
    steps = [(early, plain, None), (early, plain, None), (orders, picky, None), (orders.where(F.lit(False)), plain, None), (orders, plain, 10**12), (orders, plain, None)]
    told = []
    for i, (rows, index, expected) in enumerate(steps, 1):
        done = published.rebuild(rows, root, "changed", index, expected)
        now = published.pointer(spark, root)
        told.append((i, done.status, done.indexed, done.skipped, published.live(spark, root).count(), now["mark"]))
    return spark.createDataFrame(told, "step int, status string, indexed long, skipped long, live_rows long, live_mark string")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 DESC, ts DESC, event_id DESC) AS nth FROM events)
SELECT user_id, event_type, event_id, value FROM l WHERE nth = 1""")
def upserted_events(spark, d):
    """Each user's and type's event after three batches, one of them handed over twice with other rows, and a compaction."""
    root = f"{scratch(spark)}/keyed-{uuid.uuid4().hex}"
    rows = t(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    key, sink = ["user_id", "event_type"], keyed.upsert_sink(root, ["user_id", "event_type"], ["ts", "event_id"])
    for n in (0, 1):
        sink(rows.where(F.col("event_id") % 3 == n), n)
    sink(rows.withColumn("value", F.lit(-1.0)), 1)  # it has been in already
    keyed.compact(spark, root, key, rows.schema)
    sink(rows.withColumn("value", F.lit(-1.0)), 0)
    sink(rows.where(F.col("event_id") % 3 == 2), 2)
    return keyed.current(spark, root, key, rows.schema).select("user_id", "event_type", "event_id", "value")


@query("""WITH plan AS (SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events))
SELECT p.* FROM plan p ANTI JOIN (SELECT user_id, event_type FROM events WHERE value <= 10) e USING (user_id, event_type)""")
def unfinished_trials(spark, d):
    e = t(spark, d, "events")
    types = e.select("event_type").distinct().agg(F.collect_list("event_type").alias("types"))  # a handful of types
    planned = e.select("user_id").distinct().crossJoin(F.broadcast(types)).select("user_id", F.explode("types").alias("event_type"))
    return keyed.unfinished(planned, e, ["user_id", "event_type"], F.col("value") > 10)


@query(f"""WITH e2 AS (SELECT * FROM events WHERE value IS NOT NULL), {VC.replace('FROM events WHERE value IS NOT NULL', 'FROM e2')}, h AS (SELECT *, 1.959963984540054 * sqrt(between_ / n_items + within / n_trials) AS half FROM vc)
SELECT event_type, n_items::BIGINT AS n_items, n_trials::BIGINT AS n_trials, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high, n_items < 2 AS insufficient, false AS blended FROM h""")
def live_intervals(spark, d):
    """Intervals after the events have come in as three micro-batches, each when it is there."""
    root = f"{scratch(spark)}/live-{uuid.uuid4().hex}"
    e = t(spark, d, "events").select("event_type", "user_id", "value", F.lit("full").alias("kind"), (F.col("event_id") % 3).alias("part"))
    for n in range(3):
        e.where(F.col("part") == n).drop("part").write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(e.drop("part").schema).parquet(f"{root}/log")
        out = live.live_intervals(stream, ["event_type"], "kind", "user_id", "value", f"{root}/state")
    return out.select("event_type", "n_items", "n_trials", *r6("mean", "low", "high"), "insufficient", "blended")


#: Documents as markdown: a heading, a list of two items, a paragraph with bold words and a link.
MARKDOWN = "'# Number ' || doc_id || chr(10) || '- first **' || lang || '** item' || chr(10) || '- second' || chr(10) || chr(10) || 'From [' || source || '](http://x.org/' || doc_id || ') with ' || coalesce(n_chars, 0) || ' characters' || chr(10) || 'in all'"


def markdown(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", "source", F.expr(MARKDOWN.replace("chr(10)", "'\\n'")).alias("text"))


@query("""SELECT doc_id, 3::INTEGER AS n_blocks, 'h1,ul,p' AS kinds, 'Number ' || doc_id || ' first ' || lang || ' item second From ' || source || ' (http://x.org/' || doc_id || ') with ' || coalesce(n_chars, 0) || ' characters in all' AS plain, true AS same FROM documents""")
def markdown_blocks(spark, d):
    """Blocks of every document's card, their text, and whether writing them and reading them again gives the same blocks."""
    rows = written(markdown(spark, d).withColumn("b", mk.blocks(F.col("text"))), "blocks")
    rows = written(rows.withColumn("out", mk.markdown_of(F.col("b"))), "markdown")
    again = mk.blocks(F.col("out"))
    return rows.select("doc_id", F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda x: x["kind"]), ",").alias("kinds"), mk.plain_text(F.col("b")).alias("plain"), (again == F.col("b")).alias("same"))


@query(f"""WITH {BM25}, {OVERLAP} SELECT query_id, doc_id, 'lexical' AS arm, rank::INTEGER AS arm_rank FROM bm UNION ALL SELECT query_id, doc_id, 'overlap', rank::INTEGER FROM ov""")
def candidate_arms(spark, d):
    lexical, overlap = legs(spark, d)
    return rt.arms({"lexical": lexical, "overlap": overlap})


@query("""SELECT p_partkey, p_type || '|' || p_brand AS piped, [p_brand, p_type] AS tags, lower(p_name) AS title, round(1 / (1 + exp(-(p_retailprice - 950) / 50)), 9) AS logit, least(p_size / 40.0, 1)::DOUBLE AS unit, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE p_retailprice END AS finite FROM part""")
def field_texts(spark, d):
    rows = t(spark, d, "part")
    listed = F.concat("p_type", F.lit(" , ,"), "p_brand", F.lit(","))
    tags = F.concat(F.lit(" "), "p_brand", F.lit(",n/a,"), "p_type", F.lit(", ,"), "p_brand")
    title = F.concat("p_name", F.lit(" - North"), F.lit(" (new)"))
    odd = F.when(F.col("p_size") % 14 == 0, float("nan")).when(F.col("p_size") % 7 == 0, float("inf")).otherwise(F.col("p_retailprice"))
    return rows.select(
        "p_partkey", corpus.piped(listed).alias("piped"), tx.split_tags(tags, blanks=("n/a",)).alias("tags"), tx.plain_title(title).alias("title"),
        F.round(an.squash((F.col("p_retailprice") - 950) / 50, "logit"), 9).alias("logit"), an.squash(F.col("p_size") / 40, "unit").alias("unit"), sc.finite(odd).alias("finite"))


@query("""SELECT p_partkey, p_brand AS title, CASE WHEN p_size % 2 = 0 THEN 'second' ELSE p_type END AS scope, 'part' AS content_type, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END::INTEGER AS n FROM part""")
def metadata_maps(spark, d):
    """Fields without the body, overwritten by the latest keys of each name, with the content type."""
    rows = t(spark, d, "part")
    fields = F.create_map(F.lit("title"), F.col("p_brand"), F.lit("scope"), F.col("p_type"), F.lit("body"), F.col("p_name"))
    keys = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("scope-2"), F.lit("second"), F.lit("scope-10"), F.lit("tenth"), F.lit("scope"), F.lit("first"), F.lit("note-1"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    keys = F.when(F.col("p_size") % 2 == 0, F.map_filter(keys, lambda k, v: k != "scope-10")).otherwise(keys)
    m = an.assembled(fields, corpus.latest_keys(keys), ["body"], F.lit("part"))
    return rows.select("p_partkey", m["title"].alias("title"), m["scope"].alias("scope"), m["content_type"].alias("content_type"), F.size(m).alias("n"))


@query("SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 3 > 0 THEN props END AS props FROM events")
def logged_events(spark, d):
    """Events as lines of a log, nulls and blank lines among them, read back."""
    path = f"{scratch(spark)}/lines-{uuid.uuid4().hex}"
    rows = t(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("props"))
    logs.as_lines(rows).select(F.concat("value", F.when(F.monotonically_increasing_id() % 5 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    return logs.read_log(spark, path, "event_id long, user_id long, event_type string, value double, props string")


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def written_reports(spark, d):
    """A report as one sorted text, read back."""
    path = f"{scratch(spark)}/report-{uuid.uuid4().hex}"
    logs.write_report(t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")), path)
    return spark.read.schema("mean double, n long, o_orderpriority string").json(path).select("o_orderpriority", "n", "mean")


@query("SELECT c_custkey, [c_mktsegment, 'n' || c_nationkey] AS tags, CASE WHEN c_acctbal > 0 THEN c_name END AS content FROM customer WHERE c_custkey % 11 > 0")
def delimited_corpus(spark, d):
    """Customers as a tab-separated index with blank ids and cells, and as a file with lists in cells, read back and joined."""
    base = f"{scratch(spark)}/delimited-{uuid.uuid4().hex}"
    rows = t(spark, d, "customer")
    rows.select("c_custkey", F.concat("c_mktsegment", F.lit("| |n"), F.col("c_nationkey").cast("string")).alias("tags")).write.csv(f"{base}/tags", header=True)
    rows.select(F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey").cast("string")).otherwise(" ").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("content")).write.csv(f"{base}/index", header=True, sep="\t", quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    tags = corpus.read_delimited(spark, f"{base}/tags", "c_custkey long, tags string", ["tags"])
    index = corpus.read_index(spark, f"{base}/index", "id string, content string", "id", ["content"])
    return tags.join(index, F.col("c_custkey") == F.col("id").cast("long")).select("c_custkey", "tags", "content")


@query("""WITH l AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS r, coalesce(list(event_id ORDER BY ts, event_id) FILTER (event_type = 'purchase' AND value > 60), []) AS g FROM events GROUP BY 1)
SELECT user_id, CASE WHEN len(g) > 0 THEN round(len(list_intersect(r[1:5], g)) / len(g)::DOUBLE, 6) END AS recall_5, len(g) = 0 AS unavailable FROM l""")
def metrics_or_none(spark, d):
    e = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    g = F.array_sort(F.collect_list(F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.struct("ts", "event_id"))))
    ids = lambda c: F.transform(c, lambda x: x["event_id"])
    rows = t(spark, d, "events").groupBy("user_id").agg(ids(e).alias("r"), ids(g).alias("g"))
    value = rk.unavailable_if_no_gold(rk.recall_at_k(F.col("r"), F.col("g"), 5), F.col("g"))
    return rows.select("user_id", F.round(value, 6).alias("recall_5"), value.isNull().alias("unavailable"))


@query("""WITH k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part), few AS (SELECT * FROM k WHERE nth <= 2),
demo AS (SELECT p_partkey, p_brand FROM k WHERE nth <= 3 ORDER BY nth, p_brand, p_partkey LIMIT 12), x AS (SELECT 'flat' AS plan, 'wide' AS pass, 2 AS reps, p_partkey, p_brand FROM k UNION ALL SELECT 'pilot', 'pilot', 3, p_partkey, p_brand FROM few
UNION ALL SELECT 'demo', 'wide', 2, p_partkey, p_brand FROM demo UNION ALL SELECT 'demo', 'deep', 3, p_partkey, p_brand FROM demo)
SELECT plan, pass, p_brand, p_partkey, model, unnest(range(reps))::BIGINT AS rep FROM x, (SELECT unnest(['m1', 'm2']) AS model)""")
def planned_passes(spark, d):
    """Trials of a flat, a pilot and a demo plan over the parts, by brand."""
    items = t(spark, d, "part").select("p_partkey", "p_brand")
    plans = {"flat": pl.flat_plan(items, 2), "pilot": pl.pilot_plan(items, "p_brand", ["p_partkey"], 2, 3), "demo": pl.demo_plan(items, "p_brand", ["p_partkey"], 3, 12)}
    out = None
    for name, plan in plans.items():
        one = pl.trials(plan, ["m1", "m2"]).select(F.lit(name).alias("plan"), "pass", "p_brand", "p_partkey", "model", "rep")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {VC}, i AS (SELECT DISTINCT event_type, user_id FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS nth FROM i),
n AS (SELECT 'wide' AS pass, event_type, count(*) AS n FROM i GROUP BY ALL UNION ALL SELECT 'deep', event_type, count(*) FROM k WHERE nth <= 20 GROUP BY ALL),
q AS (SELECT pass, event_type, n, within, 64.0::DOUBLE / (1.96 * 1.96) - between_ / n AS room FROM n JOIN vc USING (event_type)), r AS (SELECT pass, event_type, n, least(greatest(coalesce(CASE WHEN room > 0 THEN ceil(within / (n * room)) END, 50), 2), 50)::BIGINT AS needed FROM q),
z AS (SELECT *, sum(needed * n) OVER (PARTITION BY pass) AS trials FROM r), sz AS (SELECT pass, event_type, CASE WHEN trials > 2000 THEN greatest(floor(needed * 2000.0::DOUBLE / trials), 2)::BIGINT ELSE needed END AS reps FROM z)
SELECT event_type, user_id, pass, reps FROM i JOIN sz USING (event_type) WHERE pass = 'wide' UNION ALL SELECT event_type, user_id, pass, reps FROM k JOIN sz USING (event_type) WHERE pass = 'deep' AND nth <= 20""")
def sized_passes(spark, d):
    """The wide and the deep pass of a plan sized from the events' variances."""
    e = t(spark, d, "events")
    items = e.select("event_type", "user_id").distinct()
    parts = st.variance_components(e, ["event_type"], "user_id", "value")
    return pl.full_plan(items, "event_type", ["user_id"], 20, parts, 8.0, 2000).select("event_type", "user_id", "pass", "reps")
