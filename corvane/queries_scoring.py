"""Queries of the scores of answers and of retrieval, with SQL. Conversations stand for answered questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import answers as an
from .functions import ranking as rk
from .functions import scores as sc
from .functions import text as tx
from .operators import reports as rp
from .operators import retrieval as rt
from .operators import statistics as st
from .queries import W, query, questions, r6, ranked_lists, t

#: Phrases and stop words of the synthetic texts, as parameters of the queries.
REFUSAL, GAP, STOP = ["la de", "the on"], ["que", "ion"], ["la", "de", "the", "le", "des"]


def sql_words(text: str) -> str:
    return W.format(text)


def sql_content(text: str) -> str:
    return f"list_distinct(list_filter({sql_words(text)}, lambda w: w NOT IN ({', '.join(repr(s) for s in STOP)})))"


TURNS = """q AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS prev, u.turn AS prev_turn, s.text AS first FROM conversations a
JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 JOIN conversations s ON s.conv_id = a.conv_id AND s.turn = 0 WHERE a.role = 'assistant')"""


def turns(spark, d):
    """Assistant turns with the text before them and the first of the conversation."""
    c = t(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"), (F.col("turn") - 1).alias("prev_turn"))
    u = c.select("conv_id", F.col("turn").alias("prev_turn"), F.col("text").alias("prev"))
    return a.join(u, ["conv_id", "prev_turn"]).join(c.where("turn = 0").select("conv_id", F.col("text").alias("first")), "conv_id")


@query("""WITH p AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE least(value / 100, 1) END AS speed, least(value / 50, 1) AS quality,
CASE WHEN event_type = 'error' THEN NULL ELSE 0.5 END AS tone, CASE WHEN event_type = 'click' THEN 0.25 END AS style FROM events)
SELECT event_id, round((coalesce(0.5 * speed, 0) + 0.3 * quality + coalesce(0.1 * tone, 0) + coalesce(0.1 * style, 0)) /
(CASE WHEN speed IS NULL THEN 0 ELSE 0.5 END + 0.3 + CASE WHEN tone IS NULL THEN 0 ELSE 0.1 END + CASE WHEN style IS NULL THEN 0 ELSE 0.1 END), 9)::DOUBLE AS composite,
round(coalesce(speed, 0), 9)::DOUBLE AS speed_only FROM p""")
def composite_scores(spark, d):
    v, kind = F.col("value"), F.col("event_type")
    parts = {"latency": F.when(kind != "view", sc.clip(v / 100)), "quality": sc.clip(v / 50), "tone": F.when(kind != "error", F.lit(0.5)), "style": F.when(kind == "click", F.lit(0.25))}
    whole = an.composite(parts, {"speed": 0.5, "quality": 0.3}, {"latency": "speed"}, 0.2)
    return t(spark, d, "events").select("event_id", F.round(whole, 9).alias("composite"), F.round(an.composite_or_zero([(parts["latency"], 0.5)]), 9).alias("speed_only"))


@query("""SELECT event_id, round(CASE WHEN event_type = 'signup' THEN (value > 50)::INTEGER ELSE CASE WHEN event_type = 'view' THEN least(value / 100, 1)
ELSE 0.35 * least(value / 100, 1) + 0.65 * least(value / 200, 1) END END, 9)::DOUBLE AS closeness,
round(CASE WHEN event_type = 'click' THEN value WHEN event_type = 'view' THEN value * 2 ELSE value + 1 END, 9)::DOUBLE AS total,
round(coalesce(least(greatest((try_cast(nullif(regexp_extract(props, '[0-9]', 0), '') AS DOUBLE) - 1) / 4, 0), 1), 0.5), 9)::DOUBLE AS rating,
round(value - 50, 9)::DOUBLE AS gain, CASE WHEN event_id % 3 = 0 THEN 'inf' ELSE round(100 * (value - 20) / 20, 6)::VARCHAR END::DOUBLE AS percent, greatest(value, 1)::DOUBLE AS axis FROM events""")
def answer_scores(spark, d):
    v, kind = F.col("value"), F.col("event_type")
    close = an.closeness(F.when(kind == "signup", v > 50), v / 100, F.when(kind != "view", v / 200))
    total = an.merged_total(F.when(kind == "click", v), F.when(kind == "view", v * 2), [v, F.lit(1.0), F.lit(None).cast("double")])
    rating = an.rating_share(F.nullif(F.regexp_extract("props", "[0-9]", 0), F.lit("")))
    return t(spark, d, "events").select("event_id", sc.rounded(close, 9).alias("closeness"), sc.rounded(total, 9).alias("total"), sc.rounded(rating, 9).alias("rating"), sc.rounded(an.gain(F.lit(50.0), v)[0], 9).alias("gain"), sc.rounded(an.gain(F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(20.0), v)[1], 6).alias("percent"), an.log_safe(v).alias("axis"))


SENTENCES = f"list_filter(list_transform(regexp_split_to_array(answer, '[.!?\\n]+'), lambda s: {sql_content('s')}), lambda s: len(s) > 0)"


@query(f"""WITH {TURNS}, c AS (SELECT conv_id, turn, prev_turn, prev, first, answer || CASE WHEN turn % 4 = 1 AND conv_id % 3 = 0 THEN ' as [1] says' WHEN turn % 4 = 3 AND conv_id % 2 = 0 THEN ' see turn-0' ELSE '' END AS answer FROM q),
f AS (SELECT conv_id, turn, {SENTENCES} AS ss, ['turn-' || prev_turn, 'turn-0'] AS ids, [{sql_content('prev')}, {sql_content('first')}] AS ws, answer FROM c),
g AS (SELECT *, list_distinct(list_concat(list_filter(ids, lambda i: contains(answer, i)), list_filter([CASE WHEN contains(answer, '[1]') THEN ids[1] END, CASE WHEN contains(answer, '[2]') THEN ids[2] END], lambda i: i IS NOT NULL))) AS cited FROM f),
u AS (SELECT *, list_distinct(CASE WHEN len(cited) > 0 THEN cited ELSE list_transform(list_filter([1, 2], lambda i: len(list_filter(ss, lambda s: len(list_intersect(s, ws[i])) >= 2 AND len(list_intersect(s, ws[i])) >= 0.5 * len(s))) > 0), lambda i: ids[i]) END) AS used FROM g)
SELECT conv_id, turn, len(cited) > 0 AS cites, len(used)::INTEGER AS n_used, coalesce(len(list_filter(used, lambda x: x = ids[1])) / nullif(len(used), 0), 0)::DOUBLE AS precision, len(list_filter(used, lambda x: x = ids[1]))::DOUBLE AS recall FROM u""")
def grounded_answers(spark, d):
    ids = F.array(F.concat(F.lit("turn-"), F.col("prev_turn").cast("string")), F.lit("turn-0"))
    added = F.when((F.col("turn") % 4 == 1) & (F.col("conv_id") % 3 == 0), " as [1] says").when((F.col("turn") % 4 == 3) & (F.col("conv_id") % 2 == 0), " see turn-0").otherwise("")
    rows = turns(spark, d).withColumn("ids", ids).withColumn("answer", F.concat("answer", added))
    rows = rows.withColumn("used", F.array_distinct(an.used_fragments(F.col("answer"), F.col("ids"), F.array("prev", "first"), STOP)))
    precision, recall = an.grounding(F.col("used"), F.slice("ids", 1, 1), F.col("ids"))
    return rows.select("conv_id", "turn", (F.size(tx.cited_places(F.col("answer"), F.col("ids"))) > 0).alias("cites"), F.size("used").alias("n_used"), precision.alias("precision"), recall.alias("recall"))


EVEN = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"
REFUSED = f"({EVEN} = '' OR contains({EVEN}, '{REFUSAL[0]}') OR contains({EVEN}, '{REFUSAL[1]}'))"


@query(f"""WITH a AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'full' END AS kind, {REFUSED} AS refused,
(contains({EVEN}, '{GAP[0]}') OR contains({EVEN}, '{GAP[1]}')) AS flagged, len(list_filter(string_split(replace(replace({EVEN}, '{REFUSAL[0]}', ' '), '{REFUSAL[1]}', ' '), ' '), lambda w: w <> '')) >= 4 AS answered FROM conversations)
SELECT conv_id, turn, kind, CASE kind WHEN 'none' THEN refused::INTEGER WHEN 'partial' THEN (answered AND flagged)::INTEGER END AS abstention_correct, CASE WHEN kind = 'full' THEN refused::INTEGER END AS unwarranted_refusal,
CASE WHEN kind = 'none' THEN 'abstention' WHEN turn <= 1 THEN 'gold' ELSE 'wants' END AS reference FROM a""")
def answerability_scores(spark, d):
    x = F.col("text")
    kind = F.when(F.col("conv_id") % 3 == 0, "none").when(F.col("conv_id") % 3 == 1, "partial").otherwise("full")
    right, bad = an.answerability(kind, an.refuses(x, REFUSAL), tx.any_phrase(x, GAP), an.substantive(x, REFUSAL))
    return t(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), right.alias("abstention_correct"), bad.alias("unwarranted_refusal"), an.reference_kind(F.col("turn"), kind).alias("reference"))


@query(f"""WITH {TURNS}, n AS (SELECT q.*, x.text AS next FROM q LEFT JOIN conversations x ON x.conv_id = q.conv_id AND x.turn = q.turn + 1),
c AS (SELECT conv_id, turn, {sql_content('next')} AS ref, {sql_content('answer')} AS said, {sql_content('prev')} AS p, {sql_content('first')} AS f, trim(prev) <> '' AS full_ FROM n)
SELECT conv_id, turn, CASE WHEN len(ref) > 0 THEN round_even(((len(list_intersect(p, ref)) > 0)::INTEGER + (len(list_intersect(f, ref)) > 0)::INTEGER) / 3.0, 4) END::DOUBLE AS context_precision,
CASE WHEN len(ref) > 0 THEN round_even(len(list_intersect(ref, list_concat(p, f))) / len(ref)::DOUBLE, 4) END AS context_recall,
CASE WHEN len(said) = 0 THEN 1 ELSE round_even(len(list_intersect(said, list_concat(p, f))) / len(said)::DOUBLE, 4) END::DOUBLE AS faithfulness,
CASE WHEN len(ref) > 0 THEN round_even(len(list_intersect(ref, said)) / len(ref)::DOUBLE, 4) END AS factual,
((len(p) > 0 AND len(said) > 0 AND len(list_intersect(p, said)) >= 0.4 * len(p))::INTEGER + (len(f) > 0 AND len(said) > 0 AND len(list_intersect(f, said)) >= 0.4 * len(f))::INTEGER) / 2.0::DOUBLE AS grounded FROM c""")
def coverage_scores(spark, d):
    """Answers against the turn after them as the reference (none for the last), with two texts and a blank one."""
    after = t(spark, d, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    rows = turns(spark, d).join(after, ["conv_id", "turn"], "left")
    texts, said, ref = F.array("prev", "first", F.lit(" ")), F.col("answer"), F.col("next")
    p, r = an.coverage(ref, texts, STOP)
    faithful, factual = an.cross_checks(said, ref, texts, STOP)
    return rows.select("conv_id", "turn", p.alias("context_precision"), r.alias("context_recall"), faithful.alias("faithfulness"), factual.alias("factual"), an.grounded_fraction(texts, said, STOP).alias("grounded"))


@query(f"""WITH w AS (SELECT item_id, {sql_words('text')} AS w, lower(text) AS low FROM benchmark)
SELECT item_id, len(w)::INTEGER AS n_words, len(list_distinct(list_filter(w, lambda x: x NOT IN ({', '.join(repr(s) for s in STOP)}))))::INTEGER AS n_content,
list_transform(range(0, 32), lambda s: len(list_filter(w, lambda x: ('0x' || left(sha256(x), 2))::INTEGER % 32 = s))::INTEGER) AS bag, left(low, 40) AS start FROM w""")
def word_bags(spark, d):
    x = F.col("text")
    return t(spark, d, "benchmark").select("item_id", F.size(tx.words(x)).alias("n_words"), F.size(tx.content_words(x, STOP)).alias("n_content"), an.bag_of_words(x).alias("bag"), F.left(F.lower(x), F.lit(40)).alias("start"))


@query(r"""SELECT event_id, 'u' || user_id || ' | ' || event_type || ' |' AS card, 'u' || user_id AS name, event_type AS kind, 'unknown' AS mood, regexp_replace('m-' || event_type || CASE WHEN value > 50 THEN '-fast' ELSE '' END, '(-fast|-slow)$', '') AS stem,
props AS object, regexp_replace(event_type || ' by user ' || user_id, 'user [0-9]+', '[author]', 'g') AS redacted, (props::JSON ->> 'k')::INTEGER AS k FROM events""")
def text_fields(spark, d):
    card = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(" | "), "event_type", F.lit(" |"))
    stem = an.variant_stem(F.concat(F.lit("m-"), "event_type", F.when(F.col("value") > 50, "-fast").otherwise("")), ["-fast", "-slow"])
    found = an.last_object(F.concat(F.lit("it says {} then "), "props"))
    said = F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string"))
    return t(spark, d, "events").select("event_id", card.alias("card"), *an.persona(card, ["name", "kind", "mood"]), stem.alias("stem"), found.alias("object"), an.redact(said, ["user [0-9]+"]).alias("redacted"), F.from_json(found, "k int")["k"].alias("k"))


@query("""WITH g AS (SELECT l_orderkey, list(struct_pack(p_name, p_type) ORDER BY l_linenumber, p_partkey) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, array_to_string(list_concat(['order ' || l_orderkey], list_transform(parts, lambda p: CASE WHEN p.p_type = 'ECONOMY' THEN p.p_type ELSE p.p_name END)), chr(10) || chr(10)) AS ideal,
list_distinct(list_transform(parts, lambda p: p.p_type)).len()::INTEGER AS n_tags FROM g""")
def ideal_texts(spark, d):
    one = F.struct(F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).alias("markdown"), F.lit(" ").alias("snippet"), F.col("p_name").alias("title"))
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", one.alias("g"), "p_type"))).alias("s"))  # an order's lines are few
    many, _ = an.scope_tags(F.transform("s", lambda x: x["p_type"]), F.lit(None).cast("string"))
    return rows.select("l_orderkey", an.ideal_text(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), F.transform("s", lambda x: x["g"])).alias("ideal"), F.size(many).alias("n_tags"))


@query("""WITH l AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ranked, list(event_id ORDER BY ts, event_id) FILTER (event_type = 'purchase' AND value > 20) AS g FROM events GROUP BY 1),
h AS (SELECT user_id, list_transform(ranked, lambda x: list_contains(coalesce(g, []), x)::INTEGER) AS hit, len(coalesce(g, [])) AS ng FROM l)
SELECT user_id, CASE WHEN ng = 0 THEN 0.0 ELSE list_sum(hit[1:3]) / ng::DOUBLE END::DOUBLE AS retrievable_recall, CASE WHEN list_sum(hit[1:3]) > 0 THEN round(1.0 / list_position(hit, 1), 6) ELSE 0.0 END::DOUBLE AS mrr_3 FROM h""")
def retrievable_metrics(spark, d):
    r, g = F.col("ranked"), F.col("gold")
    return ranked_lists(spark, d).select("user_id", rk.retrievable_recall_at_k(r, g, 3).alias("retrievable_recall"), F.round(rk.reciprocal_rank_at_k(r, g, 3), 6).alias("mrr_3"))


@query("""WITH p AS (SELECT user_id, event_type = 'purchase' AS gold, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth FROM events)
SELECT user_id, coalesce(min(nth) FILTER (gold) = 1, false) AS top_1, round(1.0 / coalesce(min(nth) FILTER (gold), count(*) + 1), 9)::DOUBLE AS rr, count(*)::BIGINT AS n FROM p GROUP BY 1""")
def pool_accuracy(spark, d):
    rows = t(spark, d, "events").withColumn("gold", F.col("event_type") == "purchase")
    return rp.pool_ranks(rows, "user_id", "value", "event_id", "gold").select("user_id", "top_1", F.round("rr", 9).alias("rr"), "n")


@query("""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS nth FROM events),
g AS (SELECT user_id, max(value) FILTER (nth = 1) - avg(value) FILTER (nth > 1) AS a, max(value) FILTER (nth = 1) - max(value) FILTER (nth = 2) AS b FROM s GROUP BY 1)
SELECT round(median(a), 6) AS median_to_rest, round(median(b), 6) AS median_to_second, count(*)::BIGINT AS pools FROM g""")
def median_separation(spark, d):
    s = st.score_separation(t(spark, d, "events"), "user_id", "value")
    return s.agg(F.round(F.percentile("top_to_rest", F.lit(0.5)), 6).alias("median_to_rest"), F.round(F.percentile("top_to_second", F.lit(0.5)), 6).alias("median_to_second"), F.count("*").alias("pools"))


@query("""WITH c AS (SELECT event_type, user_id, arg_max(event_id % 3, value) AS choice FROM events GROUP BY ALL)
SELECT o.event_type, count(*)::BIGINT AS n, round(avg((o.choice = r.choice)::INTEGER), 9) AS agreement FROM c o JOIN c r ON o.user_id = r.user_id AND r.event_type = 'click' WHERE o.event_type <> 'click' GROUP BY 1""")
def agreement_with_reference(spark, d):
    c = t(spark, d, "events").groupBy("event_type", "user_id").agg(F.max_by(F.col("event_id") % 3, "value").alias("choice"))
    return rp.reference_agreement(c, "event_type", "user_id", "choice", "click").select("event_type", "n", F.round("agreement", 9).alias("agreement"))


@query("""WITH p AS (SELECT a.s_nationkey, [a.s_suppkey, b.s_suppkey, c.s_suppkey] AS members FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey JOIN supplier c ON b.s_nationkey = c.s_nationkey AND b.s_suppkey < c.s_suppkey)
SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY members)::INTEGER AS nth, members FROM p QUALIFY nth <= 5""")
def pool_combinations(spark, d):
    return rp.combinations_of(t(spark, d, "supplier"), "s_nationkey", "s_suppkey", 3, 5)


@query("""WITH c AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier), p AS (SELECT n_nationkey AS s_nationkey, place, 10 - place AS score FROM nation, (VALUES (2), (0), (50)) i(place))
SELECT s_nationkey, s_suppkey, place::INTEGER AS place, score::INTEGER AS score FROM p JOIN c USING (s_nationkey, place)""")
def reranked_places(spark, d):
    c = t(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("place"))
    picks = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.explode(F.array(F.lit(2), F.lit(0), F.lit(50))).alias("place")).withColumn("score", 10 - F.col("place"))
    return rp.positional(picks, c, "s_nationkey", "place").select("s_nationkey", "s_suppkey", "place", "score")


@query("""SELECT vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def cosines_to_first(spark, d):
    v = t(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("b"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))  # one row


@query("""WITH w AS (SELECT item_id, ceil(length(text) / 4.0) AS asked FROM benchmark), d AS (SELECT doc_id % 40 AS item_id, ceil(length(text) / 4.0) AS n, strlen(text) AS b, text FROM documents WHERE doc_id % 40 IN (SELECT item_id FROM benchmark))
SELECT item_id, sum(n)::BIGINT AS tokens, max(n)::BIGINT AS longest, max(n + asked)::BIGINT AS pair_longest, count(*) FILTER (n + asked > 2000)::BIGINT AS over, sum(b)::BIGINT AS bytes, max(least(length(text), 32000))::INTEGER AS longest_input FROM w JOIN d USING (item_id) GROUP BY item_id""")
def rerank_totals(spark, d):
    pools = t(spark, d, "documents").groupBy((F.col("doc_id") % 40).alias("item_id")).agg(F.collect_list("text").alias("texts"))
    rows = t(spark, d, "benchmark").withColumnRenamed("text", "question").join(pools, "item_id")
    told = tx.pair_totals(F.col("question"), F.col("texts"), 4.0, 2000)
    return rows.select("item_id", *[c.alias(n) for n, c in told.items()], F.array_max(F.transform(tx.rank_input(F.col("texts")), lambda x: F.length(x))).alias("longest_input"))
