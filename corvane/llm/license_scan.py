"""License phrases, found by voting along diagonals of word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: What stands between words: words are runs of ASCII digits and lower-case letters and of all characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Lines and passages of well-known licenses, with the labels that the method adds.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc",
    "subject to the terms of the mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
    " and this permission notice shall be included in all copies or substantial portions of the software": "mit-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    " provided that the above copyright notice and this permission notice appear in all copies": "isc-text",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and"
    " the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-text",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0-notice",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose see the gnu general public license for more"
    " details": "gpl-notice",
}
#: A template counts as found from this share of its k-grams on; diagonals this near are one. Bits of a mask.
COVERAGE, GAP, MASK = 0.7, 3, 63


def templates() -> list[tuple[int, str, str, bool]]:
    """(number, phrase, label, whether it is one of the base phrases)."""
    rows = [(p, label, True) for p, label in BASE.items()] + [(p, label, False) for p, label in TEMPLATES.items()]
    return [(i, *row) for i, row in enumerate(rows)]


def gram_hashes(words: Column, k: int) -> Column:
    """Hash of each run of k words of an array, by place."""
    out = F.transform(words, lambda w: F.xxhash64(w))
    for j in range(1, k):
        later = F.slice(words, F.lit(j + 1), F.greatest(F.size(words) - j, F.lit(0)))
        out = F.zip_with(out, later, lambda h, w: F.xxhash64(h, w))
    return F.slice(out, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def gram_at(words: Column, at: Column, k: int) -> Column:
    return F.array_join(F.slice(words, at + 1, F.lit(k)), " ")


def template_grams(spark: SparkSession, k: int = K, listed: list[tuple[int, str, str, bool]] | None = None) -> DataFrame:
    """One row per template position: hash_t, gram_t, tid, offset, and the template's n_grams, label, is_base.

    Template -1 is the empty gram that every document carries once, so that each has a row.
    """
    rows = spark.createDataFrame(templates() if listed is None else listed, "tid int, phrase string, label string, is_base boolean")
    rows = rows.withColumn("w", F.split("phrase", " ")).where(F.size("w") >= k)
    rows = rows.withColumn("n_grams", F.size("w") - (k - 1)).select("*", F.posexplode(gram_hashes(F.col("w"), k)).alias("offset", "hash_t"))
    rows = rows.select("hash_t", gram_at(F.col("w"), F.col("offset"), k).alias("gram_t"), "tid", "offset", "n_grams", "label", "is_base")
    return rows.unionByName(spark.createDataFrame([(0, "", -1, 0, 1, "", False)], rows.schema))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, gap: int = GAP, k: int = K, listed: list[tuple[int, str, str, bool]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every rolling k-gram of every text is hashed. The places whose hash some template has (a fixed list, or `listed`:
    number, phrase, label, whether its places are counted; of any length) are joined, by hash and then word for word, to
    the template positions. Hits vote for (document, template, diagonal = place - offset); what a diagonal has matched
    is kept in bit masks of MASK bits, so repeated hits count once and votes combine before the shuffle. Diagonals of
    one template at most `gap` apart are merged and their masks joined; a template is found from `coverage` of its
    grams on, each of which has been verified word for word. A base phrase stands where its diagonal has every gram,
    which is an exact match. score: the best share found, 0 to 1. Null and empty texts have no words; repeated rows get
    a row each; a null doc_id stays null; no rows give no rows. Other columns of docs are left out.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, k, listed).collect()  # as long as the list of templates
    known, masks = sorted({g.hash_t for g in grams}), range(-(-max(g.n_grams for g in grams) // MASK))
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_th"), F.filter(F.split(text, BETWEEN), lambda w: w != "").alias("_w"))
    places = F.transform(gram_hashes(F.col("_w"), k), lambda h, at: F.when(h.isin(known), F.struct(at.alias("at"), h.alias("hash"))))
    rows = rows.select("doc_id", "_th", "_w", F.filter(places, lambda p: p.isNotNull()).alias("_p"))
    told = F.transform("_p", lambda p: F.struct(p["at"].alias("at"), p["hash"].alias("hash"), gram_at(F.col("_w"), p["at"], k).alias("gram")))
    every = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("gram")))
    rows = rows.select("doc_id", "_th", F.size("_w").cast("long").alias("n_words"), F.explode(F.concat(every, told)).alias("_g"))  # the words stay behind here
    rows = rows.select("doc_id", "_th", "n_words", F.col("_g.at").alias("_at"), F.col("_g.hash").alias("_hash"), F.col("_g.gram").alias("_gram"))
    positions = F.broadcast(spark.createDataFrame(grams, "hash_t long, gram_t string, tid int, offset int, n_grams int, label string, is_base boolean"))
    hits = rows.join(positions, (F.col("_hash") == F.col("hash_t")) & (F.col("_gram") == F.col("gram_t")))
    bit = F.expr(f"shiftleft(1L, offset % {MASK})")
    seen = [F.bit_or(F.when(F.floor(F.col("offset") / MASK) == m, bit).otherwise(F.lit(0).cast("long"))).alias(f"mask{m}") for m in masks]
    diagonals = hits.groupBy("doc_id", "_th", "n_words", "tid", "n_grams", "label", "is_base", (F.col("_at") - F.col("offset")).alias("diag")).agg(*seen, F.count("*").alias("n"))
    near = Window.partitionBy("doc_id", "_th", "tid").orderBy("diag")
    far = F.coalesce(F.col("diag") - F.lag("diag").over(near) > gap, F.lit(True))
    merged = diagonals.withColumn("_far", far.cast("int")).withColumn("_run", F.sum("_far").over(near))
    bits = lambda of: sum((F.bit_count(of(f"mask{m}")) for m in masks), F.lit(0))
    full = bits(F.col) == F.col("n_grams")
    spans = merged.groupBy("doc_id", "_th", "n_words", "tid", "n_grams", "label", "is_base", "_run").agg(
        bits(lambda c: F.bit_or(c)).alias("votes"), F.sum(full.cast("long")).alias("n_full"),
        F.min(F.when(full, F.col("diag"))).alias("first"), F.max(F.when(full, F.col("diag"))).alias("last"), F.max("n").alias("n"),
    )
    base = F.col("is_base") & (F.col("n_full") > 0)
    share = F.col("votes") / F.col("n_grams")
    found = F.when(F.col("is_base"), base).otherwise((F.col("tid") >= 0) & (share >= coverage))
    sorted_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("doc_id", "_th", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("n_full"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        sorted_set(F.when(base, F.col("label"))).alias("base_labels"),
        sorted_set(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(found, share)), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("tid") == -1, F.col("n"))).alias("_copies"),
    )
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """The same result as DuckDB SQL, for tables whose doc_id is unique."""
    listed = ",\n".join(f"({i}, '{p}', '{label}', {str(base).lower()})" for i, p, label, base in templates())
    return f"""
WITH t(tid, phrase, label, is_base) AS (VALUES {listed}),
tg AS (SELECT tid, label, is_base, len(string_split(phrase, ' ')) - 1 AS n_grams, unnest(range(0, len(string_split(phrase, ' ')) - 1)) AS o, string_split(phrase, ' ') AS tw FROM t),
tgg AS (SELECT tid, label, is_base, n_grams, o, tw[o + 1] || ' ' || tw[o + 2] AS gram FROM tg),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS pos FROM d),
g AS (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS gram FROM p),
diag AS (SELECT doc_id, tid, label, is_base, n_grams, pos - o AS diag, list(DISTINCT o) AS seen FROM g JOIN tgg USING (gram) GROUP BY ALL),
far AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag) <= {GAP} THEN 0 ELSE 1 END AS f FROM diag),
run AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS run FROM far),
span AS (SELECT doc_id, tid, label, is_base, n_grams, run, len(list_distinct(flatten(list(seen)))) AS votes, count(*) FILTER (len(seen) = n_grams) AS n_full,
  min(diag) FILTER (len(seen) = n_grams) AS first, max(diag) FILTER (len(seen) = n_grams) AS last FROM run GROUP BY ALL),
hit AS (SELECT *, votes::DOUBLE / n_grams AS share, is_base AND n_full > 0 AS base, CASE WHEN is_base THEN n_full > 0 ELSE votes::DOUBLE / n_grams >= {COVERAGE} END AS found FROM span),
a AS (SELECT doc_id, sum(n_full) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels,
  max(share) FILTER (found) AS score FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (doc_id)"""
