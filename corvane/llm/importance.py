"""Importance resampling towards a target corpus: hashed n-gram features, log-ratio gains, Gumbel noise, highest scores."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, local, release, settled, unused
from .sql_parts import crc32_of, crc32_tables

#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 20
#: A-Z become a-z; every other ASCII character but digits and a-z becomes a space; bytes beyond ASCII stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", min(at + CHUNK, len(text)))
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(text: bytes, buckets: int, longest: int = 3) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, features, distinct buckets, how many features fall into each) of a text.

    A feature is a run of 1 to `longest` words joined by a space; its bucket is its crc32 modulo `buckets`. A checksum
    goes on from that of the run one word shorter, so no run is ever put together.
    """
    total, n_words, carried = np.zeros(buckets, dtype=np.int64), 0, []
    for words in words_of(text):
        n_words += len(words)
        fresh, words = len(carried), carried + words
        spaced = [b" " + w for w in words]
        sums = list(map(zlib.crc32, words))
        for k in range(longest):
            if k:
                sums = list(map(zlib.crc32, spaced[k:], sums))  # those of k + 1 words; the last start has none
            new = np.array(sums[max(fresh - k, 0):], dtype=np.int64)  # runs that end in this list
            if len(new):
                total += np.bincount(new % buckets, minlength=buckets)
        carried = words[len(words) - min(longest - 1, len(words)):]
    hit = np.flatnonzero(total)
    return n_words, int(total.sum()), hit.astype(np.int32), total[hit].astype(np.int32)


def feature_table(texts: DataFrame, buckets: int, tag: str) -> DataFrame:
    """digest, copies, n_words, n_features, bucket and count arrays: one row per distinct text of texts (text, copies)."""
    schema = "digest binary, copies long, n_words long, n_features long, buckets array<int>, counts array<int>"
    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [features(t.as_buffer().to_pybytes(), buckets) for t in part.column("text").cast(pa.large_binary())]
                ends = np.cumsum([0] + [len(r[2]) for r in rows]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[i] for r in rows]))) for i in (2, 3)]
                numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("copies"), *numbers, *lists], ["digest", "copies", "n_words", "n_features", "buckets", "counts"])

    return settled(keyed.mapInArrow(described, schema), tag)


def bucket_totals(table: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket, each text as often as it occurs. A task adds up its own; `buckets` sums reach the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            lists, copies = b.column("buckets"), b.column("copies").to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            np.add.at(total, lists.flatten().to_numpy(), b.column("counts").flatten().to_numpy() * np.repeat(copies, sizes))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    sums = local(table.select("copies", "buckets", "counts").mapInArrow(added, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    out = np.zeros(buckets, dtype=np.int64)
    out[sums["bucket"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share of a bucket over the source's), by bucket."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * (s_all + b)) / (float(s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighted(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, n_words, n_features and weight (the gains of all features added up) of each text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("buckets")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            run = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()] * b.column("counts").flatten().to_numpy())])
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n_words"), b.column("n_features"), pa.array(run[ends[1:]] - run[ends[:-1]])], ["digest", "n_words", "n_features", "weight"])

    return table.select("digest", "n_words", "n_features", "buckets", "counts").mapInArrow(scored, "digest binary, n_words long, n_features long, weight long")


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """text, copies: identical texts as one row. Copies are counted before the shuffle."""
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))


def noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256 of `seed:id`; a null id counts as empty text."""
    hexes = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(hexes, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def ranks(rows: DataFrame, best: list[Column], keep: list[str]) -> DataFrame:
    """rows' `keep` columns with rank, 1 first: sorted ranges, each numbered by itself and moved on by those before it."""
    ranges = rows.repartitionByRange(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *best).sortWithinPartitions(*best)
    place = F.monotonically_increasing_id()
    placed = settled(ranges.select(*keep, F.shiftright(place, 33).alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranges")
    sizes = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row per range
    starts, before = [], 0
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "_r long, _before long"))
    return placed.join(offsets, F.col("_range") == F.col("_r")).select(*keep, (F.col("_before") + F.col("_at") + 1).alias("rank"))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (all long); the drawn rows have a rank.

    Identical texts are grouped by their whole text; features, and the weight from them, are computed once a text, and
    its counts enter the corpus totals as often as the text occurs. The weights are joined back by the text's sha256,
    and only then does each document get its own noise. Of the N rows of at least `least_words` words, the
    floor(percent * N / 100) of highest score are drawn, ties to the smaller id, null ids last. What reaches the driver
    is `buckets` sums a corpus and the number of rows of each range. Null and empty texts have no features and weight 0;
    a null id takes the noise of an empty id; repeated rows are rows of their own; empty tables give no rows, and an
    empty target counts as no features. Other columns of docs are left out. Texts of any length: a text's words are
    taken in pieces.
    """
    table = feature_table(distinct_texts(docs, text_col), buckets, "features")
    aim = feature_table(distinct_texts(target, target_text), buckets, "target")
    gain = gains(bucket_totals(table, buckets), bucket_totals(aim, buckets))
    ident = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("_digest"))
    scored = ident.join(weighted(table, gain), F.col("_digest") == F.col("digest")).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    scored = settled(scored, "scored")
    for done in (table, aim):
        release(done)
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = ranks(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], columns)
    out = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that are drawn, with all of their columns and `rank`; for ids that are unique."""
    ident = unused(docs, "id")
    picked = importance_resample(docs, target, id_col, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias(ident), "rank")
    return docs.drop("rank").join(picked, F.col(id_col) == F.col(ident)).drop(ident)


def oracle(buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> str:
    """importance_resample of documents towards benchmark as DuckDB SQL."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "(SELECT unnest(w) AS f UNION ALL SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) UNION ALL SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents), e AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS c FROM d, LATERAL {runs} GROUP BY ALL),
ef AS (SELECT f, count(*) AS c FROM e, LATERAL {runs} GROUP BY ALL),
every AS (SELECT f FROM df UNION SELECT f FROM ef),
{crc32_tables("(SELECT max(strlen(f)) FROM every)")},
code AS ({crc32_of("every", "f")}),
s AS (SELECT crc % {buckets} AS b, sum(c) AS s FROM df JOIN code USING (f) GROUP BY 1),
t AS (SELECT crc % {buckets} AS b, sum(c) AS t FROM ef JOIN code USING (f) GROUP BY 1),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + {buckets})::DOUBLE) / ((s + 1)::DOUBLE * (t_all + {buckets})::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (b), total),
weights AS (SELECT doc_id, sum(c) AS n_features, sum(c * g) AS weight FROM df JOIN code USING (f) JOIN gain ON b = crc % {buckets} GROUP BY doc_id),
x AS (SELECT doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || left(sha256('{seed}:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
r AS (SELECT *, CASE WHEN n_words >= {least_words} THEN row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) END AS place, (SELECT count(*) FROM x WHERE n_words >= {least_words}) * {percent} // 100 AS drawn FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank FROM r"""
