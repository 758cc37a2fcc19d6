"""Packing into length buckets of least padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, local, n_words

#: Rows of a run, within which rows of a bucket are numbered.
RUN = 2_000


def boundaries(tops: np.ndarray, counts: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths, among the lengths that occur (tops, ascending), that minimise padding with at most `buckets` buckets.

    best[j]: least padding of the first j lengths in the buckets so far; a bucket of lengths i + 1 to j pads to the last.
    The best i never falls as j grows, so each round halves the range of j and searches only between its neighbours' i.
    """
    n = len(tops)
    if not n:
        return []
    rows, held = np.concatenate(([0], np.cumsum(counts, dtype=np.float64))), np.concatenate(([0], np.cumsum(tokens, dtype=np.float64)))
    best, choice = np.full(n + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, n)):
        after, step, todo = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            j = (low + high) // 2
            i = slice(first, min(last, j - 1) + 1)
            cost = best[i] + tops[j - 1] * (rows[j] - rows[i]) - (held[j] - held[i])
            step[j] = first + int(cost.argmin())
            after[j] = cost[step[j] - first]
            todo += [(a, b, c, d) for a, b, c, d in ((low, j - 1, first, step[j]), (j + 1, high, step[j], last)) if a <= b]
        best = after
        choice.append(step)
    out, j = [], n
    for step in reversed(choice):
        if j:
            out.append(int(tops[j - 1]))
            j = int(step[j])
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, buckets: int = 16, budget: int = 16384, seed: int = 23) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, bucket, bucket_len, batch, slot, padding.

    The global histogram of lengths gives, by dynamic programming, the bucket lengths of least padding; a bucket is as
    long as its longest row, and a row goes to the first bucket it fits. The histogram, a row for each length that
    occurs, is what the driver holds: no more rows than the longest text has tokens, however many texts there are. A
    batch holds as many rows of one bucket as fit the budget at the bucket's length, one if a single row exceeds it;
    texts stay whole. Rows are numbered through a bucket in the
    order of a hash: within runs of about RUN rows, offset by the rows of the runs before, so that a bucket with most
    rows is no single task and only the last batch of a bucket can be short. Null and empty texts have no tokens and
    share the first bucket; null ids stay; repeated rows take a slot each; no rows give no rows.
    """
    size = n_words(text_col) if tokens is None else tokens.cast("long")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), size.alias("n_tokens")), "lengths")
    histogram = local(rows.groupBy("n_tokens").agg(F.count("*").alias("n"))).sort_values("n_tokens")
    lengths, times = histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy()
    tops = boundaries(lengths, times, lengths * times, buckets)
    if not tops:
        tops = [0]
    bounds = F.array(*[F.lit(t).cast("long") for t in tops])
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))).withColumn("bucket_len", F.element_at(bounds, F.col("bucket") + 1))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "n_tokens"))
    runs = max(1, -(-int(histogram["n"].sum()) // RUN))
    rows = rows.withColumn("_run", F.pmod("_h", F.lit(runs)).cast("int"))
    counts = rows.groupBy("bucket", "_run").count()
    before = Window.partitionBy("bucket").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("bucket").alias("_b"), F.col("_run").alias("_r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_run").orderBy("_h", "doc_id")
    placed = rows.withColumn("_nth", F.row_number().over(inside) - 1)
    placed = placed.join(starts, (F.col("bucket") == F.col("_b")) & (F.col("_run") == F.col("_r"))).withColumn("_nth", F.col("_nth") + F.col("_before"))
    fit = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_nth") / fit).cast("long").alias("batch"), F.pmod(F.col("_nth"), fit).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
