"""Live aggregates over an event log that grows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch
from .keyed import store, stored


def once_each(stream: DataFrame, key: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key's first event; with a time column, state older than `late` is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key) if time else stream.dropDuplicates(key)


def live_counts(stream: DataFrame, group: list[str], value: str) -> DataFrame:
    return stream.groupBy(*group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest"))


def windowed(stream: DataFrame, time: str, width: str, group: list[str], value: str, late: str = "1 hour") -> DataFrame:
    w = F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w, *group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *group, "n", "total")


def run_available(aggregate: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over what its source holds now; the result's last state, as a table of the shared folder."""
    spark: SparkSession = aggregate.sparkSession
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        aggregate.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/state-{n}")).start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return spark.read.schema(aggregate.schema).parquet(f"{base}/state-{last}")


#: What a group's interval is made of, as sums over its items: of trials, of each item's mean, of r m, r m^2, of squares
#: within, of r^2 (r: an item's trials, m: its mean).
SUMS = ["items", "trials", "means", "rm", "rmm", "within", "rr"]


#: Into how many parts the items of a group are dealt; the items of a part share one state.
PARTS = 64


def interval_changes(stream: DataFrame, group: list[str], kind: str, item: str, value: str) -> DataFrame:
    """(group, kind, a change of each of SUMS): what the rows of a micro-batch change in the sums of their groups.

    State is kept per item (trials, sum, sum of squares), on whichever executor has the item; a group's sums change by
    the difference between what its items gave before and give now. A group's items are dealt by hash into PARTS, and
    the items of a part are one table of the state, brought up to date at once: a call costs about the same for one item
    as for thousands. Items are told apart as strings, a null item from all of them. Null values are skipped.
    """
    from pyspark.sql.streaming import StatefulProcessor

    names = {c: stream.schema[c].dataType.simpleString() for c in [*group, kind]}
    keys = [*group, kind]
    SUMS_, own = list(SUMS), ["r", "s", "q"]

    class Items(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("items", "table binary")

        def handleInputRows(self, key, rows, timerValues):
            new = summed(pd.concat([summed(p.assign(r=1, s=p["v"], q=p["v"] * p["v"])[["i", *own]]) for p in rows]))
            old = pa.ipc.open_stream(self.state.get()[0]).read_pandas() if self.state.exists() else new.iloc[:0]
            now = summed(pd.concat([old, new]))
            self.state.update((packed(now),))
            was = old[old["i"].isin(new["i"])]
            is_ = now[now["i"].isin(new["i"])]
            yield pd.DataFrame({**{c: [k] for c, k in zip(keys, key)}, **{n: [float(b - a)] for n, a, b in zip(SUMS_, told(was), told(is_))}})

        def close(self):
            pass

    def summed(items: pd.DataFrame) -> pd.DataFrame:
        return items.groupby("i", sort=False, as_index=False)[own].sum()

    def packed(items: pd.DataFrame) -> bytes:
        out, table = pa.BufferOutputStream(), pa.table({"i": pa.array(items["i"], pa.string()), "r": pa.array(items["r"], pa.int64()), "s": pa.array(items["s"], pa.float64()), "q": pa.array(items["q"], pa.float64())})
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return out.getvalue().to_pybytes()

    def told(items):
        r, s, q = (items[c].to_numpy(float) for c in own)
        return len(r), r.sum(), (s / r).sum(), s.sum(), (s * s / r).sum(), (q - s * s / r).sum(), (r * r).sum()

    rows = stream.where(F.col(value).isNotNull()).select(*keys, F.pmod(F.xxhash64(item), F.lit(PARTS)).alias("p"), F.coalesce(F.concat(F.lit("="), F.col(item).cast("string")), F.lit("")).alias("i"), F.col(value).cast("double").alias("v"))
    schema = ", ".join(f"{c} {n}" for c, n in names.items()) + ", " + ", ".join(f"{n} double" for n in SUMS)
    return rows.groupBy(*keys, "p").transformWithStateInPandas(Items(), schema, "Update", "None")


def intervals(changes: DataFrame, group: list[str], kind: str, level: float = 0.95, least_items: int = 2) -> DataFrame:
    """Per group the item-equal mean and its normal interval, from all changes so far.

    blended: the group holds several kinds of question, which no average should blend; it has no mean then. insufficient:
    under least_items items there is a mean but no interval. An item belongs to one kind.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    by_kind = changes.groupBy(*group, kind).agg(*[F.sum(c).alias(c) for c in SUMS])
    t = by_kind.groupBy(*group).agg(*[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("kinds"))
    n, trials = F.col("items"), F.col("trials")
    within = F.coalesce(F.try_divide(F.col("within"), trials - n), F.lit(0.0))
    between_ms = F.try_divide(F.col("rmm") - F.col("rm") * F.col("rm") / trials, n - 1)
    between = F.greatest(F.coalesce(F.try_divide(between_ms - within, F.try_divide(trials - F.col("rr") / trials, n - 1)), F.lit(0.0)), F.lit(0.0))
    half, blended, enough = z * F.sqrt(between / n + within / trials), F.col("kinds") > 1, n >= least_items
    mean = F.when(~blended, F.col("means") / n)
    return t.select(*group, n.cast("long").alias("n_items"), trials.cast("long").alias("n_trials"), mean.alias("mean"), F.when(enough, mean - half).alias("low"), F.when(enough, mean + half).alias("high"), (~enough).alias("insufficient"), blended.alias("blended"))


def live_intervals(stream: DataFrame, group: list[str], kind: str, item: str, value: str, root: str, after: Callable[[int], None] | None = None) -> DataFrame:
    """Runs over what the stream's source holds now; the intervals over all rows so far, from a table of changes in root.

    Each micro-batch adds a few sums per group, once: a batch that comes again after a failure is the same batch.
    after(batch) is called when a batch is in.
    """
    spark: SparkSession = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changes = interval_changes(stream, group, kind, item, value)
    schema = changes.schema

    def sink(rows: DataFrame, batch: int) -> None:
        store(rows.groupBy(*group, kind).agg(*[F.sum(c).alias(c) for c in SUMS]), batch, root)
        if after:
            after(batch)

    try:
        query = changes.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return intervals(stored(spark, root, schema), group, kind)
