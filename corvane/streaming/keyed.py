"""Tables that streams keep up to date: each micro-batch counts once, however often it is handed over."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import last_wins
from ..shared import get_text, names_in, put_text, removed


def store(rows: DataFrame, batch: int, root: str) -> bool:
    """Writes the rows of a batch, then its line in the ledger. A batch that the ledger has changes nothing.

    If the writer is lost in between, the batch is not in the ledger, is not read, and is written over when it comes
    again.
    """
    spark = rows.sparkSession
    if batch in ledger(spark, root):
        return False
    rows.write.mode("overwrite").parquet(f"{root}/batches/{batch}")
    put_text(spark, f"{root}/ledger/{batch}", "")
    return True


def base(spark: SparkSession, root: str) -> dict | None:
    """The compacted table (name) and the last batch that it holds (upto)."""
    text = get_text(spark, f"{root}/base.json")
    return json.loads(text) if text else None


def ledger(spark: SparkSession, root: str) -> set[int]:
    """Batches that count. Batch numbers only grow, so those up to the compacted one count as well."""
    done = base(spark, root)
    return {int(n) for n in names_in(spark, f"{root}/ledger") if n.isdigit()} | set(range(done["upto"] + 1) if done else ())


def stored(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows of batches that count, with `batch`, the number of the batch they came in."""
    done = base(spark, root)
    upto = done["upto"] if done else -1
    out = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    if done:
        out = out.unionByName(spark.read.schema(out.schema).parquet(f"{root}/bases/{done['name']}"))
    fresh = sorted(n for n in ledger(spark, root) if n > upto)
    for n in fresh:
        out = out.unionByName(spark.read.schema(schema).parquet(f"{root}/batches/{n}").withColumn("batch", F.lit(n).cast("long")))
    return out


def upsert_sink(root: str, key: list[str], order: list[str], schema=None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each key's last row of the batch goes into the table."""

    def sink(rows: DataFrame, batch: int) -> None:
        store(last_wins(rows, key, order), batch, root)

    return sink


def current(spark: SparkSession, root: str, key: list[str], schema) -> DataFrame:
    """One row per key, that of the last batch which had it."""
    rows = stored(spark, root, schema)
    return last_wins(rows, key, ["batch"]).drop("batch")


def compact(spark: SparkSession, root: str, key: list[str], schema) -> None:
    """Writes what is current as one table that takes the place of the batches so far; readers find one or the other."""
    counted = ledger(spark, root)
    if not counted:
        return
    name, before = uuid.uuid4().hex, base(spark, root)
    last_wins(stored(spark, root, schema), key, ["batch"]).write.parquet(f"{root}/bases/{name}")
    put_text(spark, f"{root}/base.json", json.dumps({"name": name, "upto": max(counted)}))
    for n in counted:
        if n > (before["upto"] if before else -1):
            removed(spark, f"{root}/batches/{n}")
            removed(spark, f"{root}/ledger/{n}")


def unfinished(planned: DataFrame, log: DataFrame, key: list[str], failed: Column) -> DataFrame:
    """Planned rows that no row of the log has finished: one that failed is planned again. A null `failed` is no failure."""
    return planned.join(log.where(~F.coalesce(failed, F.lit(False))).select(*key), key, "left_anti")


def merged_status(status: DataFrame, deltas: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """status brought up to date: of each key the row of the highest order, a delta's before a status's among equals."""
    both = status.withColumn("_kind", F.lit(0)).unionByName(deltas.withColumn("_kind", F.lit(1)))
    return last_wins(both, key, [*order, "_kind"]).drop("_kind")
