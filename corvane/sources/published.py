"""Index versions that are published whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import get_text, names_in, observed, put_text, removed


class Outcome(NamedTuple):
    """What a rebuild did: promoted, kept (the gate held the new version back), unchanged or empty (nothing was built)."""

    status: str
    indexed: int = 0
    skipped: int = 0
    read_back: int = 0
    version: str | None = None
    mark: str | None = None


def pointer(spark: SparkSession, root: str) -> dict | None:
    """version, before, mark and rows of what is live; null before the first promotion."""
    text = get_text(spark, f"{root}/live.json")
    return json.loads(text) if text else None


def live(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The rows that are live now. A reader keeps the version it has found: the one before the live one is not removed."""
    now = pointer(spark, root)
    if now is None:
        raise ValueError(f"nothing has been published in {root}")
    read = spark.read.schema(schema) if schema else spark.read
    return read.parquet(f"{root}/versions/{now['version']}")


def rebuild(nodes: DataFrame, root: str, changed: str, index: Callable[[DataFrame], DataFrame], expected: int | None = None, skip: str = "skip_reason") -> Outcome:
    """Builds a version from all nodes and makes it live if it is whole.

    The high-water mark is the largest text in `changed`. Nothing is built without nodes, nor if the mark is the one
    that is live. index(nodes) has a column `skip`, null for a row to index, else why it is left out. The rows are
    written beside what is live, counted while they are written, and read back. They become live only if none was
    skipped and at least `expected` (all nodes) were written and read back: then one rename replaces the file that names
    version and mark together. Else what is live stays, with its mark, so that the next run tries again; the new
    version's files go. Null `changed` counts as no change date; repeated nodes count as often as they occur.
    """
    spark = nodes.sparkSession
    n, mark = nodes.agg(F.count("*"), F.max(F.col(changed).cast("string"))).first()
    if not n:
        return Outcome("empty")
    now = pointer(spark, root)
    if now and now["mark"] == mark:
        return Outcome("unchanged", version=now["version"], mark=mark)
    version, seen = uuid.uuid4().hex, Observation()
    path = f"{root}/versions/{version}"
    figures = [F.count(F.when(F.col(skip).isNull(), 1)).alias("indexed"), F.count(skip).alias("skipped")]
    index(nodes).observe(seen, *figures).where(F.col(skip).isNull()).drop(skip).write.parquet(path)
    told = observed(seen, lambda: index(nodes).agg(*figures).first().asDict())
    indexed, skipped = told["indexed"], told["skipped"]
    read_back, need = spark.read.parquet(path).count(), n if expected is None else expected
    if skipped or indexed < need or read_back < need:
        removed(spark, path)
        return Outcome("kept", indexed, skipped, read_back, now and now["version"], now and now["mark"])
    put_text(spark, f"{root}/live.json", json.dumps({"version": version, "before": now and now["version"], "mark": mark, "rows": read_back}))
    for old in names_in(spark, f"{root}/versions"):
        if old not in (version, now and now["version"]):
            removed(spark, f"{root}/versions/{old}")
    return Outcome("promoted", indexed, skipped, read_back, version, mark)
