"""Append-only JSONL logs: read with a fixed schema, append, find what is new."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import observed


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSONL files under a schema; none if there is no such path. A file's last line may be torn and is left out;
    another bad line raises. Blank lines are skipped.

    Each file is split by Spark; a bad line is the last of its file if no line starts beyond it, which is settled by
    the lines' order within the file (block and row), aggregated per file, not by reading files whole.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], schema)
    lines = spark.read.schema("value string").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_at"))
    lines = lines.where(F.trim("value") != "")
    parsed = lines.withColumn("_row", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = lines.groupBy("_file").agg(F.max("_at").alias("_last"))
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    torn = parsed.join(last, "_file").withColumn("_bad", bad)
    checked = torn.where(~F.col("_bad") | (F.col("_at") < F.col("_last")))
    checked = checked.withColumn("_row", F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("bad line in "), F.col("_file")))).otherwise(F.col("_row")))
    return checked.select("_row.*").drop("_bad")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def pending(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows that are not done yet."""
    return planned.join(done.select(*key), key, "left_anti")


def invalid_events(events: DataFrame, total: str, parts: list[str], rel: float = 1e-6, absolute: float = 1e-3) -> DataFrame:
    """Events whose total is not the sum of its parts, unless they failed (error not null)."""
    from ..functions.scores import is_close

    whole = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    return events.where(F.col("error").isNull() & ~F.coalesce(is_close(F.col(total), whole, rel, absolute), F.lit(False)))


def recent(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows in that order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def last_champions(rows: DataFrame, island: str, champion: Column, order: list[str]) -> DataFrame:
    """The last champion of each island. Combined before the shuffle."""
    rest = [c for c in rows.columns if c != island]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.where(champion).groupBy(island).agg(best).select(island, "_row.*")


def violations(events: DataFrame, kind: str, abstention: str, refusal: str, total: str, parts: list[str], rel: float = 1e-6, absolute: float = 1e-3) -> DataFrame:
    """events with the first rule that each breaks, null for none: abstention is set iff kind is none or partial, refusal
    iff it is full, and the total is the sum of the parts unless the event failed (error not null)."""
    from ..functions.scores import is_close

    whole = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    timed = F.col("error").isNotNull() | F.coalesce(is_close(F.col(total), whole, rel, absolute), F.lit(False))
    broken = F.when(F.col(abstention).isNotNull() != F.col(kind).isin("none", "partial"), "abstention").when(F.col(refusal).isNotNull() != (F.col(kind) == "full"), "refusal").when(~timed, "time")
    return events.withColumn("violation", broken)


def history(rows: DataFrame, since: object = None, until: object = None, at: str = "at", **equal: object) -> DataFrame:
    """Rows of an optimizer's log from `since` on and before `until`, whose columns equal the given values; None: ignored."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == F.lit(v))
    rows = rows.where(F.col(at) >= F.lit(since)) if since is not None else rows
    return rows.where(F.col(at) < F.lit(until)) if until is not None else rows


class Backfilled(NamedTuple):
    """Lines of each outcome, and how many events each unknown model has."""

    instances: int
    malformed: int
    unknown: int
    oversize: int
    unknown_models: dict[str, int]


def backfill(lines: DataFrame, judged: DataFrame, root: str, schema: str, key: str, model: str, models: dict[str, str], session: str, order: list[str], text: str | None = None, most: int = 20_000) -> Backfilled:
    """Takes a log's lines (value) over into root: instances, and beside them what was left out and why.

    root/outcome=instance holds the events of known models under their new names, with their place in session and model
    and what judged has (nulls if nothing); root/outcome=malformed, =unknown and =oversize hold the lines left out: no
    JSON of the schema, a model that models does not list, a text of more than `most` characters. All are written by one
    pass over the lines, which also counts them. Blank lines are no lines. A key that judged has twice gets two rows.
    """
    seen = Observation()
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select("value", parsed.alias("_r"))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | F.col(f"_r.{key}").isNull()
    known = F.coalesce(F.col(f"_r.{model}").isin(*models), F.lit(False))
    outcome = F.when(bad, "malformed").when(~known, "unknown")
    if text:
        outcome = outcome.when(F.length(f"_r.{text}") > most, "oversize")
    rows = rows.withColumn("outcome", outcome.otherwise("instance")).observe(seen, *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("instance", "malformed", "unknown", "oversize")])
    names = F.create_map(*[F.lit(x) for pair in models.items() for x in pair])
    fields = [c for c in rows.select("_r.*").columns if c != "_bad"]
    good = F.col("outcome") == "instance"
    told = rows.select("outcome", F.when(~good, F.col("value")).alias("line"), *[F.when(good | (F.lit(c) == model), F.col(f"_r.{c}")).alias(c) for c in fields])
    told = told.withColumn("model", F.when(F.col("outcome") == "instance", F.element_at(names, F.col(model))))
    own = F.when(F.col("outcome") == "instance", F.struct(session, "model"))  # lines left out are spread by themselves, not one group
    nth = F.row_number().over(Window.partitionBy("outcome", own, F.when(F.col("outcome") != "instance", F.xxhash64("line"))).orderBy(*order))
    told = told.withColumn("instance", F.when(F.col("outcome") == "instance", nth - 1).cast("long"))
    mine = judged.select(F.col(key).alias("_key"), *[F.col(c) for c in judged.columns if c != key])
    told.join(mine, (F.col(key) == F.col("_key")) & (F.col("outcome") == "instance"), "left").drop("_key").write.partitionBy("outcome").parquet(root)
    left = lines.sparkSession.read.schema("outcome string, " + f"{model} string").parquet(root).where("outcome = 'unknown'").groupBy(F.coalesce(model, F.lit(""))).count().collect()  # models are few
    c = observed(seen, lambda: dict.fromkeys(("instance", "malformed", "unknown", "oversize"), 0))  # no lines at all
    return Backfilled(c["instance"], c["malformed"], c["unknown"], c["oversize"], {r[0]: r[1] for r in left})


def as_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts that read_log reads back alike, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    """A report's rows as one sorted JSON text: equal reports are equal files. Reports are aggregates, hence short."""
    columns = sorted(rows.columns)
    rows.select(*columns).orderBy(*columns).coalesce(1).write.mode("overwrite").json(path)
