"""What the operators of this subpackage share: scratch tables, hashing predicates, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing that leaves every other character alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they see the driver's folders."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where none is named, a local one for a local master, an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later jobs start from files that survive executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local(df: DataFrame) -> pd.DataFrame:
    """The rows of a bounded table on the driver, by way of Arrow: arrays stay arrays, not lists of Python objects."""
    return df.toArrow().to_pandas()


def unsent(df: DataFrame) -> DataFrame:
    """df, never to be broadcast: Spark guesses a side's size from its files, where repeated values and rows that an
    explode makes hardly count, while in memory they do."""
    return df.hint("merge")


def release(df: DataFrame) -> None:
    """Deletes the files of a table that cut wrote, once nothing that is still to run reads them."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if scratch(spark).split(":", 1)[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name += "_"
    return f"_{name}"


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(n))


def thin(df: DataFrame, id_col: str, bound: int, n: int, seed: int) -> DataFrame:
    """About `bound` of the n rows, chosen by a hash of the id: the same rows on every run."""
    return df if n <= bound else df.where(F.xxhash64(F.lit(seed), F.col(id_col)) < F.lit(share_below(bound / n)))


def share_below(share: float) -> int:
    """The value that about this share of all signed 64-bit hashes stand below, however small the share is."""
    return min(int(share * 2**64) - 2**63, 2**63 - 1)


def n_words(text: str | Column) -> Column:
    """Words between ASCII white space, 0 for null: built-in functions only.

    A word begins where white space is followed by something else. Counting by splitting takes time in proportion to
    the text; Spark's regexp_count copies the whole text for every match.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (F.size(F.split(F.concat(F.lit(" "), t), r"[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])")) - 1).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, tag: str) -> DataFrame:
    """cut, after which the shuffle files of the job that wrote the table are removed: nothing can read them again. Files
    are compressed more tightly than by default."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)
