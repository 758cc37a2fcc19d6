"""The shared scratch folder and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is named, a local one for a local master, an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df from files of the shared folder: computed once, and safe from lost executors.

    The shuffle files of the job that writes them are removed at its end: nothing can read those again.
    """
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `written` wrote, once nothing that is still to run reads them."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if scratch(spark).split(":", 1)[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name += "_"
    return f"_{name}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Makes `path` a small file of this text at one stroke: written beside it, then renamed over it. A reader finds the old
    text or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    local = fs.getScheme() == "file"
    fs = fs.getRawFileSystem() if local else fs  # else a checksum file would have to turn with the file
    fs.mkdirs(target.getParent())
    out = fs.create(beside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if local:
        fs.rename(beside, target)
        return
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, target, how)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    source = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def observed(seen: Observation, otherwise: Callable[[], dict]) -> dict:
    """What was observed while a job ran; else what `otherwise` finds. Spark loses the figures when it learns, while the job
    runs, that what comes after a shuffle is empty, and drops that part of the plan."""
    try:
        found = seen.get
    except Py4JJavaError:
        found = {}
    return found or otherwise()
