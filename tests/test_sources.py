"""Logs, corpora, versions, streams, and the registry without the deletable subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.sources import corpus, logs
from corvane.streaming import live

ROOT = Path(__file__).resolve().parents[1]


def test_log_tolerates_only_a_torn_last_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1, "v": 2.5}\n\n{"i": 2}\n{"i": 3, "v')
    (tmp_path / "b.jsonl").write_text('{"i": 4, "extra": 1}\n')
    assert sorted((r.i, r.v) for r in logs.read_log(spark, str(tmp_path), "i int, v double").collect()) == [(1, 2.5), (2, None), (4, None)]
    (tmp_path / "c.jsonl").write_text('{"i": 1}\n{"i": \n{"i": 2}\n')
    with pytest.raises(Exception, match="bad line"):
        logs.read_log(spark, str(tmp_path), "i int, v double").collect()


def test_append_and_pending(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string")
    logs.append_log(rows.limit(1), str(tmp_path / "log"))
    logs.append_log(rows.where("i = 2"), str(tmp_path / "log"))
    back = logs.read_log(spark, str(tmp_path / "log"), "i int, k string")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]
    assert [r.i for r in logs.pending(spark.range(4).select(F.col("id").cast("int").alias("i")), back, ["i"]).orderBy("i").collect()] == [0, 3]


def test_invalid_events(spark):
    rows = [(1, 10.0, 4.0, 6.0, None), (2, 10.0, 4.0, 7.0, None), (3, 10.0, 1.0, 1.0, "failed"), (4, None, 1.0, 1.0, None)]
    got = logs.invalid_events(spark.createDataFrame(rows, "i int, total double, a double, b double, error string"), "total", ["a", "b"])
    assert sorted(r.i for r in got.collect()) == [2, 4]


def test_delimited(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,tags,text\n1,"x| y||x","two\nlines"\n2,,last\n')
    rows = corpus.read_delimited(spark, str(tmp_path / "c.csv"), "id int, tags string, text string", ["tags"]).orderBy("id").collect()
    assert rows[0].tags == ["x", "y"] and rows[0].text == "two\nlines" and rows[1].tags == []


def test_blocks_and_latest_keys(spark):
    tree = '[{"type": "p", "children": [{"text": "Hello\\u00a0 "}, {"url": "http://x", "children": [{"text": "link"}]}]}]'
    df = spark.createDataFrame([(tree,), ("plain",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(corpus.text_of_blocks(F.col("t"))).collect()] == ["Hello link (http://x)", "plain", None, ""]
    m = spark.sql("SELECT map('a-1', 'x', 'a-3', 'y', 'a', 'z', 'b', 'w') AS m").select(corpus.latest_keys(F.col("m"))).first()[0]
    assert m == {"a": "y", "b": "w"}


def test_stream_counts_each_event_once(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.unionByName(events.limit(10)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = live.run_available(live.live_counts(live.once_each(stream, ["event_id"]), ["event_type"], "value"))
    assert {r.event_type: r.n for r in got.collect()} == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_registry_without_the_subpackage(tmp_path):
    for name in ("corvane", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(ROOT / name) else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "corvane/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[1:] == ["True", "False"], said.stderr
