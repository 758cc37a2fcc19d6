"""Publishing, keyed tables, live intervals and kept searches."""

import threading

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import retrieval
from corvane.operators.statistics import normal_interval
from corvane.plans import hybrid
from corvane.shared import get_text, put_text
from corvane.sources import logs, published
from corvane.streaming import keyed, live


def plain(rows):
    return rows.withColumn("skip_reason", F.lit(None).cast("string"))


def nodes(spark, n, mark="2024-01-01", bad=0):
    return spark.range(n).select("id", F.lit(mark).alias("changed"), (F.col("id") < bad).alias("bad"))


def picky(rows):
    return rows.withColumn("skip_reason", F.when(F.col("bad"), "no scope"))


def test_nothing_goes_live_unless_it_is_whole(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert published.rebuild(nodes(spark, 0), root, "changed", plain).status == "empty" and published.pointer(spark, root) is None
    first = published.rebuild(nodes(spark, 5), root, "changed", plain)
    assert (first.status, first.indexed, first.read_back) == ("promoted", 5, 5) and published.live(spark, root).count() == 5
    held = published.rebuild(nodes(spark, 9, "2024-02-01", bad=1), root, "changed", picky)  # one skipped: all stays, the mark too
    assert (held.status, held.indexed, held.skipped, held.mark) == ("kept", 8, 1, "2024-01-01")
    assert published.live(spark, root).count() == 5 and published.pointer(spark, root)["mark"] == "2024-01-01"
    assert published.rebuild(nodes(spark, 9, "2024-02-01"), root, "changed", plain, expected=10).status == "kept"
    again = published.rebuild(nodes(spark, 9, "2024-02-01"), root, "changed", plain)  # tried again, since the mark had stayed
    assert again.status == "promoted" and published.live(spark, root).count() == 9
    assert published.rebuild(nodes(spark, 9, "2024-02-01"), root, "changed", plain).status == "unchanged"


def test_a_reader_keeps_its_version_while_the_pointer_turns(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    published.rebuild(nodes(spark, 5), root, "changed", plain)
    reader = published.live(spark, root)
    published.rebuild(nodes(spark, 7, "2024-02-01"), root, "changed", plain)
    assert reader.count() == 5 and published.live(spark, root).count() == 7


def test_a_small_file_is_the_old_or_the_new_text(spark, tmp_path):
    path, seen, stop = f"file://{tmp_path}/p/live.json", set(), threading.Event()
    put_text(spark, path, "text 0")

    def read():
        while not stop.is_set():
            seen.add(get_text(spark, path))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 30):
        put_text(spark, path, f"text {i}")
    stop.set()
    reader.join()
    assert seen <= {f"text {i}" for i in range(30)} and get_text(spark, path) == "text 29"


def test_a_batch_counts_once_and_the_last_wins(spark, tmp_path):
    root, schema = f"file://{tmp_path}/table", "k int, at int, v string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    now = lambda: {r.k: r.v for r in keyed.current(spark, root, ["k"], schema).collect()}
    sink = keyed.upsert_sink(root, ["k"], ["at"])
    assert now() == {}
    sink(rows((1, 1, "a"), (1, 2, "b"), (2, 1, "c")), 0)
    sink(rows((1, 0, "d"), (3, 1, "e")), 1)
    assert now() == {1: "d", 2: "c", 3: "e"}
    sink(rows((1, 9, "again"), (9, 9, "again")), 0)
    assert now() == {1: "d", 2: "c", 3: "e"}
    rows((7, 7, "lost")).write.parquet(f"{root}/batches/2")  # a writer was lost before its line in the ledger
    assert now() == {1: "d", 2: "c", 3: "e"}
    keyed.compact(spark, root, ["k"], schema)
    sink(rows((1, 9, "again")), 1)
    sink(rows((2, 1, "f")), 2)
    assert now() == {1: "d", 2: "f", 3: "e"} and keyed.ledger(spark, root) == {0, 1, 2}
    keyed.compact(spark, root, ["k"], schema)
    assert now() == {1: "d", 2: "f", 3: "e"}


def test_only_success_finishes_a_trial(spark):
    planned = spark.createDataFrame([(i,) for i in range(4)], "trial int")
    log = spark.createDataFrame([(0, None), (1, "timeout"), (2, "timeout"), (2, None)], "trial int, error string")
    assert sorted(r.trial for r in keyed.unfinished(planned, log, ["trial"], F.col("error").isNotNull()).collect()) == [1, 3]


def test_deltas_go_before_statuses_of_the_same_time(spark):
    one = lambda *x: spark.createDataFrame(list(x), "k int, at int, v string")
    got = keyed.merged_status(one((1, 1, "s"), (2, 5, "s")), one((1, 1, "d"), (2, 4, "d"), (3, 1, "d")), ["k"], ["at"]).collect()
    assert {r.k: r.v for r in got} == {1: "d", 2: "s", 3: "d"}


def test_intervals_after_every_batch_are_those_of_all_rows_so_far(spark, tmp_path):
    rows = [("a", "full", i % 7, float((i * 37) % 11)) for i in range(60)] + [("b", "full", 1, 2.0), ("b", "full", 1, 4.0)] + [("c", "none" if i % 2 else "full", i, 1.0) for i in range(6)] + [("a", "full", 3, None)]
    log = spark.createDataFrame(rows, "m string, kind string, item int, v double").withColumn("part", F.monotonically_increasing_id() % 3)
    parts = [r.asDict() for r in log.collect()]
    for n in range(3):
        log.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    stream = spark.readStream.schema("m string, kind string, item int, v double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
    root, told = f"file://{tmp_path}/state", {}
    changes = live.interval_changes(stream, ["m"], "kind", "item", "v").schema

    def after(batch):
        told[batch] = {r.m: r for r in live.intervals(keyed.stored(spark, root, changes), ["m"], "kind").collect()}

    live.live_intervals(stream, ["m"], "kind", "item", "v", root, after)
    assert sorted(told) == [0, 1, 2]
    for batch, got in told.items():
        so_far = spark.createDataFrame([p for p in parts if p["part"] <= batch], "m string, kind string, item int, v double, part long")
        want = {r.m: r for r in normal_interval(so_far, ["m"], "item", "v").collect()}
        assert got.keys() == want.keys()
        for m, r in got.items():
            kinds = {p["kind"] for p in parts if p["part"] <= batch and p["m"] == m and p["v"] is not None}
            assert r.blended == (len(kinds) > 1) and r.n_items == want[m].n_items and r.insufficient == want[m].insufficient
            if not r.blended:
                assert abs(r.mean - want[m].mean) < 1e-9
                assert (r.low is None) == (want[m].low is None) and (r.low is None or abs(r.low - want[m].low) < 1e-9)


def test_items_of_a_part_share_one_state(spark, tmp_path):
    """However many items there are, a micro-batch takes a bounded number of calls, each of which tells one row."""
    rng = np.random.default_rng(9)
    rows = [("ab"[i % 2], "full", int(x) if x else None, float(v)) for i, (x, v) in enumerate(zip(rng.integers(0, 700, 4000), rng.normal(size=4000)))]
    schema, told = "m string, kind string, item long, v double", {}
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(2):
            spark.createDataFrame(rows[part::2] + rows[: 100 * part], schema).write.mode("append").parquet(f"file://{tmp_path}/log")
            changes = live.interval_changes(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/log"), ["m"], "kind", "item", "v")
            sink = lambda rows, n: told.setdefault(n, rows.collect())
            changes.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    assert sorted(told) == [0, 1] and all(0 < len(part) <= 2 * 64 for part in told.values())
    got = {r.m: r for r in live.intervals(spark.createDataFrame([r for part in told.values() for r in part], changes.schema), ["m"], "kind").collect()}
    for r in normal_interval(spark.createDataFrame(rows + rows[:100], schema), ["m"], "item", "v").collect():
        mine = got[r.m]
        assert (mine.n_items, mine.insufficient) == (r.n_items, r.insufficient)
        assert max(abs(mine.mean - r.mean), abs(mine.low - r.low), abs(mine.high - r.high)) < 1e-9


def test_a_kept_search_is_not_made_again(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "red fish", [1.0, 0.0], ["a"]), (2, "blue fish", [0.0, 1.0], ["b"]), (3, None, None, ["a"])], "doc_id long, text string, vector array<double>, tags array<string>")
    ask = spark.createDataFrame([(10, "red", [1.0, 0.1]), (11, "red", [0.0, 1.0]), (12, "none of it", None)], "query_id long, text string, vector array<double>")
    memo, made = f"file://{tmp_path}/memo", []
    whole = hybrid.searched
    monkeypatch.setattr(hybrid, "searched", lambda docs, unique, *a: made.append(unique.count()) or whole(docs, unique, *a))
    tell = lambda rows: sorted((r.query_id, r.doc_id, r["rank"]) for r in rows.collect())
    first = tell(hybrid.hybrid_search(docs, ask, memo=memo))
    assert made == [2] and {q for q, _, _ in first} == {10, 11} and first[0][1] == 1
    assert tell(hybrid.hybrid_search(docs, ask, memo=memo)) == first and made == [2]  # also the question without results
    hybrid.hybrid_search(docs, ask, {"tags": "b"}, memo=memo)
    hybrid.hybrid_search(docs, ask, {"tags": ["b"]}, memo=memo)
    assert made == [2, 2]  # other filters are other searches, the same filters told otherwise are not
    assert tell(hybrid.hybrid_search(docs, ask)) == first


def test_a_log_that_is_not_there_is_empty(spark, tmp_path):
    assert logs.read_log(spark, f"file://{tmp_path}/none", "a int").count() == 0


def test_backfill_counts_and_keeps_what_it_leaves_out(spark, tmp_path):
    lines = ['{"id":1,"m":"x","s":1,"at":2,"q":"ab"}', '{"id":2,"m":"x","s":1,"at":1,"q":"abcdef"}', "{torn", '{"id":4,"m":"?","s":1,"at":1,"q":""}', " ", '{"id":5,"m":"x","s":1,"at":9,"q":null}', '{"m":"x"}']
    judged = spark.createDataFrame([(1, 0.5)], "id int, score double")
    root = f"file://{tmp_path}/out"
    told = logs.backfill(spark.createDataFrame([(x,) for x in lines], "value string"), judged, root, "id int, m string, s int, at int, q string", "id", "m", {"x": "new"}, "s", ["at"], "q", 4)
    assert told == logs.Backfilled(2, 2, 1, 1, {"?": 1})
    got = spark.read.parquet(f"{root}/outcome=instance").collect()
    assert sorted((r.id, r.model, r.instance, r.score) for r in got) == [(1, "new", 0, 0.5), (5, "new", 1, None)]
    assert {r.line for r in spark.read.parquet(f"{root}/outcome=malformed").collect()} == {"{torn", '{"m":"x"}'}
    assert spark.read.parquet(f"{root}/outcome=oversize").first().line == lines[1]


def test_the_dense_leg_of_a_search_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = [(i, "blue", v) for i, v in enumerate(rng.normal(size=(200, 5)).tolist())]
    ask = [(1000 + i, f"red{i}", v) for i, v in enumerate(rng.normal(size=(12, 5)).tolist())]  # no word in common
    schema = "{} long, text string, vector array<double>"
    monkeypatch.setattr(hybrid, "knn", lambda *a: retrieval.knn(*a, batch=4))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = hybrid.hybrid_search(spark.createDataFrame(docs, schema.format("doc_id")), spark.createDataFrame(ask, schema.format("query_id"))).collect()
    finally:
        spark.conf.set(key, before)
    unit = lambda rows: (m := np.array([v for _, _, v in rows])) / np.linalg.norm(m, axis=1)[:, None]
    best = np.argsort(-(unit(ask) @ unit(docs).T), axis=1)[:, :5]
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in rows) == [(q, n, int(j)) for (q, _, _), found in zip(ask, best) for n, j in enumerate(found, 1)]
