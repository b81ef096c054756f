"""Bucketed tables and the streams that keep them."""

import json
import os

from pyspark.sql import functions as F
from test_streaming import events
from verimill.sources.buckets import Buckets
from verimill.streaming import jobs, stored

ROW = "k string, n long"


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), ("k",), ROW, 32)
    assert t.read().count() == 0
    t.write(0, spark.createDataFrame([(f"k{i}", 0) for i in range(500)] + [(None, 0)], ROW))
    first = files(t.path)
    keys = ["k1", "k2", "k3", None]
    changed = spark.createDataFrame([(k, 1) for k in keys], ROW)
    touched = t.touched(changed)
    assert len(touched) <= len(keys)
    before = t.read(touched)
    assert {r.k for r in before.collect()} >= set(keys) and before.count() < 150
    t.write(1, before.filter("k IS NOT NULL AND k NOT IN ('k1', 'k2', 'k3')").union(changed))
    assert first == [f for f in files(t.path) if "batch=0/" in f] and len(files(f"{t.path}/batch=1")) == len(touched)
    assert {(r.k, r.n) for r in t.read().collect()} == {(f"k{i}", int(i in (1, 2, 3))) for i in range(500)} | {(None, 1)}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in t.clean()} == touched and t.read().count() == 501


def test_a_broken_batch_is_not_read_and_may_be_repeated(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), ("k",), ROW, 4)
    t.write(0, spark.createDataFrame([("a", 0), ("b", 0)], ROW))
    t.write(1, spark.createDataFrame([("a", 9), ("b", 9)], ROW))
    os.remove(f"{t.path}/batch=1/_SUCCESS")
    assert {r.n for r in t.read().collect()} == {0}
    for _ in range(2):  # a repetition starts from what was before it
        t.write(1, t.read(before=1).selectExpr("k", "n + 1 AS n"))
    assert {r.n for r in t.read().collect()} == {1}


def test_the_stored_stream_is_the_plain_one(spark, tmp_path):
    rows = events(60)
    parts = [spark.read.schema(jobs.EVENT).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows[k : k + 20]])) for k in (0, 20, 40)]
    table = Buckets(spark, str(tmp_path / "docs"), ("source", "source_object_id"), stored.DOCUMENTS, 8)
    stored.replay(parts, str(tmp_path / "run"), lambda r: stored.sync_changed(r, table, str(tmp_path / "audit")))
    want = spark.createDataFrame([], stored.DOCUMENTS)
    for part in parts:
        want = jobs.apply_changes(want.drop("change"), jobs.checked(part).filter("valid"))
    assert {tuple(r) for r in table.read().drop("change").collect()} == {tuple(r) for r in want.drop("change").collect()}
    audit = spark.read.schema(stored.AUDIT).parquet(*[str(tmp_path / f"audit/batch_{k}") for k in range(3)])
    assert audit.filter("action = 'rejected'").count() == sum(r["event"] == "renamed" or (r["event"] != "deleted" and len(r["content"]) < 50) for r in rows)
    assert audit.select("batch").distinct().count() == 3


def test_deliveries_keep_one_state_for_a_bucket_of_keys(spark, tmp_path):
    """600 keys in 4 buckets: 4 states and 4 timers at most, and no key's time is lost between batches."""
    at = lambda hours: F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {hours} HOURS")
    keys = spark.range(600).select(F.concat(F.lit("k\n"), "id").alias("idempotency_key"), (F.col("id") * 10).alias("n"))
    part = lambda k, hours: keys.select("idempotency_key", (F.col("n") + k).alias("delivery_id"), at(hours).alias("at"))
    states, taken = [], {}
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, rows in enumerate([part(0, 0), part(1, 23), part(2, 25).unionByName(part(3, 26)), part(4, 52)]):
            rows.write.mode("append").parquet(f"{tmp_path}/in")
            stream = stored.deliveries(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), buckets=4)
            run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start()
            run.awaitTermination()
            states += [s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]]
    finally:
        spark.conf.set(name, before)
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        taken.setdefault(r.delivery_id % 10, set()).add(r.taken)
    assert taken == {0: {True}, 1: {False}, 2: {True}, 3: {False}, 4: {True}}
    assert 0 < max(states) <= 4 * 3
