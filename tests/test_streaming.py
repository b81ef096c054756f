"""Streams give what their batch twins give."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from verimill.operators import governance
from verimill.streaming import admission, jobs


def events(n, seed=1):
    rng = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        kind = rng.choice(["created", "updated", "updated", "deleted", "renamed"])
        out.append({"event": kind, "source": "s", "source_object_id": str(rng.randrange(8)), "title": None, "content": None if kind == "deleted" else rng.choice(["x" * 60, "y" * 70, "short"]), "metadata": {}, "idempotency_key": f"k{i}", "at": (at + datetime.timedelta(minutes=i)).isoformat()})
    return out


def land(path, rows, files):
    path.mkdir()
    size = -(-len(rows) // files)
    for k in range(files):
        file = path / f"{k:03}.json"
        file.write_text("\n".join(map(json.dumps, rows[k * size : (k + 1) * size])))
        os.utime(file, (1_700_000_000 + 10 * k,) * 2)  # the order in which they are read


def drain(stream, mode, name, spark, **options):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).options(**options).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


CURRENT = "source string, source_object_id string, content string, content_hash string, version long, status string"


def test_upsert_stream(spark, tmp_path):
    rows = events(60)
    land(tmp_path / "in", rows, 6)
    state = {"at": None}

    def load():
        return spark.read.parquet(state["at"]) if state["at"] else spark.createDataFrame([], CURRENT)

    def store(df, batch):
        path = str(tmp_path / f"table-{batch}")
        df.drop("change").write.mode("overwrite").parquet(path)
        state["at"] = path

    audit = []
    q = jobs.sync(jobs.read_events(spark, str(tmp_path / "in"), 1), load, store, lambda df: audit.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for r in rows:
        if r["event"] == "renamed" or (r["event"] != "deleted" and len(r["content"]) < 50):
            continue
        k = r["source_object_id"]
        if r["event"] == "deleted":
            if k in want:
                want[k] = (*want[k][:1], want[k][1], "deleted")
        else:
            old = want.get(k)
            want[k] = (r["content"], (old[1] if old else 0) + (0 if old and old[0] == r["content"] and old[2] != "deleted" else 1), "indexed")
    got = {r.source_object_id: (r.content, r.status) for r in load().collect()}
    assert got == {k: (c, s) for k, (c, _, s) in want.items()}
    assert {a.action for a in audit} >= {"created", "deleted", "rejected"}


def test_idempotent_delivery(spark, tmp_path):
    rows = events(20)
    land(tmp_path / "in", rows + rows, 4)
    out = drain(jobs.once(jobs.read_events(spark, str(tmp_path / "in"), 1)), "append", "once", spark)
    assert out.count() == 20


def usage(spark, tmp_path, files=4):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted(({"tenant_id": rng.randrange(3), "request_id": i, "event_type": rng.choice("ab"), "quantity": rng.randrange(5), "latency_ms": float(rng.randrange(100)), "document_id": rng.randrange(4), "rating": rng.choice([-1, 0, 1]), "created_at": (start + datetime.timedelta(seconds=rng.randrange(5 * 86400))).isoformat()} for i in range(400)), key=lambda r: r["created_at"])
    land(tmp_path / "in", rows, files)
    schema = "tenant_id long, request_id long, event_type string, quantity long, latency_ms double, document_id long, rating long, created_at timestamp"
    path = str(tmp_path / "in")
    return spark.read.schema(schema).json(path), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def test_usage_windows(spark, tmp_path):
    batch, stream = usage(spark, tmp_path)
    got = {tuple(r) for r in drain(jobs.usage_windows(stream), "append", "windows", spark).collect()}
    whole = {tuple(r) for r in jobs.usage_windows(batch).collect()}
    assert got <= whole
    last = batch.agg(F.max("created_at")).first()[0] - datetime.timedelta(days=1)
    assert {r for r in whole if r[0] + datetime.timedelta(days=1) <= last} == got
    assert got


def test_latency_windows(spark, tmp_path):
    batch, stream = usage(spark, tmp_path)
    got = {(r.start, r.n) for r in drain(jobs.latency_windows(stream), "append", "latency", spark).collect()}
    assert got and got <= {(r.start, r.n) for r in jobs.latency_windows(batch).collect()}


def test_running_boost(spark, tmp_path):
    batch, stream = usage(spark, tmp_path)
    got = drain(jobs.running_boost(stream), "complete", "boost", spark).collect()
    assert {(r.document_id, round(r.boost, 9)) for r in got} == {(r.document_id, round(r.boost, 9)) for r in jobs.running_boost(batch).collect()}


def test_admission_stream_is_the_batch(spark, tmp_path):
    batch, stream = usage(spark, tmp_path)
    shape = lambda d: d.select("tenant_id", "request_id", F.col("created_at").alias("at"))
    want = governance.admitted(shape(batch).withColumn("at", F.col("at").cast("timestamp_ntz")), 3, 7200)
    got = drain(admission.admission(shape(stream), 3, 7200), "append", "admitted", spark)
    accepted = {r.request_id for r in got.filter("accepted").collect()}
    assert accepted == {r.request_id for r in want.filter("accepted").collect()}
    assert got.count() == 400 and 0 < len(accepted) < 400


@pytest.mark.parametrize("times,limit,want", [([0, 1, 2, 3, 4], 5, [True] * 5), ([0, 1, 2, 3], 3, [True, True, True, False]), ([0, 1, 95], 2, [True, True, True]), ([0, 30, 59, 61], 2, [True, True, False, True])])
def test_admit(times, limit, want):
    assert admission.admit([float(t) for t in times], [], limit, 60)[0] == want


def test_stream_gate(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "", "t"), (2, "x" * 60, "t"), (3, "short text here", None)], "document_id long, text string, title string").write.parquet(path)
    batch = spark.read.parquet(path)
    out = drain(jobs.gate(spark.readStream.schema(batch.schema).parquet(path)), "append", "gate", spark)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in jobs.gate(batch).collect()}
    assert {r.document_id: r.review_status for r in out.collect()} == {1: "quarantined", 2: "published", 3: "published_with_warnings"}
