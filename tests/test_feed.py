"""The delta feed: complete runs only, nothing lost, restart behind a lost token; the claim table function."""

import json
import shutil

import pytest
from pyspark.errors import AnalysisException
from verimill.functions import claim_udtf
from verimill.sources import delta_feed
from verimill.sources.buckets import Buckets
from verimill.streaming import stored


def put(path, run, pages, whole=True):
    for k, items in enumerate(pages):
        at = path / f"run={run}" / f"page={k}"
        at.mkdir(parents=True)
        (at / "p.json").write_text("\n".join(json.dumps(x) if isinstance(x, dict) else x for x in items))
    if whole:
        (path / f"run={run}" / "_SUCCESS").touch()


def item(i, text="first", gone=False):
    return {"id": i, "deleted": gone, "content": None if gone else f"{text} content of an item, long enough to be taken in", "at": "2024-01-01T00:00:00+00:00"}


def test_feed(spark, tmp_path):
    feed = tmp_path / "feed"
    delta_feed.register(spark)
    table = Buckets(spark, str(tmp_path / "docs"), ("source", "source_object_id"), stored.DOCUMENTS, 4)

    def sync():
        rows = spark.readStream.format("delta_feed").option("path", str(feed)).load()
        q = stored.sync_changed(rows, table, str(tmp_path / "audit")).option("checkpointLocation", str(tmp_path / "cursor")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return {r.source_object_id: (r.version, r.status) for r in table.read().collect()}

    put(feed, 1, [[item(1), item(2)], [item(3), "{damaged"]])
    assert sync() == {"1": (1, "indexed"), "2": (1, "indexed"), "3": (1, "indexed")}
    refused = spark.read.schema(stored.AUDIT).parquet(str(tmp_path / "audit" / "batch_0")).filter("action = 'rejected'").collect()
    assert [r.resource_type for r in refused] == ["Unknown event"]
    put(feed, 2, [[item(1, "second")], []], whole=False)  # broken off
    assert sync()["1"] == (1, "indexed")
    shutil.rmtree(feed / "run=2")
    put(feed, 2, [[item(1, "second")], [item(2, gone=True)]])  # and run again
    assert sync() == {"1": (2, "indexed"), "2": (1, "deleted"), "3": (1, "indexed")}
    shutil.rmtree(feed / "run=1")
    shutil.rmtree(feed / "run=2")
    put(feed, 3, [[item(1, "second"), item(3)], [item(4)]])  # the whole feed anew
    put(feed, 4, [[item(3, "third")]])
    assert sync() == {"1": (2, "indexed"), "2": (1, "deleted"), "3": (2, "indexed"), "4": (1, "indexed")}
    batch = spark.read.format("delta_feed").option("path", str(feed)).option("source", "s").load()
    assert batch.count() == 4 and batch.rdd.getNumPartitions() == 3 and {r.source for r in batch.collect()} == {"s"}


CHUNK = "document_id long, chunk_id long, chunk_index long, chunk_text string"


def test_claim_function(spark):
    rows = [(1, 10, 0, "The house is red and the roof was grey"), (1, 11, 1, "My HOUSE IS, and house is RED in the evening sun"), (1, 12, 2, "short is bad"), (2, 20, 0, None), (2, 21, 1, "A house is red in every other town too")]
    chunks = spark.createDataFrame(rows, CHUNK)
    claim_udtf.register(spark, "said")
    got = spark.sql("SELECT document_id, chunk_id, subject, object_value, evidence FROM said(TABLE(SELECT * FROM {c}))", c=chunks).collect()
    assert {tuple(r)[:4] for r in got} == {(1, 10, "house", "red"), (1, 10, "roof", "grey"), (2, 21, "house", "red")}
    assert all(r.evidence == next(t for _, c, _, t in rows if c == r.chunk_id) for r in got)
    claim_udtf.register(spark, "loud", lambda text: [("x", "is", text[:3], 1.0)], least=1, most=1)
    assert {(r.document_id, r.object_value) for r in spark.sql("SELECT * FROM loud(TABLE(SELECT * FROM {c}))", c=chunks).collect()} == {(1, "The"), (2, "A h")}
    with pytest.raises(AnalysisException, match="needs the columns chunk_text"):
        spark.sql("SELECT * FROM said(TABLE(SELECT document_id, chunk_id, chunk_index FROM {c}))", c=chunks)
