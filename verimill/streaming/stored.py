"""Streams into bucketed tables: documents with their audit trail, running sums, deliveries taken once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..sources.buckets import Buckets
from .jobs import apply_changes, checked

DOCUMENTS = "source string, source_object_id string, content string, content_hash string, version long, status string, change string"
AUDIT = "batch long, action string, resource_type string, resource_id string"


def sync_changed(events: DataFrame, table: Buckets, audit: str | None = None):
    """A writer that applies each batch of events to the buckets of its objects (table: keys source and source_object_id, schema DOCUMENTS).

    Rows are computed once, by the write of the touched buckets; the audit trail under `audit` is taken from what was written and from the
    refused events, a folder a batch, so that a repeated batch writes the same rows once.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = checked(df).persist()
        good = rows.filter("valid")
        before = table.read(table.touched(good), number).drop("change")
        table.write(number, apply_changes(before, good))
        if audit is not None:
            did = table.batch(number).filter("change IN ('created', 'updated', 'deleted')").select(F.col("change").alias("action"), F.lit("document").alias("resource_type"), F.col("source_object_id").alias("resource_id"))
            refused = rows.filter("NOT valid").select(F.lit("rejected").alias("action"), F.col("reason").alias("resource_type"), F.col("source_object_id").alias("resource_id"))
            did.unionByName(refused).select(F.lit(number).cast("long").alias("batch"), "*").write.mode("overwrite").parquet(f"{audit}/batch_{number}")
        rows.unpersist()

    return events.writeStream.foreachBatch(batch)


def keep_boosts(feedback: DataFrame, table: Buckets, weight: float = 0.1):
    """A writer of the running boost (key document_id, schema "document_id long, boost double"): a stateful sum in update mode, whose changed
    rows replace those of their buckets. Null ratings count as given but add nothing; documents that are null have a row of their own."""
    sums = feedback.groupBy("document_id").agg((F.coalesce(F.sum("rating"), F.lit(0)) / F.count("*") * weight).alias("boost"))

    def batch(df: DataFrame, number: int) -> None:
        rows = df.persist()
        old = table.read(table.touched(rows), number).withColumnsRenamed({"document_id": "__d", "boost": "__b"})
        kept = old.join(rows, F.col("__d").eqNullSafe(F.col("document_id")), "left_anti").select(F.col("__d").alias("document_id"), F.col("__b").alias("boost"))
        table.write(number, kept.unionByName(rows.select("document_id", "boost")))
        rows.unpersist()

    return sums.writeStream.outputMode("update").foreachBatch(batch)


class Once(StatefulProcessor):
    """Takes a key's first delivery, and the next behind `keep` seconds from it. A group is a bucket of keys, whose state is one value: the keys
    with the end of their time, in Arrow's format. A key goes once the watermark has reached that end, since rows up to there are dropped."""

    def __init__(self, keep: int) -> None:
        self.keep = keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("table", BinaryType()), StructField("timer", LongType())]))

    def load(self, watermark: int) -> dict[str, int]:
        """The keys whose time hasn't ended. Their timer, unless it has run out, is taken away."""
        if not self.held.exists():
            return {}
        stored, timer = self.held.get()
        if timer > watermark:
            self.handle.deleteTimer(timer)
        rows = pa.ipc.open_stream(stored).read_all()
        return {k: u for k, u in zip(rows["key"].to_pylist(), rows["until"].to_pylist(), strict=True) if u > watermark}

    def store(self, until: dict[str, int]) -> None:
        if not until:
            self.held.clear()
            return
        rows, out = pa.table({"key": pa.array(until.keys(), pa.string()), "until": pa.array(until.values(), pa.int64())}), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(rows)
        timer = min(until.values())
        self.held.update((out.getvalue().to_pybytes(), timer))
        self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["ms", "delivery_id"])
        until, taken = self.load(timerValues.getCurrentWatermarkInMs()), []
        for name, ms in zip(pdf["idempotency_key"].tolist(), pdf["ms"].tolist(), strict=True):
            taken.append(ms > until.get(name, ms - 1))
            if taken[-1]:
                until[name] = ms + self.keep
        self.store(until)
        yield pdf[["idempotency_key", "delivery_id"]].assign(taken=taken)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.store(self.load(timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, keep: int = 86400, delay: str = "1 hour", buckets: int = 256) -> DataFrame:
    """(idempotency_key, delivery_id, taken) of deliveries with a key: taken is the first of a key, and the first more than `keep` seconds
    behind one that was. Rows behind the watermark are dropped by Spark. Keys are dealt to `buckets` by their hash, each with one state, since
    the cost of a batch is that of the states it reads and writes; a stream keeps its number. Needs the RocksDB state store."""
    rows = events.select("idempotency_key", "delivery_id", "at").filter("idempotency_key IS NOT NULL").withWatermark("at", delay)
    shape = "idempotency_key string, delivery_id long, taken boolean"
    dealt = rows.withColumns({"ms": F.unix_millis("at"), "bucket": F.pmod(F.xxhash64("idempotency_key"), F.lit(buckets))})
    return dealt.groupBy("bucket").transformWithStateInPandas(Once(keep), shape, "Append", "EventTime")


def replay(parts: list[DataFrame], folder: str, job: Callable[[DataFrame], DataStreamWriter], every: str = "parquet") -> None:
    """Writes each part as files below `folder` and runs the job's writer on what is there until nothing is new. Each part is one batch of a
    stream that goes on from its checkpoint, as after a restart."""
    spark = parts[0].sparkSession
    for k, part in enumerate(parts):
        part.write.mode("append").format(every).save(f"{folder}/in")
        rows = spark.readStream.schema(part.schema).format(every).load(f"{folder}/in")
        job(rows).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start().awaitTermination()
