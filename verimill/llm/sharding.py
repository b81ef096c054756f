"""Sharding by a two-pass external shuffle: seeded scatter into memory-sized buckets, then Fisher-Yates inside each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

SHARDS = 8
SEED = 20_240_731
#: Rows and bytes of a bucket at most: what one task holds at a time while it shuffles.
BUCKET_ROWS = 8192
BUCKET_BYTES = 16_000_000
#: Equal rows that fill more than this share of a bucket are spread.
SPREAD = 16
#: Copies of a row that one task makes at a time.
COPIES = 4096
#: Tasks at most: where there are more buckets, some follow each other in a task. Buckets that are counted together.
MOST_TASKS, STRIDE = 20_000, 4096
#: Places that rows are dealt to where the keys of spread rows are too many to broadcast.
PLACES = 16


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: those of its texts, and 8 for each other column."""
    long = [F.coalesce(F.octet_length(F.col(f.name).cast("string") if f.dataType.typeName() != "binary" else F.col(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    return sum(long, F.lit(8 * len(df.columns))).cast("long")


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with shard (int) and slot (long, from 0 without gaps in each shard); shards differ by one row at most.

    Pass 1 scatters whole rows over buckets by a seeded hash of the row. Pass 2 puts each bucket into a fixed order and permutes it with
    Spark's shuffle(), a seeded Fisher-Yates; buckets in turn then make one permutation of all rows, which is dealt to the shards like cards.
    The number of buckets follows the rows and bytes of the input, so that a bucket stays as large as it is. Equal rows that would fill
    much of a bucket are told apart by an occurrence number, which the hash takes too; being equal, they are made from one of them and their
    count. Repeated rows are kept, each with a place of its own; columns named shard or slot are replaced, those of maps can't be hashed; nulls are values like others; an empty table gives an empty one. Seed, rows
    and number of buckets decide the order.
    """
    df = df.drop("shard", "slot")
    columns = df.columns
    row, of = F.struct(*columns), F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])
    hashed = df.select(row.alias("__row"), of.alias("__hash"), row_bytes(df).alias("__bytes"))
    total = hashed.agg(F.count("*").alias("n"), F.coalesce(F.sum("__bytes"), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total.n // bucket_rows), -(-total.b // bucket_bytes))
    hot = hashed.groupBy("__hash").agg(F.count("*").alias("__n"), F.sum("__bytes").alias("__b"))
    hot = cut(hot.filter((F.col("__n") > max(1, bucket_rows // SPREAD)) | (F.col("__n") > 1) & (F.col("__b") > bucket_bytes // SPREAD)).select(F.col("__hash").alias("__is")), "hot")
    # at most SPREAD of them for each bucket's rows and for its bytes: broadcast if they are few, else copied to the places their rows are dealt to
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        few, on = F.broadcast(hot), F.col("__hash") == F.col("__is")
    else:
        few = hot.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
        hashed, on = hashed.withColumn("__at", F.pmod(F.monotonically_increasing_id(), F.lit(PLACES)).cast("int")), (F.col("__hash") == F.col("__is")) & (F.col("__at") == F.col("__place"))
    plain = hashed.join(few, on, "left_anti").select("__row", F.pmod("__hash", F.lit(buckets)).alias("__bucket"))
    equal = hashed.join(few, on, "left_semi").groupBy("__row").agg(F.first("__hash").alias("__hash"), F.count("*").alias("__n"))
    parts = equal.select("__row", "__hash", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))).alias("__from")).repartition("__hash", "__from")
    copies = parts.select("__row", "__hash", F.explode(F.sequence("__from", F.least(F.col("__from") + COPIES, F.col("__n")) - 1)).alias("__copy"))
    spread = copies.select("__row", F.pmod(F.xxhash64("__hash", "__copy"), F.lit(buckets)).alias("__bucket"))
    scattered = cut(plain.unionByName(spread), "scattered")
    counts = scattered.groupBy("__bucket").agg(F.count("*").alias("__n"))
    first = offsets(counts.withColumnRenamed("__bucket", "__of"))
    dealt = scattered.repartition(min(buckets, MOST_TASKS), "__bucket").sortWithinPartitions("__bucket").groupBy("__bucket").agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
    shuffled = dealt.select("__bucket", F.shuffle("__rows", F.lit(seed)).alias("__rows"))
    placed = shuffled.join(F.broadcast(first) if buckets <= BROADCAST_ROWS else first, F.col("__bucket") == F.col("__of")).select("__first", F.posexplode("__rows").alias("__pos", "__row"))
    at = F.col("__first") + F.col("__pos")
    return placed.select("__row.*", (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def offsets(counts: DataFrame) -> DataFrame:
    """(__of, __first): rows in all buckets before each. Sums over strides of STRIDE buckets first, so that no task sees more than that many, or
    one row a stride."""
    stride = F.floor(F.col("__of") / STRIDE)
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = counts.withColumn("__stride", stride)
    before = inner.groupBy("__stride").agg(F.sum("__n").alias("__n")).select(F.col("__stride").alias("__s"), earlier(Window.orderBy("__stride")).alias("__before"))
    inner = inner.withColumn("__inside", earlier(Window.partitionBy("__stride").orderBy("__of")))
    return inner.join(before, F.col("__stride") == F.col("__s")).select("__of", (F.col("__before") + F.col("__inside")).alias("__first"))


def op10_sharding(docs: DataFrame) -> DataFrame:
    """Whole documents are written to a folder for each shard; size and text_crc32 are those of the texts that are read back from it."""
    written = cut(shard(docs), "shards", "shard")
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return written.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
