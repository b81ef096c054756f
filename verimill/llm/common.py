"""What the operators of this subpackage share: words, scratch tables, salted lookups, Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the characters 9 to 13.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A given table, with only the named columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *cols)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and for blank texts."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, BLANK_RUN))).otherwise(0).cast("long")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, which spark.checkpoint.dir names. Only a local session may do without: it has a folder of its own."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        shared = "/tmp/verimill-scratch"
    return f"{shared.rstrip('/')}/verimill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    spark = df.sparkSession
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed, "false")
    spark.conf.set(freed, "true")  # what this write shuffled is of no use after it
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(freed, before)


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and is computed once."""
    path = scratch_dir(df.sparkSession, name)
    write_table(df, path, *partition_by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._verimill_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() wrote and nothing reads any more."""
    delete(df.sparkSession, df._verimill_path)


def salted_lookup(left: DataFrame, table: DataFrame, keys: list[str], spread: Column, salts: int = 32) -> DataFrame:
    """Left rows with the columns of `table`, which has one row for each value of `keys`.

    A hot key's rows go to `salts` places, to each of which the key's one row of `table` is copied. Null keys meet null keys.
    """
    a = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt_of"))
    on = a["__salt"] == b["__salt_of"]
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"__{k}"])
    return a.join(b, on, "left").drop("__salt", "__salt_of", *[f"__{k}" for k in keys])


#: A table of at most so many rows is broadcast.
BROADCAST_ROWS = 10_000


def lookup(left: DataFrame, table: DataFrame, keys: list[str], spread: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """salted_lookup(), but with `table` broadcast if its rows, counted first, are at most `most`: then `left` isn't shuffled at all."""
    table = cut(table, "lookup")
    if table.limit(most + 1).count() > most:
        return salted_lookup(left, table, keys, spread)
    b = F.broadcast(table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys]))
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(b[f"__{k}"])
    return left.join(b, on, "left").drop(*[f"__{k}" for k in keys])


def in_arrow(df: DataFrame, schema: str | object, work: Callable[[dict[str, list]], dict[str, list]], arrow_schema: pa.Schema, max_chars: int = 4_000_000, text: str = "text") -> DataFrame:
    """mapInArrow in slices of about `max_chars` characters of `text`. work() takes and returns columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, max_chars):
                out = work({name: piece.column(i).to_pylist() for i, name in enumerate(piece.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, max_chars: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about `max_chars` bytes of text, at least one row each."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64)
    group = np.cumsum(sizes) // max_chars
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))
