"""A table whose rows lie in folders by hash of their key, so that a batch reads and writes the folders of its keys only."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder's name below what spark.checkpoint.dir names; only a local session may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        context.setCheckpointDir("/tmp/verimill-scratch")
    return f"{context.getCheckpointDir()}/stored-{uuid4().hex}"


@dataclass(frozen=True)
class Buckets:
    """Rows under `path`, in batch=<number>/bucket=<number>; a bucket's rows are those of its latest committed batch.

    A batch is committed by the mark that Spark's writer leaves at its end. One that was broken off has no mark, is not read, and is written
    over by its repetition; a repeated batch starts from the tables before it. So replaying a batch leads to the same table. Replaced folders
    stay until clean() is called, for readers that still use them. Use some hundred MB a bucket: `count` follows from the table's size.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    count: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def _folders(self, below: str, name: str) -> list[tuple[int, str]]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(below)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.listStatus(at) if fs.exists(at) else []
        return [(int(f.getPath().getName().split("=")[1]), f.getPath().toString()) for f in found if f.getPath().getName().startswith(f"{name}=")]

    def _marked(self, folder: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def folders(self, before: int | None = None) -> dict[int, tuple[int, str]]:
        """For each bucket the batch that wrote it last, of those below `before`, and its folder. Names only; as many as there are buckets."""
        out: dict[int, tuple[int, str]] = {}
        for batch, folder in sorted(self._folders(self.path, "batch")):
            if (before is None or batch < before) and self._marked(folder):
                out |= {b: (batch, at) for b, at in self._folders(folder, "bucket")}
        return out

    def read(self, only: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The table, or the rows of some of its buckets."""
        paths = [at for b, (_, at) in self.folders(before).items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of the keys of some rows: at most `count` numbers reach the driver."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def write(self, batch: int, rows: DataFrame) -> None:
        """Rows, whole buckets of them, as batch `batch`. The keys' hash deals them, so a bucket is written by one task to one file, unless
        spark.sql.files.maxRecordsPerFile parts it."""
        placed = rows.withColumn("bucket", self.bucket()).repartition(F.col("bucket"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")

    def batch(self, batch: int) -> DataFrame:
        """What a batch wrote, its extra columns too."""
        return self.spark.read.parquet(f"{self.path}/batch={batch}")

    def clean(self) -> list[str]:
        """Deletes folders that a later batch replaced, but for the newest batch's own; the names of what went."""
        now = {at for _, at in self.folders().values()}
        gone = []
        for _, folder in sorted(self._folders(self.path, "batch"))[:-1]:
            for _, at in self._folders(folder, "bucket"):
                if at not in now and self._marked(folder):
                    p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
                    gone.append(at)
        return gone
