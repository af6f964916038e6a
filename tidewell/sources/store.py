"""Tables at rest: recordings by device and day, and small tables with revisions.

A day of a device is a partition. Finished days are written with dynamic partition overwrite, so a late or corrected day replaces that day alone; a window
scan prunes by day and then clips. Labels and settings are small tables whose every change is a new revision; a writer names the revision
it has seen, and loses if another one came first.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv
from tidewell.operators.intervals import E, S
from tidewell.sources.adapter import DAY


def write_days(spans: DataFrame, path: str) -> None:
    """Spans cut at midnight, one file a device and day, sorted by start; days that are there are replaced."""
    rows = iv.split(spans, DAY, "_d").withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("_d").cast("int"))).drop("_d")
    rows.repartition("device", "day").sortWithinPartitions("device", "day", S).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device", "day").parquet(path)


def read_window(spark: SparkSession, path: str, start_ms: int, end_ms: int, device: int | None = None) -> DataFrame:
    """What was recorded in a window; only its days are read, and a value held when it opens is kept."""
    rows = spark.read.parquet(path)
    day = lambda ms: F.date_add(F.lit("1970-01-01").cast("date"), ms // DAY)
    rows = rows.where((F.col("day") >= day(start_ms)) & (F.col("day") <= day(end_ms)))
    if device is not None:
        rows = rows.where(F.col("device") == device)
    return iv.clip(rows, start_ms, end_ms).drop("day")


def days(spark: SparkSession, path: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Recorded days, the newest first, with rows and covered time."""
    rows = spark.read.parquet(path).groupBy("device", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(E) - F.col(S)).alias("ms"))
    return rows.orderBy(F.desc("day"), "device").offset(offset).limit(limit)


def clear_device(spark: SparkSession, path: str, device: int) -> None:
    """Takes all days of a device away."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/device={device}")
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: How long a claim on a revision holds; a rename takes far less.
CLAIM_MS = 600_000


class Conflict(RuntimeError):
    """Another writer came first."""


class Revisions:
    """A small table kept as revisions in a folder that any file system of Hadoop's reaches."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The current revision; 0 is the empty table."""
        if not self._fs.exists(self._path(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return max([int(n[4:]) for n in names if n.startswith("rev=")], default=0)

    def read(self, revision: int | None = None) -> DataFrame:
        revision = self.latest() if revision is None else revision
        if not revision:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rev={revision}")

    def commit(self, rows: DataFrame, seen: int) -> int:
        """Writes rows as the revision after `seen`, or raises Conflict."""
        if self.latest() != seen:
            raise Conflict(f"revision {seen} is no longer the latest")
        staged = self._path(f"{self.path}/_staged-{uuid.uuid4().hex}")
        columns = self.spark.createDataFrame([], self.schema).schema
        rows.select(*[F.col(c.name).cast(c.dataType) for c in columns]).write.parquet(str(staged))
        claim, target = self._path(f"{self.path}/_claim-{seen + 1}"), self._path(f"{self.path}/rev={seen + 1}")
        claimed = False
        try:
            claimed = self._claimed(claim)
            if not claimed or self._fs.exists(target) or not self._fs.rename(staged, target):
                raise Conflict(f"revision {seen + 1} came first")
        finally:
            if claimed:
                self._fs.delete(claim, False)
            if self._fs.exists(staged):
                self._fs.delete(staged, True)
        return seen + 1

    def _claimed(self, claim) -> bool:
        """Whether this writer alone may make the revision: a file that is created only where there is none. One left by a writer that was lost goes after CLAIM_MS."""
        if self._fs.exists(claim) and time.time() * 1000 - self._fs.getFileStatus(claim).getModificationTime() > CLAIM_MS:
            self._fs.delete(claim, False)
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError as e:
            if self._fs.exists(claim):
                return False
            raise e
        return True
