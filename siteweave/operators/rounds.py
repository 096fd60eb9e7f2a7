"""Work that goes in rounds until nothing is new: each round appends folders, and nothing that was written is written again.

A run has one folder in the shared folder of the session, or one that the caller names. A table is a folder, a round of it
a folder inside. A round that is there as a whole is read, not made again, so a run that died goes on where it stopped
when it is started anew with the same folder and the same arguments.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts that a set of seen keys is dealt over.
BUCKETS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one under the warehouse is set only where a session names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().get().rsplit("/", 1)[0]


class Files:
    """The few calls to Hadoop's file system that folders of rounds and the store need."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.system(name).exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is not there."""
        system, path = self.system(folder), self.path(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def size(self, folder: str) -> int:
        """Bytes below a folder."""
        return self.system(folder).getContentSummary(self.path(folder)).getLength() if self.exists(folder) else 0

    def delete(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)


class Rounds:
    """Tables of rounds under one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, name: str = "rounds") -> None:
        self.spark, self.files = spark, Files(spark)
        self.folder = (folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}").rstrip("/")
        self.schemas: dict[str, T.StructType] = {}

    def add(self, table: str, turn: int, make: Callable[[], DataFrame], *, by: Column | None = None) -> DataFrame:
        """A round of a table: made by ``make`` unless it is there. ``by`` deals its rows over folders of buckets."""
        path = f"{self.folder}/{table}/round={turn:06d}"
        rows = make()
        kept = rows.schema
        if by is not None:
            rows = rows.withColumn("bucket", by).hint("rebalance", "bucket")
        if not self.files.exists(f"{path}/_SUCCESS"):
            writer = rows.write.mode("overwrite")
            (writer if by is None else writer.partitionBy("bucket")).parquet(path)
        self.schemas[table] = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept])
        return self.spark.read.schema(self.schemas[table]).parquet(path).select(*[F.col(f"`{f.name}`") for f in kept])

    def all(self, table: str, before: int | None = None) -> DataFrame:
        """All rounds of a table, or those before a round, with the column round, and bucket where rows are dealt."""
        turns = [n for n in self.files.names(f"{self.folder}/{table}") if before is None or int(n.partition("=")[2]) < before]
        schema = T.StructType([*self.schemas[table].fields, T.StructField("round", T.IntegerType())])
        paths = [f"{self.folder}/{table}/{n}" for n in turns]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.folder}/{table}").schema(schema).parquet(*paths)

    def drop(self) -> None:
        """Deletes the run's folder, once nothing reads its tables."""
        self.files.delete(self.folder)


class Seen:
    """Keys seen so far, dealt over buckets by hash: new keys are looked for in the buckets they belong to only."""

    def __init__(self, rounds: Rounds, keys: list[str], *, table: str = "seen", buckets: int = BUCKETS) -> None:
        self.rounds, self.keys, self.table, self.buckets = rounds, keys, table, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def fresh(self, turn: int, wanted: DataFrame) -> DataFrame:
        """Distinct keys of ``wanted`` that no earlier round had; they are seen from now on."""
        distinct = wanted.select(*self.keys).distinct()
        if turn == 0:
            return self.rounds.add(self.table, turn, lambda: distinct, by=self.bucket())

        def make() -> DataFrame:
            asked = distinct.withColumn("bucket", self.bucket())
            at = [r[0] for r in asked.select("bucket").distinct().collect()]  # numbers of buckets, BUCKETS at most
            old = self.rounds.all(self.table, turn).filter(F.col("bucket").isin(at)).select("bucket", *self.keys)
            return asked.join(old, ["bucket", *self.keys], "left_anti").select(*self.keys)

        return self.rounds.add(self.table, turn, make, by=self.bucket())
