"""Helpers that several operators share: scratch storage, chunking of long inputs, text columns."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space; words are runs of anything else.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a session names none, as in tests, a folder under the warehouse is set instead.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not conf:
        found = jsc.getCheckpointDir()
        if found.isDefined():
            return found.get().rsplit("/", 1)[0]
        conf = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shared-scratch")
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table or for files, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, *, partition_by: list[str] | None = None, codec: str = "zstd", page_rows: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut, and a lost executor costs no rework of it.

    Rows of megabytes need ``page_rows``, after how many the writer looks whether a page is full, and are not kept twice
    in dictionaries.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", codec)
    if page_rows:
        writer = writer.option("parquet.page.size.row.check.min", page_rows).option("parquet.block.size.row.check.min", page_rows).option("parquet.enable.dictionary", "false")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _written.append(path)
    return out


#: Scratch tables of this session that are still there.
_written: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table, or a folder of one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` has written and that nothing will read again."""
    for table in tables:
        delete(table.sparkSession, table.scratch_path)


def cleanup(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the scratch tables written since (a length of ``written()``), but for ``keep``.

    Call it once the results that read them are stored: an operator's result is lazy and may still need them.
    """
    kept = {t.scratch_path for t in keep}
    for path in [p for p in _written[since:] if p not in kept]:
        delete(spark, path)


def written() -> int:
    """How many scratch tables there are."""
    return len(_written)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def ascii_lower(column: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, LOWER)


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo: the fold that a contract names."""
    return F.crc32(column.cast("string")) % F.lit(modulus)


def top_counts(counted: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the highest counts, ``most`` of them at most: all from a step of a histogram of their logarithms on.

    The driver gets the histogram only, a few hundred rows. Read ``counted`` from storage: it is read twice.
    """
    step = F.floor(F.log2(column) * 16)
    room, lowest = most, None
    for at, size in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if size > room:
            break
        room, lowest = room - size, at
    return counted.filter(step >= F.lit(lowest).cast("long"))


def broadcast_up_to(rows: DataFrame, most: int = 1 << 17) -> DataFrame:
    """Rows of a few fixed-width columns, to be broadcast if there are no more than ``most``; else they join by merge.

    Read ``rows`` from storage: they are counted first.
    """
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


def free_name(name: str, taken: list[str]) -> str:
    """A column name that no column in ``taken`` has, whatever the case of its letters."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def numbered(columns: list[str]) -> tuple[list[Column], list[Column]]:
    """Columns under numbers instead of names, which clash with no name of an operator's own; and the way back."""
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
