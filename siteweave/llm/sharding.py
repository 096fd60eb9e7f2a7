"""Sharding by extendible hashing, in DataFrame functions only.

A directory is indexed by a prefix of the key's hash bits. A bucket that exceeds the byte limit splits on its next
bit; others stay as they are. Only per-prefix byte sums are shuffled, and after the first level only rows of
buckets that are still too large are summed again.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import free_name, materialize, text_bytes

#: Bits of a key's hash; the row's own bits follow them and part rows of one key.
KEY_BITS = 60
#: Levels that one pass sums at once.
STEP = 12


def _hash_bits(column: Column) -> Column:
    """60 bits of the MD5 of a value as text, as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 15), 16, 2), KEY_BITS, "0")


def _leaves(sums: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Buckets of depth low..high that fit and whose parent does not: (prefix, depth, shard_bytes, shard_docs).

    ``sums`` has the bytes of each prefix of length ``high``. Buckets at ``high`` that are still too large are
    returned as well, for the next pass. All levels come from one small table: a row for each prefix, not for each row
    of data.
    """
    levels = (
        sums.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "prefix", "bytes", "docs")
        .groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("prefix"))
        .agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        .withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    )
    parents = levels.filter(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    split = levels.withColumn("parent", F.expr("substring(prefix, 1, depth - 1)")).join(parents, ["depth", "parent"], "left_semi")
    top = levels.filter(F.col("depth") == low)
    return (
        top.unionByName(split.drop("parent"))
        .filter(F.col("fits") | (F.col("depth") == high))
        .select("prefix", "depth", "shard_bytes", "shard_docs", "fits")
    )


def assign_shards(docs: DataFrame, limit_bytes: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Gives each row of ``docs`` a shard of at most ``limit_bytes`` bytes of text.

    Returns ``key``, ``n_bytes`` (0 for a null text), ``shard`` (the bucket's hash prefix; empty for a table that fits
    one shard), ``depth``, ``shard_bytes``, ``shard_docs`` and ``oversized`` (a single row larger than the limit: it
    has a shard of its own). Rows that share a key share all bits of its hash; if they do not fit together, bits of a
    hash of each row's position part them. Null keys hash as the text "null". Other columns are not read.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be at least 1")
    rows = docs.select(
        F.col(key),
        F.octet_length(text_bytes(text)).cast("long").alias("n_bytes"),
        F.concat(_hash_bits(F.coalesce(F.col(key).cast("string"), F.lit("null"))), _hash_bits(F.monotonically_increasing_id())).alias("bits"),
    )
    rows = materialize(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes"), F.count("*")).first()
    if not total[1]:
        return rows.select(key, "n_bytes", F.col("bits").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"), F.lit(False).alias("oversized"))
    low, high = 0, min(2 * KEY_BITS, ceil(log2(max(1, total[0] / limit_bytes))) + 6)
    rest, directory = rows, None
    while True:
        sums = rest.groupBy(F.substring("bits", 1, high).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        found = materialize(_leaves(sums, low, high, limit_bytes), "shard-directory")
        done = found.filter("fits") if high < 2 * KEY_BITS else found
        directory = done if directory is None else directory.unionByName(done)
        large = found.filter(~F.col("fits"))
        if high >= 2 * KEY_BITS or large.isEmpty():
            break
        rest = rest.join(large.select("prefix"), F.substring("bits", 1, high) == F.col("prefix"), "left_semi")
        low, high = high + 1, min(2 * KEY_BITS, high + STEP)
    # The directory is cut into a row for each prefix length in use, so that a row probes one equi-join.
    depths = [r[0] for r in directory.select("depth").distinct().orderBy("depth").collect()]
    probes = rows.withColumn("prefix", F.explode(F.array(*[F.substring("bits", 1, d) if d else F.lit("") for d in depths])))
    return probes.join(directory, "prefix").select(
        key, "n_bytes", F.col("prefix").alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit_bytes).alias("oversized")
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` as Parquet with one folder for each shard, and returns the directory table.

    Keys must be unique and not null here, because rows are matched to their shards by key. Folders are named ``shard``,
    with underscores ahead if ``docs`` has such a column.
    """
    shards = assign_shards(docs, limit_bytes, key=key, text=text)
    shards = materialize(shards, "shards")
    folder = free_name("shard", docs.columns)
    out = docs.join(shards.select(key, F.concat(F.lit("b"), "shard").alias(folder)), key)
    out.repartition(folder).write.partitionBy(folder).parquet(path)
    return shards.groupBy("shard").agg(F.max("depth").alias("depth"), F.max("shard_bytes").alias("shard_bytes"), F.max("shard_docs").alias("shard_docs"), F.max("oversized").alias("oversized"))


#: Production limit of the registered query: 1 MiB of text for each shard.
LIMIT = 1 << 20


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards of all documents."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), LIMIT)


ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), levels(doc_id, n_bytes, h, depth, shard_bytes, shard_docs) AS (
  SELECT doc_id, n_bytes, h, 0, (sum(n_bytes) OVER ())::BIGINT, count(*) OVER () FROM rows
  UNION ALL
  SELECT doc_id, n_bytes, h, depth + 1, (sum(n_bytes) OVER (PARTITION BY h >> (59 - depth)))::BIGINT, count(*) OVER (PARTITION BY h >> (59 - depth))
  FROM levels WHERE shard_bytes > {LIMIT} AND shard_docs > 1 AND depth < 60
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(h >> (60 - depth)), depth) END AS shard, depth::INTEGER AS depth, shard_bytes, shard_docs, shard_bytes > {LIMIT} AS oversized
FROM levels WHERE shard_bytes <= {LIMIT} OR shard_docs = 1
"""
