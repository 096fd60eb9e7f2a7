"""What the searches over vectors share: valid rows, and one object for all rows of equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that rows of one vector are dealt over before they meet.
PARTS = 64


def clean_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components, as doubles; null and empty vectors and null keys go."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.filter(F.col(key).isNotNull() & (F.size(vector) > 0) & finite).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def objects(rows: DataFrame, keep: int) -> DataFrame:
    """(id, v, ids): distinct vectors, named by their smallest id, with their ``keep`` smallest ids.

    A vector that a large share of all rows have is cut down in parts before its rows meet.
    """
    first = Window.partitionBy("v", "part").orderBy("id")
    least = rows.withColumn("part", F.pmod(F.hash("id"), F.lit(PARTS))).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= keep)
    return least.groupBy("v").agg(F.min("id").alias("id"), F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids")).select("id", "v", "ids")


def seekers(rows: DataFrame, is_query: Column, members: DataFrame) -> DataFrame:
    """(query_id, object): each query with the object of its vector."""
    return rows.filter(is_query).join(members.select("v", F.col("id").alias("object")), "v").select(F.col("id").alias("query_id"), "object")


def answer(asked: DataFrame, best: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) from the best objects of each asked object: (q, c, score)."""
    given = asked.join(best.withColumnRenamed("q", "object"), "object").join(members.select(F.col("id").alias("c"), "ids"), "c")
    flat = given.select("query_id", "score", F.explode("ids").alias("id")).filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return flat.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def matrix(batch: pa.RecordBatch, width: int, ids: str = "id", vector: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """A batch's ids and vectors; shorter vectors are filled with zeros."""
    column = batch.column(batch.schema.get_field_index(vector))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < np.asarray(lengths)[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return batch.column(batch.schema.get_field_index(ids)).to_numpy(zero_copy_only=False).astype(np.int64), out
