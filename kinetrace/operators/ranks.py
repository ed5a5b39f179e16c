"""Places of distinct values in their order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import remove_at_exit, shared_dir


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """(column, number): places of the distinct values, from 0. Values are dealt out by ranges and written; each range counts its own from where the ranges before it end."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession)
    rows.select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id()).write.parquet(path)
    remove_at_exit(spark, path)
    values = spark.read.schema(f"{column} {rows.schema[column].dataType.simpleString()}, part int").parquet(path)
    before, offsets = 0, []
    for r in values.groupBy("part").count().orderBy("part").collect():  # a row per partition
        offsets.append((r["part"], before))
        before += r["count"]
    w = Window.partitionBy("part").orderBy(column)
    placed = values.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part")
    return placed.select(column, (F.col("before") + F.row_number().over(w) - 1).alias("number"))
