"""Rows over all tasks before work that costs much for each row: a small file is one task, whatever it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tasks(spark: SparkSession) -> int:
    """As many as a shuffle has, but two for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by a hash of columns. The number is given, for adaptive execution would put them together
    again by their bytes, which say little of the work."""
    return df.repartition(tasks(df.sparkSession), *by)
