"""Rows dealt out to many tasks before work that costs far more than their bytes tell."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by a key in as many partitions as shuffles or the cluster have.

    The number is named, as adaptive execution puts partitions together by their compressed bytes: thousands of files that
    are alike would be one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)
