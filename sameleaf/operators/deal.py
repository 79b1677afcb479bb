"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deal(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """df by keys in as many partitions as size bytes (as Spark estimates its input) go into it, but no fewer than
    spark.sql.shuffle.partitions: a task's share doesn't grow with the input."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-n // size), 1 << 15)), *keys)
