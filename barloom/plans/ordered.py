"""One long ordered series without one long task: ranges of the order are worked on by themselves, and what a range needs
of those before it (a number of rows, last values) comes from a table of one row for each range.

The tables of ranges have as many rows as the shuffle has partitions, which is what bounds their windows and broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.shared import pinned


def _ranged(df: DataFrame, order: str) -> DataFrame:
    return pinned(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))


def numbered_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """The frame with `name`, the number of the row in `order`, from 0."""
    rows = _ranged(df, order)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return rows.withColumn(name, own).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before") - 1).drop("_range", "_before")


def carried_forward(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """The frame in which a null of the given columns is the last value before it in `order`."""
    rows = _ranged(df, order)
    ends = rows.groupBy("_range").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_range", *(F.last(c, ignorenulls=True).over(past).alias(f"_before_{k}") for k, c in enumerate(columns)))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({c: F.last(c, ignorenulls=True).over(own) for c in columns}).join(F.broadcast(before), "_range")
    return out.withColumns({c: F.coalesce(c, f"_before_{k}") for k, c in enumerate(columns)}).select(df.columns)


def in_order(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """A key's rows together and in order, for a pass in Python. The number of partitions is given: rows of many symbols may
    be few bytes, which would be merged into one task, but they are much work there."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)
