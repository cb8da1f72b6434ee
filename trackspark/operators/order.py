"""Orders over whole tables without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def first_appearance(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """key and place: keys numbered from 1 by their first row in the given order, ties to the smaller key.

    First rows are range-partitioned by that order and written with the number of their
    partition; a place is the number of keys in earlier partitions, a table of a row for each
    partition, and the place within its own.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    dealt = written(first.repartitionByRange("first", key).withColumn("part", F.spark_partition_id()), "first")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("first", key))
    return dealt.join(F.broadcast(before), "part").select(key, (F.col("before") + place).alias("place"))
