"""Density of positions on an image grid, as counts and as a smoothed surface."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_size(width: int, height: int) -> tuple[int, int]:
    return max(32, width // 40), max(24, height // 40)


def histogram(rows: DataFrame, width: int, height: int, x: str = "ground_x_smooth", y: str = "ground_y_smooth") -> DataFrame:
    """bx, by, n of the non-empty cells; points outside are left out, the last cell of either axis includes its far edge."""
    nx, ny = grid_size(width, height)
    # a sum of flags and not a filter, which would compute the smoothed places once more below
    inside = F.col(x).between(0, width) & F.col(y).between(0, height)
    bx, by = F.least(F.floor(F.col(x) / float(width) * nx), F.lit(nx - 1)), F.least(F.floor(F.col(y) / float(height) * ny), F.lit(ny - 1))
    cells = rows.select(F.coalesce(inside, F.lit(False)).alias("inside"), bx.cast("int").alias("bx"), by.cast("int").alias("by"))
    cells = cells.select(F.when(F.col("inside"), F.col("bx")).alias("bx"), F.when(F.col("inside"), F.col("by")).alias("by"), F.col("inside").cast("long").alias("one"))
    return cells.groupBy("bx", "by").agg(F.sum("one").alias("n")).filter("n > 0")


def kernel(sigma: float = 2.0) -> list[float]:
    """A normalised Gaussian of the odd width that covers four sigmas on either side."""
    half = int(round(sigma * 4 * 2 + 1)) // 2
    taps = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [t / sum(taps) for t in taps]


def blur(cells: DataFrame, width: int, height: int, sigma: float = 2.0) -> DataFrame:
    """bx, by, density of every cell: rows, then columns, are convolved; the edge reflects without repeating its cell.

    The grid has a bounded number of cells, whatever the input.
    """
    nx, ny = grid_size(width, height)
    taps = kernel(sigma)
    half = len(taps) // 2
    spark = cells.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("bx"), F.floor(F.col("id") / nx).cast("int").alias("by"))
    dense = grid.join(cells, ["bx", "by"], "left").select("bx", "by", F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    weights = spark.createDataFrame([(k - half, t) for k, t in enumerate(taps)], "k int, weight double")

    def along(rows: DataFrame, axis: str, size: int) -> DataFrame:
        other = "by" if axis == "bx" else "bx"
        reads = grid.crossJoin(F.broadcast(weights)).withColumn("_at", F.abs(F.col(axis) + F.col("k")))
        reads = reads.withColumn("_at", F.when(F.col("_at") >= size, 2 * (size - 1) - F.col("_at")).otherwise(F.col("_at")))
        source = rows.select(F.col(axis).alias("_at"), F.col(other), "v")
        return reads.join(source, ["_at", other]).groupBy("bx", "by").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))

    return along(along(dense, "bx", nx), "by", ny).withColumnRenamed("v", "density")
