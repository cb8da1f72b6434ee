"""Coarse colour and scene-relative size of tracks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import box_area, finite
from ..functions.quantiles import exact_quantiles
from ..schema import require_columns
from ..storage import written

#: Fixed values of the data format: colour families in the order that ties fall to.
COLORS = ("black", "white", "silver_gray", "red", "orange", "yellow", "green", "blue", "purple")
SIZE_METHOD = "scene-relative median detector-box area"


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (0 to 179), saturation and value of integer channels."""
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    d = high - low
    s = F.when(high == 0, F.lit(0)).otherwise(F.round(d * 255.0 / F.greatest(high, F.lit(1))).cast("int"))
    safe = F.greatest(d, F.lit(1)).cast("double")
    degrees = F.when(d == 0, 0.0).when(high == r, (g - b) * 60.0 / safe).when(high == g, (b - r) * 60.0 / safe + 120.0).otherwise((r - g) * 60.0 / safe + 240.0)
    h = F.round(F.when(degrees < 0, degrees + 360.0).otherwise(degrees) / 2).cast("int")
    return F.when(h == 180, F.lit(0)).otherwise(h), s, high


def color_family(h: Column, s: Column, v: Column) -> Column:
    """Dark is black, pale is white or gray, all else goes by hue."""
    # fixed values: limits of the families in 8-bit hue, saturation and value
    out = F.when(v < 48, "black").when((s < 45) & (v >= 205), "white").when(s < 45, "silver_gray").when((h < 10) | (h >= 170), "red")
    for limit, name in ((22, "orange"), (35, "yellow"), (85, "green"), (130, "blue")):
        out = out.when(h < limit, name)
    return out.otherwise("purple")


def classify_pixels(pixels: DataFrame) -> DataFrame:
    """h, s, v and color added to rows of b, g, r."""
    h, s, v = hsv(F.col("b"), F.col("g"), F.col("r"))
    return pixels.withColumns({"h": h, "s": s, "v": v}).withColumn("color", color_family(F.col("h"), F.col("s"), F.col("v")))


def pixel_vote(pixels: DataFrame, *keys: str) -> DataFrame:
    """The most frequent colour family of each key's pixels and its share; ties to the earlier family."""
    counts = classify_pixels(pixels).groupBy(*keys, "color").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, COLORS)), F.col("color"))
    return counts.groupBy(*keys).agg(F.max_by("color", F.struct("n", -rank)).alias("color"), (F.max("n") / F.sum("n")).alias("confidence"))


def sample_rows(raw: DataFrame, most: int = 7, least_confidence: float = 0.2) -> DataFrame:
    """Up to most rows of each track, evenly spaced by frame over its confident rows, ends included."""
    require_columns(raw, {"frame", "track_id", "confidence", "x1", "y1", "x2", "y2"}, "raw tracks")
    if most < 1:
        raise ValueError("at least one sample must be allowed")
    order = ["frame", "seq"] if "seq" in raw.columns else ["frame"]
    rows = raw.filter(F.col("confidence") >= least_confidence)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("track_id")), "_i": F.row_number().over(Window.partitionBy("track_id").orderBy(*order)) - 1})
    m = F.least(F.lit(most), F.col("_n")).cast("int")
    # row i is sample j for j about i * (m - 1) / (n - 1); rounding to even as the samples themselves
    step = F.when(m > 1, (F.col("_n") - 1) / (m - 1)).otherwise(F.lit(0.0))
    places = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.rint(j * step).cast("long"))
    return rows.filter(F.array_contains(places, F.col("_i").cast("long"))).drop("_n", "_i")


def color_vote(votes: DataFrame, tracks: DataFrame) -> DataFrame:
    """dominant_color, its share of the weights (at least 0.05 each) and the number of votes of every track.

    votes has track_id, frame, color and confidence; unknown ones don't count; ties go
    to the colour seen first.  Tracks without votes are unknown.  Shares are added as
    decimals, whose sum has no order, and sums are compared to nine places, since a third
    has no decimal; a ratio is rounded from twelve.
    """
    known = votes.filter("color <> 'unknown'")
    weight = F.greatest(F.lit(0.05), finite(F.col("confidence"))).cast("decimal(38,18)")
    totals = known.groupBy("track_id", "color").agg(F.sum(weight).alias("weight"), F.min("frame").alias("first"), F.count(F.lit(1)).alias("n"))
    # places are cut where no sum of shares ends: sums of 1/1024 lie in the middle of two
    place = F.round(F.col("weight") + F.lit(Decimal("0.000000000381966")), 9)
    won = totals.groupBy("track_id").agg(F.max_by("color", F.struct(place, -F.col("first"))).alias("c"), F.max("weight").cast("double").alias("w"), F.sum("weight").cast("double").alias("all"), F.sum("n").alias("n"))
    rows = tracks.select("track_id").distinct().join(won, "track_id", "left")
    return rows.select("track_id", F.coalesce("c", F.lit("unknown")).alias("dominant_color"), F.coalesce(F.round(F.round(F.col("w") / F.col("all"), 12), 4), F.lit(0.0)).alias("color_confidence"), F.coalesce("n", F.lit(0)).cast("long").alias("color_samples"))


def relative_sizes(raw: DataFrame) -> DataFrame:
    """Median box area of each track and a class by it: cars by thirds of all cars' medians, which are computed at once, others by their class."""
    require_columns(raw, {"track_id", "class_name", "x1", "y1", "x2", "y2"}, "raw tracks")
    rows = raw.groupBy("track_id").agg(F.mode("class_name", True).alias("class_name"), F.percentile(box_area(), F.lit(0.5)).alias("median_box_area_px2"))
    rows = written(rows, "sizes")
    cars = rows.filter("class_name = 'car'")
    q = exact_quantiles(cars, {str(p): ("median_box_area_px2", p) for p in (0.33, 0.5, 0.67)})
    few = cars.limit(3).count() < 3
    low, high = (F.lit(q["0.5" if few else k]).cast("double") for k in ("0.33", "0.67"))
    # fixed values: names of the size classes
    name, area = F.col("class_name"), F.col("median_box_area_px2")
    size = F.when(name == "motorcycle", "two_wheeler").when(name == "bus", "bus").when(name == "truck", "heavy_vehicle").when(name != "car", name)
    size = size.when(area < low, "small_passenger_vehicle").when(area > high, "large_passenger_vehicle").otherwise("medium_passenger_vehicle")
    return rows.select("track_id", "class_name", "median_box_area_px2", size.alias("relative_size_class"), F.lit(SIZE_METHOD).alias("size_method"))


def crop_window(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, inset: float = 0.22) -> Column:
    """The part of a box that colours are read from, as a struct; null for boxes of fewer than 4 pixels a side and for empty crops."""

    def whole(v: Column) -> Column:
        return F.bround(v).cast("int")

    a, b = (F.greatest(F.lit(0), F.least(whole(v), F.lit(m - 1))) for v, m in ((x1, width), (y1, height)))
    c, d = (F.least(F.greatest(whole(v), lo + 1), F.lit(m)) for v, lo, m in ((x2, a, width), (y2, b, height)))
    dx, dy = (F.greatest(F.lit(1), whole(n * inset)) for n in (c - a, d - b))
    good = (c - a >= 4) & (d - b >= 4) & (c - a > dx * 2) & (d - b > dy * 2)
    return F.when(good, F.struct((a + dx).alias("x1"), (b + dy).alias("y1"), (c - dx).alias("x2"), (d - dy).alias("y2")))


def in_ellipse(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether a pixel of a w by h crop lies in its filled inner ellipse."""
    cx, cy = F.floor(w / 2), F.floor(h / 2)
    a, b = F.greatest(F.lit(1), cx - 1), F.greatest(F.lit(1), cy - 1)
    return ((x - cx) / a) * ((x - cx) / a) + ((y - cy) / b) * ((y - cy) / b) <= 1
