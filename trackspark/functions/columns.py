"""Column builders shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SEGMENT = ("track_id", "segment_id")


def segment_window(order: str = "frame"):
    return Window.partitionBy(*SEGMENT).orderBy(order)


def middle(values: Column) -> Column:
    """Median of an array without nulls: the mean of its two middle elements, null if it is empty."""
    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2

    return let(F.sort_array(values), of)


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def round_exact(value: Column, places: int) -> Column:
    """A double rounded to decimal places by its binary value, exact ties to the even digit, as Python rounds.

    Rounding is monotone, so only a product that is a tie itself can hide the side of
    the true one.  There the product's error is taken, from the value in two parts whose
    products with a power of ten up to 10**6 are exact.
    """
    if not 0 <= places <= 6:
        raise ValueError("places must be from 0 to 6")
    scale = F.lit(float(10**places))
    value = value.cast("double")
    product = value * scale
    high = value.cast("float").cast("double")
    error = (high * scale - product) + (value - high) * scale
    near = F.rint(product)
    side = F.when(F.abs(product - near) < 0.5, near).when(error == 0, near).otherwise(product + F.signum(error) * 0.5)
    return F.when(F.abs(value) < 1e9, side / scale).otherwise(value)


def positive_part(value: Column) -> Column:
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def box_area() -> Column:
    return positive_part(F.col("x2") - F.col("x1")) * positive_part(F.col("y2") - F.col("y1"))


def heading(vx: Column, vy: Column) -> Column:
    """Degrees from 0 to 360 of a velocity; in image axes clockwise, in metric axes from east counter-clockwise."""
    return F.pmod(F.degrees(F.atan2(vy, vx)) + 360.0, F.lit(360.0))


def arc_between(start: Column, end: Column, fraction: Column) -> Column:
    """An angle on the shorter arc from start to end, not wrapped again."""
    return start + fraction * (F.pmod(end - start + 180.0, F.lit(360.0)) - 180.0)
