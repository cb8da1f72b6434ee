"""Image to ground: homographies from control points, and rays of a camera with telemetry."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import arc_between
from ..schema import TELEMETRY_FIELDS

#: Fixed values of the data format.
QUALITIES = ("surveyed", "map-derived", "assumption-based")
EARTH_RADIUS_M = 6_378_137.0
SENSOR_WIDTH_MM = 36.0


def solve_homography(image: np.ndarray, world: np.ndarray) -> np.ndarray:
    """Least-squares 3 x 3 projection of four or more image points to world points, in normalised coordinates."""

    def normal(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = points.mean(axis=0)
        scale = math.sqrt(2) / np.linalg.norm(points - centre, axis=1).mean()
        move = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
        return np.column_stack([points, np.ones(len(points))]) @ move.T, move

    a, ta = normal(image)
    b, tb = normal(world)
    zero = np.zeros_like(a)
    rows = np.concatenate([np.hstack([a, zero, -b[:, :1] * a]), np.hstack([zero, a, -b[:, 1:2] * a])])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2]


def convex_hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Corners counter-clockwise (in axes with y up), without collinear ones."""
    ordered = sorted({(float(x), float(y)) for x, y in points})

    def half(run: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(ordered) + half(ordered[::-1]) if len(ordered) > 2 else ordered


def polygon_area(corners: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1]))) / 2


@dataclass(frozen=True)
class Calibration:
    """A validated static projection."""

    matrix: np.ndarray
    image_points: np.ndarray
    world_points: np.ndarray
    reference: str
    quality: str
    rms_error_m: float
    max_error_m: float
    max_allowed_error_m: float

    @property
    def claim(self) -> str:
        return "measured metric coordinates" if self.quality == "surveyed" else "estimated metric coordinates"

    def report(self) -> dict[str, object]:
        # fixed values: the keys of the report's format
        return {
            "reference": self.reference,
            "quality": self.quality,
            "image_points_px": self.image_points.round(3).tolist(),
            "world_points_m": self.world_points.round(3).tolist(),
            "homography": self.matrix.tolist(),
            "rms_reprojection_error_m": round(self.rms_error_m, 6),
            "max_reprojection_error_m": round(self.max_error_m, 6),
            "max_allowed_error_m": self.max_allowed_error_m,
            "metric_claim": self.claim,
        }


def calibrate(image_points: object, world_points: object, reference: str, quality: str, max_error_m: float = 0.75) -> Calibration:
    """Check control points, solve for their projection and refuse one that misses a point by more than max_error_m."""
    image, world = np.asarray(image_points, float), np.asarray(world_points, float)
    if image.shape != world.shape or image.ndim != 2 or image.shape[1] != 2:
        raise ValueError("control points must be two lists of pairs of one length")
    if len(image) < 4:
        raise ValueError("four control points are needed at least")
    if not (np.isfinite(image).all() and np.isfinite(world).all()):
        raise ValueError("control points must be finite")
    if min(len(np.unique(image, axis=0)), len(np.unique(world, axis=0))) < 4:
        raise ValueError("four distinct control points are needed at least")
    if polygon_area(convex_hull(image)) < 100.0:
        raise ValueError("image control points cover too small an area")
    if polygon_area(convex_hull(world)) < 0.1:
        raise ValueError("world control points cover too small an area")
    reference, quality = str(reference or "").strip(), str(quality or "").strip().lower()
    if not reference:
        raise ValueError("a calibration must name its reference")
    if quality not in QUALITIES:
        raise ValueError(f"quality must be one of {sorted(QUALITIES)}")
    if not 0 < max_error_m < math.inf:
        raise ValueError("max_reprojection_error_m must be positive and finite")
    try:
        matrix = solve_homography(image, world)
    except np.linalg.LinAlgError:
        matrix = np.full((3, 3), np.nan)
    if not np.isfinite(matrix).all():
        raise ValueError("control points give no finite projection")
    made = np.column_stack([image, np.ones(len(image))]) @ matrix.T
    errors = np.linalg.norm(made[:, :2] / made[:, 2:] - world, axis=1)
    if not errors.max() <= max_error_m:
        raise ValueError(f"a control point is off by {errors.max():.3f} m; {max_error_m:.3f} m are allowed")
    return Calibration(matrix, image, world, reference, quality, float(np.sqrt((errors**2).mean())), float(errors.max()), float(max_error_m))


def apply_homography(matrix: np.ndarray, x: Column, y: Column) -> tuple[Column, Column]:
    h = [[float(v) for v in row] for row in matrix]
    dot = [x * h[r][0] + y * h[r][1] + h[r][2] for r in range(3)]
    return F.try_divide(dot[0], dot[2]), F.try_divide(dot[1], dot[2])


def inside_polygon(corners: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Whether a point lies in or on a convex polygon given counter-clockwise."""
    out = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        out = out & ((y - ay) * (bx - ax) - (x - ax) * (by - ay) >= 0)
    return out


def project_static(rows: DataFrame, calibration: Calibration) -> DataFrame:
    """x_m, y_m and inside added; constants only, no join."""
    x, y = F.col("ground_x_smooth"), F.col("ground_y_smooth")
    mx, my = apply_homography(calibration.matrix, x, y)
    return rows.withColumns({"x_m": mx, "y_m": my, "inside": inside_polygon(convex_hull(calibration.image_points), x, y)})


def telemetry_segments(samples: DataFrame, clip: str | None = None) -> DataFrame:
    """segment added to samples with a place: it grows whenever the frame counter does not.

    clip names the column that tells several clips apart, which are then dealt out by
    it; without it the samples are those of one file, which are few.
    """
    w = Window.partitionBy(*([clip] if clip else [])).orderBy("place")
    reset = F.coalesce((F.col("frame") <= F.lag("frame").over(w)).cast("int"), F.lit(0))
    return samples.withColumn("_reset", reset).withColumn("segment", F.sum("_reset").over(w)).drop("_reset")


def dense_telemetry(samples: DataFrame, max_gap: int = 2, clip: str | None = None) -> DataFrame:
    """A row for every frame that telemetry covers: samples, and frames between two that are at most max_gap + 1 apart.

    Yaw and roll take the shorter arc, all else a straight line.  clip is as for
    telemetry_segments.
    """
    if max_gap < 0:
        raise ValueError("the longest gap must not be negative")
    keys = [clip] if clip else []
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = samples.select(*keys, "frame", *TELEMETRY_FIELDS, F.lead(F.struct("frame", *TELEMETRY_FIELDS)).over(w).alias("_b"))
    gap = F.col("_b.frame") - F.col("frame") - 1
    last = F.when(gap.between(1, max_gap), F.col("_b.frame") - 1).otherwise(F.col("frame"))
    rows = rows.withColumn("_at", F.explode(F.sequence("frame", last)))
    share = (F.col("_at") - F.col("frame")) / (F.col("_b.frame") - F.col("frame"))
    between = F.col("_at") > F.col("frame")

    def value(c: str) -> Column:
        a, b = F.col(c), F.col(f"_b.{c}")
        line = arc_between(a, b, share) if c in ("gimbal_yaw_deg", "gimbal_roll_deg") else a + share * (b - a)
        return F.when(between, line).otherwise(a).alias(c)

    return rows.select(*keys, F.col("_at").alias("frame"), *(value(c) for c in TELEMETRY_FIELDS), between.alias("interpolated"))


def missing_frames(rows: DataFrame, dense: DataFrame, offset: int = 0) -> DataFrame:
    """Distinct frames that rows need and telemetry does not cover, in order."""
    need = rows.select((F.col("frame") + offset).alias("frame")).distinct()
    return need.join(dense.select("frame"), "frame", "left_anti").orderBy("frame")


def ray_to_ground(x: Column, y: Column, width: int, height: int, origin: tuple[float, float]) -> tuple[Column, Column, Column]:
    """East and north metres from origin (latitude, longitude) and reliability of the pixel's ray, with telemetry columns at hand.

    Rays that do not point down by more than 0.05, and altitudes of 0 or less, give null.
    """
    focal = F.col("focal_length_35mm") * (width / SENSOR_WIDTH_MM)
    rx, ry = (x - (width - 1) / 2.0) / focal, (y - (height - 1) / 2.0) / focal
    yaw, pitch, roll = (F.radians(f"gimbal_{k}_deg") for k in ("yaw", "pitch", "roll"))
    sy, cy, sp, cp, sr, cr = F.sin(yaw), F.cos(yaw), F.sin(pitch), F.cos(pitch), F.sin(roll), F.cos(roll)
    ahead, right, down = (sy * cp, cy * cp, sp), (cy, -sy, F.lit(0.0)), (sp * sy, sp * cy, -cp)
    ray = [f + rx * (r * cr + d * sr) + ry * (d * cr - r * sr) for f, r, d in zip(ahead, right, down)]
    altitude = F.col("relative_altitude_m")
    lands = (altitude > 0) & (ray[2] < -0.05)
    distance = F.when(lands, -altitude / ray[2])
    lat0 = math.radians(origin[0])
    east = F.radians(F.col("longitude") - origin[1]) * EARTH_RADIUS_M * math.cos(lat0) + distance * ray[0]
    north = F.radians(F.col("latitude") - origin[0]) * EARTH_RADIUS_M + distance * ray[1]
    good = (F.col("gimbal_pitch_deg") <= -20.0) & altitude.between(5.0, 500.0) & F.col("focal_length_35mm").between(10.0, 200.0) & (distance <= altitude * 10.0)
    return east, north, F.coalesce(good, F.lit(False))


def project_telemetry(rows: DataFrame, dense: DataFrame, width: int, height: int, origin: tuple[float, float], offset: int = 0, uncovered: str = "error") -> DataFrame:
    """x_m, y_m and inside (reliability) added by an equi-join on the frame.

    Rows of frames that telemetry does not cover stop the run before it begins, unless
    uncovered is "drop".
    A clip's telemetry is a few rows a second of one clip; Spark chooses how to join it.
    """
    if width <= 0 or height <= 0:
        raise ValueError("frame size must be positive")
    if offset < 0:
        raise ValueError("the frame offset must not be negative")
    if uncovered not in ("error", "drop"):
        raise ValueError("uncovered must be error or drop")
    if uncovered == "error" and (absent := [r["frame"] for r in missing_frames(rows, dense, offset).limit(10).collect()]):
        raise ValueError(f"telemetry lacks frames {absent}")
    keyed = dense.withColumnRenamed("frame", "_key").drop("interpolated")
    joined = rows.withColumn("_key", F.col("frame") + offset).join(keyed, "_key")
    east, north, good = ray_to_ground(F.col("ground_x_smooth"), F.col("ground_y_smooth"), width, height, origin)
    return joined.withColumns({"x_m": east, "y_m": north, "inside": good}).drop("_key", *TELEMETRY_FIELDS)


def telemetry_report(samples: DataFrame, dense: DataFrame, needed: DataFrame) -> DataFrame:
    """One row of ranges, and how many of the needed frames were interpolated."""
    spans = samples.agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), *(f(c).alias(f"{k}_{c}") for c in ("relative_altitude_m", "gimbal_pitch_deg", "gimbal_yaw_deg", "focal_length_35mm") for k, f in (("min", F.min), ("max", F.max))))
    used = dense.filter("interpolated").join(needed.select("frame").distinct(), "frame", "left_semi").agg(F.count(F.lit(1)).alias("interpolated_frame_count"))
    return spans.crossJoin(used)  # one row each
