"""Per-object metrics, per-second counts and quality of tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..schema import positive_fps, require_columns


def class_consistency(raw: DataFrame) -> DataFrame:
    """track_id, modal_class (ties to the smallest id) and the share of raw rows that have it."""
    require_columns(raw, {"track_id", "class_id"}, "raw tracks")
    counts = raw.groupBy("track_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    # an ordinary two-step aggregation: counts are merged on the map side, ties fall to the smallest class
    return counts.groupBy("track_id").agg(F.max_by("class_id", F.struct("n", -F.col("class_id"))).alias("modal_class"), (F.max("n") / F.sum("n")).alias("class_consistency"))


def object_metrics(motion: DataFrame, fps: float, raw: DataFrame | None = None) -> DataFrame:
    """One row for each segment; class consistency is that of the track's raw rows, or 1 without them."""
    dt = 1.0 / positive_fps(fps)
    gx, gy = F.col("ground_x_smooth"), F.col("ground_y_smooth")
    rows = motion.groupBy("track_id", "segment_id").agg(
        F.min("class_id").alias("class_id"),
        F.min("class_name").alias("class_name"),
        F.min("timestamp_s").alias("start_s"),
        F.max("timestamp_s").alias("end_s"),
        F.avg(F.col("observed").cast("double")).alias("observed_ratio"),
        (F.sum("speed_px_s") * dt).alias("path_length_px"),
        F.hypot(F.max_by(gx, "frame") - F.min_by(gx, "frame"), F.max_by(gy, "frame") - F.min_by(gy, "frame")).alias("displacement_px"),
        F.avg("speed_px_s").alias("mean_speed_px_s"),
        F.percentile("speed_px_s", F.lit(0.95)).alias("p95_speed_px_s"),
        F.max("speed_px_s").alias("max_speed_px_s"),
    )
    rows = rows.withColumn("duration_s", F.col("end_s") - F.col("start_s") + dt)
    rows = rows.withColumn("straightness", F.when(F.col("path_length_px") > 0, F.col("displacement_px") / F.col("path_length_px")).otherwise(0.0))
    if raw is None:
        rows = rows.withColumn("class_consistency", F.lit(1.0))
    else:
        rows = rows.join(class_consistency(raw).drop("modal_class"), "track_id", "left").withColumn("class_consistency", F.coalesce("class_consistency", F.lit(1.0)))
    return rows.select(
        "track_id", "segment_id", "class_id", "class_name", "start_s", "end_s", "duration_s", "observed_ratio", "class_consistency", "path_length_px", "displacement_px", "straightness", "mean_speed_px_s", "p95_speed_px_s", "max_speed_px_s"
    )


def timeseries_counts(rows: DataFrame) -> DataFrame:
    """Distinct observed tracks by second and class, and by second."""
    seen = (rows.filter("observed") if "observed" in rows.columns else rows).withColumn("second", F.floor("timestamp_s").cast("long"))
    seen = seen.select("second", "class_name", "track_id").distinct()
    counts = seen.groupBy("second", "class_name").agg(F.count_distinct("track_id").alias("visible_objects"))
    totals = seen.groupBy("second").agg(F.count_distinct("track_id").alias("all_visible_objects"))
    return counts.join(totals, "second", "left")


def tracks_by_class(objects: DataFrame) -> DataFrame:
    return objects.groupBy("class_name").agg(F.count_distinct("track_id").alias("tracks")).orderBy(F.desc("tracks"), "class_name")


def tracking_quality(objects: DataFrame, raw: DataFrame, fps: float) -> DataFrame:
    """One row; without objects medians and ratios are 0.  The medians are computed at once."""
    detections = raw.agg(F.count(F.lit(1)).alias("tracked_detections"))

    medians = exact_quantiles(objects, {c: (c, 0.5) for c in ("duration_s", "observed_ratio", "class_consistency")})

    def median(c: str, places: int):
        return F.round(F.lit(medians[c] or 0.0), places)

    row = objects.agg(F.count_distinct("track_id").alias("unique_tracks"), F.round(F.coalesce(F.avg((F.col("duration_s") >= 2.0).cast("double")), F.lit(0.0)), 4).alias("long_track_ratio"))
    row = row.select(
        "unique_tracks",
        median("duration_s", 3).alias("median_track_duration_s"),
        "long_track_ratio",
        median("observed_ratio", 4).alias("median_observed_ratio"),
        median("class_consistency", 4).alias("median_class_consistency"),
    )
    return row.crossJoin(detections).withColumn("fps", F.lit(round(float(fps), 3)))  # one row each
