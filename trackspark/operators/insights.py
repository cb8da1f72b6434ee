"""Object insights: class, motion, colour and size of every segment, and summaries of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import positive_part
from ..functions.quantiles import exact_quantiles
from ..schema import positive_fps
from ..storage import written
from .metrics import class_consistency

PLATE_SHARE, PLATE_PIXELS = 0.06, 12.0
PLATE_SMALL = "insufficient_resolution_for_validated_ocr"
PLATE_LARGE = "specialized_plate_detector_and_ocr_not_run"


def class_statistics(raw: DataFrame) -> DataFrame:
    """Modal class, consistency, median box sides and plate resolution of each track's raw rows."""
    w, h = positive_part(F.col("x2") - F.col("x1")), positive_part(F.col("y2") - F.col("y1"))
    half = F.lit(0.5)
    modal = class_consistency(raw).withColumnRenamed("class_consistency", "raw_class_consistency")
    names = raw.groupBy("track_id", "class_id").agg(F.mode("class_name", True).alias("class_name")).withColumnRenamed("class_id", "modal_class")
    boxes = raw.groupBy("track_id").agg(F.percentile(w, half).alias("median_box_width_px"), F.percentile(h, half).alias("median_box_height_px"), (F.percentile(F.least(w, h), half) * PLATE_SHARE).alias("estimated_plate_height_upper_bound_px"))
    rows = modal.join(names, ["track_id", "modal_class"]).join(boxes, "track_id")
    status = F.when(F.col("estimated_plate_height_upper_bound_px") < PLATE_PIXELS, PLATE_SMALL).otherwise(PLATE_LARGE)
    return rows.select("track_id", F.col("modal_class").alias("class_id"), "class_name", "raw_class_consistency", "median_box_width_px", "median_box_height_px", "estimated_plate_height_upper_bound_px", status.alias("plate_ocr_status"))


def segment_insights(kinematics: DataFrame, fps: float) -> DataFrame:
    """Times, observed share, speeds and displacement of each segment; metric columns only where kinematics have them."""
    dt = 1.0 / positive_fps(fps)
    px, py = F.col("position_x_px"), F.col("position_y_px")
    metric = "speed_m_s" in kinematics.columns
    good = F.col("inside_calibration_region")
    aggregates = [
        F.min("timestamp_s").alias("start_s"),
        F.max("timestamp_s").alias("end_s"),
        F.avg(F.col("observed").cast("double")).alias("observed_ratio") if "observed" in kinematics.columns else F.lit(1.0).alias("observed_ratio"),
        F.avg("speed_px_s").alias("mean_speed_px_s"),
        F.percentile("speed_px_s", F.lit(0.95)).alias("p95_speed_px_s"),
        F.hypot(F.max_by(px, "timestamp_s") - F.min_by(px, "timestamp_s"), F.max_by(py, "timestamp_s") - F.min_by(py, "timestamp_s")).alias("displacement_px"),
    ]
    if metric:

        def p95(c: str):
            return F.percentile(F.when(good, F.col(c)), F.lit(0.95))

        aggregates += [
            F.avg(good.cast("double")).alias("metric_coverage_ratio"),
            F.avg(F.when(good, F.col("speed_m_s"))).alias("mean_speed_m_s"),
            p95("speed_m_s").alias("p95_speed_m_s"),
            F.avg(F.when(good, F.col("speed_kmh"))).alias("mean_speed_kmh"),
            p95("speed_kmh").alias("p95_speed_kmh"),
            p95("acceleration_magnitude_m_s2").alias("p95_acceleration_m_s2"),
            (F.count_if(good & F.col("stopped")) * dt).alias("stopped_duration_s"),
        ]
    rows = kinematics.groupBy("track_id", "segment_id").agg(*aggregates).withColumn("duration_s", F.col("end_s") - F.col("start_s") + dt)
    if metric:
        return rows.withColumn("metric_kinematics_reliable", (F.col("duration_s") >= 2.0) & (F.col("observed_ratio") >= 0.7) & (F.col("metric_coverage_ratio") >= 0.8))
    return rows.withColumns({"metric_coverage_ratio": F.lit(0.0), "metric_kinematics_reliable": F.lit(False)})


def object_insights(raw: DataFrame, kinematics: DataFrame, appearance: DataFrame, sizes: DataFrame, fps: float) -> DataFrame:
    """Segments with their track's class, colour and size; a track without one has nulls there."""
    rows = segment_insights(kinematics, fps).join(class_statistics(raw), "track_id", "left").join(appearance, "track_id", "left")
    return rows.join(sizes.drop("class_name"), "track_id", "left")


def one_per_track(objects: DataFrame) -> DataFrame:
    """The first segment of each track."""
    return objects.withColumn("_r", F.row_number().over(Window.partitionBy("track_id").orderBy("start_s", "segment_id"))).filter("_r = 1").drop("_r")


def distributions(objects: DataFrame) -> DataFrame:
    """kind, label, tracks: how many tracks have each colour, size and plate status; null colours and sizes are unknown."""
    tracks = one_per_track(objects)
    kinds = {"color": F.coalesce("dominant_color", F.lit("unknown")), "size": F.coalesce("relative_size_class", F.lit("unknown")), "plate": F.col("plate_ocr_status")}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("label")) for k, v in kinds.items())))
    return tracks.select(pairs.alias("p")).select("p.kind", "p.label").filter("label IS NOT NULL").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("tracks"))


def metric_summary(objects: DataFrame, quality: str) -> DataFrame:
    """One row over reliable segments: medians and the plausibility of their speeds and accelerations, which are computed at once."""

    columns = ("mean_speed_kmh", "p95_speed_kmh", "p95_acceleration_m_s2")
    reliable = written(objects.filter("metric_kinematics_reliable").select("track_id", *columns), "reliable")
    q = exact_quantiles(reliable, {f"median_{c}": (c, 0.5) for c in columns} | {"v": ("p95_speed_kmh", 0.99), "a": ("p95_acceleration_m_s2", 0.95)})
    status = "measured" if quality == "surveyed" else "estimated_from_camera_or_non_survey_calibration"
    fair = q["v"] is not None and q["a"] is not None and q["v"] < 80.0 and q["a"] < 8.0
    row = reliable.agg(F.count_distinct("track_id").alias("metric_reliable_objects"))
    medians = [F.round(F.lit(q[f"median_{c}"]).cast("double"), 3).alias(f"median_{c}") for c in columns]
    return row.select(F.lit(status).alias("metric_status"), F.lit(quality).alias("projection_quality"), "metric_reliable_objects", *medians, F.lit("pass" if fair else "review_required").alias("plausibility_check"))
