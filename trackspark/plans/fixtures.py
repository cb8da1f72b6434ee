"""Deterministic inputs made from the driver's event table, for queries, tests and the benchmark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geo import Calibration, calibrate
from ..schema import TELEMETRY_FIELDS
from ..sources.tables import detections_to_tracks

FPS, WIDTH, HEIGHT, MAX_GAP = 10.0, 640, 480, 10
FRAME_MICROS = 7_200_000_000
CLASSES = {"view": (0, "person"), "click": (2, "car"), "signup": (3, "motorcycle"), "purchase": (5, "bus"), "error": (7, "truck")}
IMAGE_POINTS = [[0, 0], [640, 0], [640, 480], [0, 480]]
WORLD_POINTS = [[0, 0], [40, 0], [36, 30], [4, 30]]
#: A smaller region for the inside test, so that both outcomes occur.
REGION = [(100.0, 60.0), (520.0, 60.0), (600.0, 440.0), (40.0, 440.0)]
ORIGIN = (47.25, 8.5)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _frame():
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div {FRAME_MICROS}").cast("long")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each event; its user is the track and its type the class."""
    kind = F.lit(None).cast("string")
    number = F.lit(None).cast("int")
    for event, (i, name) in CLASSES.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
        number = F.when(F.col("event_type") == event, i).otherwise(number)
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), _frame().alias("frame"), F.col("user_id").alias("track_id"), number.alias("class_id"), kind.alias("class_name"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.col("value").alias("x1"), (k * 4).cast("double").alias("y1"))
    return rows.withColumns({"x2": F.col("x1") + 10 + F.col("seq") % 90, "y2": F.col("y1") + 8 + F.col("seq") % 41})


def raw_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_to_tracks(detections(spark, sf_dir), FPS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir).select(F.col("user_id").alias("track_id"), _frame().alias("frame"), *(((e * m) % 256).cast("int").alias(c) for c, m in (("b", 37), ("g", 91), ("r", 53))))


def telemetry(spark: SparkSession) -> DataFrame:
    """360 frames with a few single ones missing, a turning camera and some unreliable altitudes."""
    f = F.col("id")
    values = (
        f * 1e-6 + 47.25,
        f * 1e-6 + 8.5,
        F.when(f % 50 == 7, F.lit(3.0)).otherwise((f % 10 + 100).cast("double")),
        ((f * 7) % 360 - 180).cast("double"),
        (-60 - f % 20).cast("double"),
        (f % 5 - 2).cast("double"),
        F.lit(24.0),
    )
    return spark.range(360).filter(f % 97 != 50).select(f.alias("frame"), *(v.alias(c) for v, c in zip(values, TELEMETRY_FIELDS)))


def clip_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each supplier: the same flight, higher by the clip's number and with other frames missing."""
    clips = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("clip"))
    flight = clips.crossJoin(F.broadcast(telemetry(spark))).filter((F.col("frame") + F.col("clip")) % 61 != 7)  # 360 rows at most
    return flight.withColumn("relative_altitude_m", F.col("relative_altitude_m") + F.col("clip") % 9)


def telemetry_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 80 frames of each clip as one text of blocks, its counter starting anew half way."""
    rows = clip_telemetry(spark, sf_dir).filter("frame < 80")
    f = F.col("frame") % 40
    block = F.format_string("%d\n00:00:00,000 --> 00:00:00,100\nFrameCnt: %d 2024-01-01\n[focal_len: %s] [latitude: %s] [longitude: %s] [rel_alt: %s abs_alt: 0] [gb_yaw: %s gb_pitch: %s gb_roll: %s]", "frame", f, *(F.col(c).cast("decimal(18,6)").cast("string") for c in ("focal_length_35mm", "latitude", "longitude", "relative_altitude_m", "gimbal_yaw_deg", "gimbal_pitch_deg", "gimbal_roll_deg")))
    blocks = rows.select("clip", "frame", block.alias("block")).groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("frame", "block"))).alias("b"))  # 80 blocks a clip
    return blocks.select("clip", F.array_join(F.transform("b", lambda s: s["block"]), "\n\n").alias("value"))


def calibration() -> Calibration:
    return calibrate(IMAGE_POINTS, WORLD_POINTS, "fixture", "surveyed", 0.75)


def matrix() -> np.ndarray:
    return calibration().matrix
