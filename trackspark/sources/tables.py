"""Readers and writers: track tables, telemetry text, calibrations, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import no_nan, round_exact
from ..operators.association import unsuppressed
from ..operators.geo import Calibration, calibrate, telemetry_segments
from ..schema import LEVEL2_NEEDS, RAW_TRACKS, TELEMETRY_FIELDS, require_columns

#: Fixed values of the telemetry format: each field's pattern.
TELEMETRY_PATTERNS = {
    "latitude": r"\[latitude:\s*([-+\d.]+)\]",
    "longitude": r"\[longitude:\s*([-+\d.]+)\]",
    "relative_altitude_m": r"\[rel_alt:\s*([-+\d.]+)",
    "gimbal_yaw_deg": r"\[gb_yaw:\s*([-+\d.]+)",
    "gimbal_pitch_deg": r"gb_pitch:\s*([-+\d.]+)",
    "gimbal_roll_deg": r"gb_roll:\s*([-+\d.]+)",
    "focal_length_35mm": r"\[focal_len:\s*([-+\d.]+)\]",
}
FRAME_PATTERN = r"FrameCnt:\s*(\d+)"
BLOCKS = r"\r?\n\s*\r?\n"


def read_tracks(spark: SparkSession, path: str, level2: bool = False) -> DataFrame:
    """Raw tracks from CSV with a header; level 2 also insists on its columns and on rows."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType.simpleString() for f in RAW_TRACKS}
    schema = ", ".join(f"`{c}` {known.get(c, 'string')}" for c in header)
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    df = df.withColumns({c: no_nan(F.col(c)) for c, kind in df.dtypes if kind == "double"})
    if level2:
        require_columns(df, LEVEL2_NEEDS, path)
        if df.isEmpty():
            raise RuntimeError(f"{path} has no rows")
    return df


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    """An output table in CSV with a header, with the types that its values show."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary, report or run description in JSON as one row."""
    return spark.read.option("multiLine", True).json(path)


def telemetry_from_text(texts: DataFrame, text: str = "value", clip: str | None = None) -> DataFrame:
    """place, frame, telemetry fields (null where missing) and segment of each block that has a frame counter.

    clip names the column that tells several texts apart, each of which is counted by
    itself; without it there is one text.
    """
    keys = [clip] if clip else []
    blocks = texts.select(*keys, F.posexplode(F.split(F.regexp_replace(F.col(text), "^﻿", ""), BLOCKS)).alias("place", "block"))

    def field(pattern: str) -> Column:
        return F.when(F.col("block").rlike(pattern), F.regexp_extract("block", pattern, 1))

    rows = blocks.select(*keys, "place", field(FRAME_PATTERN).cast("long").alias("frame"), *(field(p).try_cast("double").alias(c) for c, p in TELEMETRY_PATTERNS.items()))
    return telemetry_segments(rows.filter("frame IS NOT NULL"), clip)


def read_telemetry(spark: SparkSession, path: str, segment: int | None = None) -> DataFrame:
    """The samples of one segment of a telemetry text file.

    Errors: bytes that are not UTF-8; no samples; a field that is missing in a block; several segments of which
    none was chosen; a segment that does not exist.
    """
    texts = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value"))
    if not texts.filter(~F.is_valid_utf8("value")).isEmpty():
        raise ValueError(f"{path} is not UTF-8")
    rows = telemetry_from_text(texts.select("value"))
    lacking = [F.count_if(F.col(c).isNull()).alias(c) for c in TELEMETRY_FIELDS]
    state = rows.agg(F.count(F.lit(1)).alias("n"), F.max("segment").alias("last"), *lacking).first()
    if not state["n"]:
        raise ValueError(f"{path} has no frame telemetry")
    for c in TELEMETRY_FIELDS:
        if state[c]:
            raise ValueError(f"{path}: {state[c]} telemetry blocks lack a finite {c}")
    count = int(state["last"]) + 1
    if count > 1 and segment is None:
        ranges = [tuple(r) for r in rows.groupBy("segment").agg(F.min("frame"), F.max("frame")).orderBy("segment").drop("segment").collect()]
        raise ValueError(f"{path} has {count} segments {ranges}; choose one")
    chosen = 0 if segment is None else segment
    if not 0 <= chosen < count:
        raise ValueError(f"the segment must be from 0 to {count - 1}")
    return rows.filter(F.col("segment") == chosen).select("frame", *TELEMETRY_FIELDS)


def read_calibration(path: str) -> Calibration:
    """A checked calibration from a small JSON file of the driver."""
    got = json.loads(Path(path).read_text(encoding="utf-8"))
    return calibrate(got.get("image_points_px"), got.get("world_points_m"), got.get("reference", ""), got.get("quality", ""), float(got.get("max_reprojection_error_m", 0.75)))


def parse_ids(text: str) -> tuple[int, ...]:
    """Numbers of a comma-separated list; blanks and empty parts are skipped."""
    return tuple(int(part) for part in text.split(",") if part.strip())


def suppress_overlaps(detections: DataFrame, least_iou: float = 0.7) -> DataFrame:
    """Detections without those that a more confident one of their frame and class overlaps by more than least_iou.

    Greedy, as detectors do it: only rows that are kept suppress others; ties go to the
    smaller seq.  Overlaps are found by a sweep, so a crowded frame of many thousand boxes
    costs what overlaps, not all pairs; a task holds the corners of one frame and class.
    """
    if not 0 <= least_iou <= 1:
        raise ValueError("least_iou must be from 0 to 1")
    corners = ["x1", "y1", "x2", "y2"]
    order = (-F.col("confidence")).alias("less")
    rows = detections.select("frame", "class_id", order, "seq", *(F.col(c).cast("double").alias(c) for c in corners))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cut = (rows[["frame", "class_id"]].fillna(-1) == rows[["frame", "class_id"]].fillna(-1).iloc[-1]).all(axis=1)
            held, whole = rows[cut], rows[~cut]  # the last frame may go on
            for _, one in whole.groupby(["frame", "class_id"], sort=False, dropna=False):
                yield one.loc[unsuppressed(one[corners].to_numpy(float), least_iou), ["frame", "class_id", "seq"]]
        if held is not None and len(held):
            yield held.loc[unsuppressed(held[corners].to_numpy(float), least_iou), ["frame", "class_id", "seq"]]

    dealt = rows.repartition("frame", "class_id").sortWithinPartitions("frame", "class_id", "less", "seq")
    kinds = dict(rows.dtypes)
    chosen = dealt.mapInPandas(keep, ", ".join(f"{c} {kinds[c]}" for c in ("frame", "class_id", "seq")))
    return detections.join(chosen, ["frame", "class_id", "seq"], "left_semi")


def detections_to_tracks(detections: DataFrame, fps: float) -> DataFrame:
    """Raw track rows of detector output (frame, track_id, class_id, class_name, confidence, box); boxes without a track go."""
    r3 = {c: round_exact(F.col(c), 3) for c in ("x1", "y1", "x2", "y2")}
    middle = round_exact((F.col("x1") + F.col("x2")) / 2, 3)
    extra = [c for c in ("seq",) if c in detections.columns]
    return detections.filter("track_id IS NOT NULL").select(
        *extra,
        F.col("frame").cast("long").alias("frame"),
        round_exact(F.col("frame") / float(fps), 6).alias("timestamp_s"),
        F.col("track_id").cast("long").alias("track_id"),
        F.col("class_id").cast("int").alias("class_id"),
        "class_name",
        round_exact(F.col("confidence"), 6).alias("confidence"),
        *(v.alias(c) for c, v in r3.items()),
        middle.alias("center_x"),
        round_exact((F.col("y1") + F.col("y2")) / 2, 3).alias("center_y"),
        middle.alias("ground_x"),
        r3["y2"].alias("ground_y"),
    )


def keep_detections(detections: DataFrame, fps: float, stride: int = 1, max_seconds: float | None = None, classes: tuple[int, ...] = (2, 3, 5, 7), confidence: float = 0.05) -> DataFrame:
    """Every stride-th frame before max_seconds, of the given classes and confident enough; all is pushed to the scan."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    rows = detections.filter(F.col("frame") % stride == 0).filter(F.col("class_id").isin(*classes) & (F.col("confidence") >= confidence))
    return rows if max_seconds is None else rows.filter(F.col("frame") < int(max_seconds * fps))
