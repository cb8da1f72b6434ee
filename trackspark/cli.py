"""Command line: level 1 and level 2 over tables of raw tracks; each prints its summary as JSON."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Level1Config, Level2Config
from .operators import appearance, evidence
from .sources import sinks, tables, video


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="trackspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, least in (("level1", 0.5), ("level2", 1.0)):
        sub = commands.add_parser(name)
        sub.add_argument("--tracks", required=True, help="raw tracks, CSV with a header")
        sub.add_argument("--output", required=True, help="folder that Spark can write")
        sub.add_argument("--video", help="raw video (.y4m) that gives the frame rate and size, and for level2 the colours")
        sub.add_argument("--fps", type=float)
        sub.add_argument("--width", type=int, default=640)
        sub.add_argument("--height", type=int, default=480)
        sub.add_argument("--min-track-seconds", type=float, default=least)
        sub.add_argument("--classes", help="class ids, comma-separated")
        sub.add_argument("--confidence", type=float, default=0.0)
        sub.add_argument("--stride", type=int, default=1)
        sub.add_argument("--max-seconds", type=float)
        sub.add_argument("--draw", action="store_true", help="also write the annotated video (level1) or the evidence video (level2), raw")
    sub.add_argument("--calibration", help="JSON file of control points")
    sub.add_argument("--telemetry", help="telemetry text of the clip")
    sub.add_argument("--segment", type=int)
    sub.add_argument("--frame-offset", type=int, default=0)
    sub.add_argument("--kinematics-window", type=int, default=31)
    return parser


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, object]:
    """Run one command; the summary is printed and returned."""
    got = _parser().parse_args(args)
    if got.command == "level2" and got.calibration and got.telemetry:
        raise ValueError("give a calibration or telemetry, not both")
    seen = video.probe(got.video, got.fps) if got.video else None
    fps = got.fps or (seen.fps if seen else None)
    if fps is None:
        raise ValueError("give --fps or --video")
    width, height = (seen.width, seen.height) if seen else (got.width, got.height)
    spark = spark or SparkSession.builder.appName("trackspark").getOrCreate()
    raw = tables.read_tracks(spark, got.tracks, level2=got.command == "level2")
    if "seq" not in raw.columns:
        raw = raw.withColumn("seq", F.xxhash64(*raw.columns))  # what tells rows of one track and frame apart
    classes = tables.parse_ids(got.classes) if got.classes else None
    if classes or got.confidence or got.stride > 1 or got.max_seconds is not None:
        every = classes or tuple(r[0] for r in raw.select("class_id").distinct().collect())  # a few classes
        raw = tables.keep_detections(raw, fps, got.stride, got.max_seconds, every, got.confidence)
    details: dict[str, object] = {"tracks": got.tracks, "video": got.video, "source_frames": seen.frames if seen else None}
    if got.command == "level1":
        summary = sinks.write_level1(raw, Level1Config(fps, got.min_track_seconds, frame_width=width, frame_height=height), got.output, details)
        if got.draw and seen:
            plan = evidence.annotation_plan(raw, every=got.stride)
            video.write_video(video.draw_plan(plan, got.video, got.stride, seen.frames_within(got.max_seconds)), f"{got.output}/annotated_tracking.y4m", video.output_fps(fps, got.stride), overwrite=True)
    else:
        if seen:
            pixels = video.crop_pixels(appearance.sample_rows(raw), got.video)
            votes = appearance.pixel_vote(pixels, "track_id", "frame")
        else:
            votes = raw.select("track_id", "frame", F.lit("unknown").alias("color"), F.lit(0.0).alias("confidence")).limit(0)
        projection: dict[str, object] = {}
        if got.calibration:
            projection["calibration"] = tables.read_calibration(got.calibration)
        if got.telemetry:
            projection |= {"telemetry": tables.read_telemetry(spark, got.telemetry, got.segment), "frame_offset": got.frame_offset}
        config = Level2Config(fps, got.min_track_seconds, frame_width=width, frame_height=height, kinematics_window=got.kinematics_window)
        summary = sinks.write_level2(raw, config, votes, got.output, details | {k: str(Path(v)) for k, v in (("calibration", got.calibration), ("telemetry", got.telemetry)) if v}, **projection)
        if got.draw and seen:
            plan = evidence.evidence_drawing(spark.read.parquet(f"{got.output}/parquet/evidence"), width, height)
            video.write_video(video.draw_plan(plan, got.video, got.stride, seen.frames_within(got.max_seconds)), f"{got.output}/evidence.y4m", video.output_fps(fps, got.stride), overwrite=True)
    print(json.dumps(summary, indent=2, default=str))
    return summary


if __name__ == "__main__":
    main()
