"""Outputs of a run: CSV tables with Parquet twins, JSON documents and pictures, in one folder that Spark can write."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Level1Config, Level2Config
from ..operators import density, evidence
from ..plans import pipeline
from . import report as pages

#: Columns that order a table in its file, as far as it has them.
ORDER = ("frame", "second", "track_id", "segment_id", "class_name")


def write_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df in order as folder/name.csv and folder/parquet/name, and read the latter back, typed."""
    keys = [c for c in ORDER if c in df.columns]
    path = f"{folder}/parquet/{name}"
    (df.orderBy(*keys) if keys else df).write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    plain = back.select(*(F.col(c) if "<" not in kind else F.to_json(c).alias(c) for c, kind in back.dtypes))
    plain.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    return back


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of the driver's in any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, document: dict[str, object]) -> None:
    write_bytes(spark, path, json.dumps(document, indent=2, default=str).encode())


def counters(detections: DataFrame, processed_frames: int | None = None) -> dict[str, int]:
    """Frames that were processed and detections with a track; none is an error."""
    row = detections.filter("track_id IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame").alias("f")).first()
    if not row["n"]:
        raise RuntimeError("there are no detections with a track; lower the confidence or check the classes")
    return {"processed_frames": processed_frames if processed_frames is not None else row["f"], "tracked_detections": row["n"]}


# pictures


def png(pixels: np.ndarray) -> bytes:
    """An uncompressed-filter PNG of red, green and blue bytes (height, width, 3)."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, width * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _line(image: np.ndarray, x0: float, y0: float, x1: float, y1: float, color: tuple[int, int, int]) -> None:
    n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
    x, y = (np.rint(np.linspace(a, b, n + 1)).astype(int) for a, b in ((x0, x1), (y0, y1)))
    inside = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
    image[y[inside], x[inside]] = color


def density_picture(cells: DataFrame, width: int, height: int) -> bytes:
    """The blurred grid as a picture from dark to bright; the grid's size does not depend on the input."""
    nx, ny = density.grid_size(width, height)
    grid = np.zeros((ny, nx))
    for r in cells.collect():  # nx * ny rows
        grid[r["by"], r["bx"]] = r["density"]
    level = grid / grid.max() if grid.max() > 0 else grid
    tile = max(1, 640 // nx)
    wide = np.kron(level, np.ones((tile, tile)))
    return png(np.stack([255 * np.clip(3 * wide - k, 0, 1) for k in range(3)], axis=-1))


def speed_picture(profiles: DataFrame, width: int = 960, height: int = 540) -> bytes:
    """Speed over time of the few longest segments, a line each; an empty frame where there are none."""
    image = np.full((height, width, 3), 255, np.uint8)
    rows = profiles.select("track_id", "segment_id", "timestamp_s", "speed").filter("speed IS NOT NULL").toPandas()
    left, low = 40, height - 40
    _line(image, left, 10, left, low, (0, 0, 0))
    _line(image, left, low, width - 10, low, (0, 0, 0))
    if len(rows):
        t, v = rows["timestamp_s"].to_numpy(float), rows["speed"].to_numpy(float)
        span, top = max(t.max() - t.min(), 1e-9), max(v.max(), 1e-9)
        rows["x"], rows["y"] = left + (t - t.min()) / span * (width - 10 - left), low - v / top * (low - 10)
        for k, (_, one) in enumerate(rows.sort_values("timestamp_s").groupby(["track_id", "segment_id"])):
            color = tuple(int(x) for x in 40 + 160 * np.abs(np.sin(np.array([1.0, 2.0, 3.0]) * (k + 1))))
            for (x0, y0), (x1, y1) in zip(one[["x", "y"]].to_numpy(), one[["x", "y"]].to_numpy()[1:]):
                _line(image, x0, y0, x1, y1, color)  # type: ignore[arg-type]
    return png(image)


def grid_lines(spark: SparkSession, width: int, height: int, step: int = 100) -> DataFrame:
    """axis, at: the lines of a calibration grid, step pixels apart, from 0."""
    if step < 20:
        raise ValueError("grid lines must be at least 20 pixels apart")
    return spark.range(0, width, step).select(F.lit("x").alias("axis"), F.col("id").alias("at")).unionAll(spark.range(0, height, step).select(F.lit("y"), "id"))


def grid_picture(lines: DataFrame, width: int, height: int, frame: np.ndarray | None = None) -> bytes:
    """The grid over a frame (blue, green, red), or over white."""
    image = np.full((height, width, 3), 255, np.uint8) if frame is None else frame[:, :, ::-1].copy()
    for r in lines.collect():  # (width + height) / 20 rows at most
        if r["axis"] == "x":
            image[:, r["at"]] = (255, 200, 0)
        else:
            image[r["at"], :] = (255, 200, 0)
    return png(image)


# runs


@contextmanager
def published(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder beside the given one to write a run to; when the run is done, it takes the place of the earlier one.

    A run that fails leaves the earlier one as it was, and nothing else.  The exchange is
    two renames; should a process end between them, the next run puts the earlier one back first.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path  # type: ignore[union-attr]
    target, before, staged = path(folder), path(f"{folder.rstrip('/')}.before"), path(f"{folder.rstrip('/')}.run-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(before):
        if files.exists(target):
            files.delete(before, True)
        else:
            files.rename(before, target)
    try:
        files.mkdirs(staged)
        yield staged.toString()
        if files.exists(target):
            files.rename(target, before)
        if not files.rename(staged, target):
            raise OSError(f"{folder} could not be published")
        files.delete(before, True)
    except BaseException:
        files.delete(staged, True)
        raise


def _keep(folder: str):
    return lambda df, name: write_table(df, folder, name)


def write_level1(raw: DataFrame, config: Level1Config, folder: str, details: dict[str, object] | None = None) -> dict[str, object]:
    """Run level 1, write all its outputs and publish them together; each table is computed once and read back by those that follow."""
    with published(raw.sparkSession, folder) as staged:
        return _write_level1(raw, config, staged, details)


def _write_level1(raw: DataFrame, config: Level1Config, folder: str, details: dict[str, object] | None) -> dict[str, object]:
    spark = raw.sparkSession
    counted = counters(raw)
    write_json(spark, f"{folder}/run_metadata.json", {"source_fps": config.fps, "frame_width": config.frame_width, "frame_height": config.frame_height, **counted, "config": asdict(config), **(details or {})})
    tables = pipeline.level1(raw, config, _keep(folder))
    write_bytes(spark, f"{folder}/density_heatmap.png", density_picture(tables["density"], config.frame_width, config.frame_height))
    write_table(evidence.annotation_plan(raw), folder, "annotation_plan")
    summary: dict[str, object] = {
        "tracking_quality_proxies": tables["tracking_quality"].first().asDict(),
        "unique_tracks_by_class": {r["class_name"]: r["tracks"] for r in tables["tracks_by_class"].collect()},  # a row for each class
        "coordinate_status": "pixels; metres and km/h need a projection",
        "outputs": {name: f"{name}.csv" for name in ("trajectories", "trajectory_motion", "object_metrics", "timeseries_counts", "annotation_plan")} | {"density_heatmap": "density_heatmap.png"},
    }
    write_json(spark, f"{folder}/summary.json", summary)
    write_bytes(spark, f"{folder}/report.html", pages.level1_page(tables, summary).encode())
    return summary


def write_level2(raw: DataFrame, config: Level2Config, votes: DataFrame, folder: str, details: dict[str, object] | None = None, **projection) -> dict[str, object]:
    """Run level 2, write all its outputs and publish them together; the projection's report only where there is one."""
    with published(raw.sparkSession, folder) as staged:
        return _write_level2(raw, config, votes, staged, details, **projection)


def _write_level2(raw: DataFrame, config: Level2Config, votes: DataFrame, folder: str, details: dict[str, object] | None, **projection) -> dict[str, object]:
    spark = raw.sparkSession
    tables = pipeline.level2(raw, config, votes, keep=_keep(folder), **projection)
    write_bytes(spark, f"{folder}/level2_speed_profiles.png", speed_picture(tables["speed_profiles"]))
    report = projection["calibration"].report() if projection.get("calibration") is not None else tables["telemetry_report"].first().asDict() if "telemetry_report" in tables else None
    if report is not None:
        write_json(spark, f"{folder}/metric_projection_report.json", report)
    found: dict[str, dict[str, int]] = {}
    for r in tables["distributions"].collect():  # colours, sizes and plate states
        found.setdefault(r["kind"], {})[r["label"] or "unknown"] = r["tracks"]
    metric = tables["metric_summary"].first().asDict() if "metric_summary" in tables else {"metric_status": "unavailable"}
    summary: dict[str, object] = {"unique_tracks": raw.select("track_id").distinct().count(), "segments": tables["level2_object_insights"].count(), "distributions": found, "metric": metric}
    write_json(spark, f"{folder}/level2_summary.json", summary)
    write_bytes(spark, f"{folder}/report.html", pages.level2_page(tables, summary).encode())
    write_json(spark, f"{folder}/level2_run_metadata.json", {"source_fps": config.fps, "frame_width": config.frame_width, "frame_height": config.frame_height, "config": asdict(config), **(details or {})})
    return summary
