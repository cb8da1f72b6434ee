"""Registered queries of the trajectory engine over the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lanes
from ..functions.columns import heading
from ..operators import appearance, association, density, evidence, geo, insights, metrics, motion, order, trajectory
from ..schema import TELEMETRY_FIELDS
from ..sources import tables
from ..storage import shared_dir
from ..streaming import state
from ..streaming import tracker as track_streams
from ..streaming import tracks as streams
from . import fixtures as fx

FPS, GAP = fx.FPS, fx.MAX_GAP
KINEMATICS_WINDOW = 31


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since engines add up in different orders; no negative zeros."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _level1(s: SparkSession, d: str) -> DataFrame:
    return trajectory.clean(fx.raw_tracks(s, d), FPS, 0.5, GAP)


def _level2(s: SparkSession, d: str) -> DataFrame:
    return trajectory.clean(fx.raw_tracks(s, d), FPS, 1.0, GAP)


def raw_tracks_projection(s, d):
    return rounded(fx.raw_tracks(s, d))


def stride_time_class_filter(s, d):
    return rounded(tables.keep_detections(fx.raw_tracks(s, d), FPS, stride=2, max_seconds=30.0, confidence=0.05).select("seq", "frame", "track_id", "class_id", "confidence"))


def dedupe_keep_last(s, d):
    return trajectory.latest_rows(fx.raw_tracks(s, d)).select("track_id", "frame", "seq")


def track_mode_class(s, d):
    return trajectory.stable_classes(trajectory.latest_rows(fx.raw_tracks(s, d))).select("track_id", "class_id", "class_name").distinct()


def class_consistency(s, d):
    return rounded(metrics.class_consistency(fx.raw_tracks(s, d)))


def gap_segments(s, d):
    rows = trajectory.latest_rows(fx.raw_tracks(s, d))
    rows = lanes.on_lanes(rows, rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5"))
    return trajectory.split_segments(rows, GAP, 5).groupBy("track_id", "segment_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("rows"))


def dense_interpolated(s, d):
    return rounded(_level1(s, d).select("track_id", "segment_id", "frame", "timestamp_s", "class_id", "observed", "confidence", "x1", "y1", "x2", "y2", "ground_x", "ground_y"))


def rolling_median_smooth(s, d):
    return rounded(_level1(s, d).select("track_id", "segment_id", "frame", "ground_x_smooth", "ground_y_smooth"))


def pixel_motion(s, d):
    return rounded(motion.pixel_motion(_level1(s, d), FPS).select("track_id", "segment_id", "frame", "speed_px_s", "acceleration_px_s2"))


def _objects(s, d):
    return metrics.object_metrics(motion.pixel_motion(_level1(s, d), FPS), FPS, fx.raw_tracks(s, d))


def object_metrics(s, d):
    return rounded(_objects(s, d))


def timeseries_counts(s, d):
    return metrics.timeseries_counts(_level1(s, d))


def tracking_quality(s, d):
    return rounded(metrics.tracking_quality(_objects(s, d), fx.raw_tracks(s, d), FPS), 4)


def tracks_by_class(s, d):
    return metrics.tracks_by_class(_objects(s, d))


def density_histogram(s, d):
    return density.histogram(_level1(s, d), fx.WIDTH, fx.HEIGHT)


def density_blur(s, d):
    return rounded(density.blur(density_histogram(s, d), fx.WIDTH, fx.HEIGHT))


#: What the motion queries read of a trajectory; kinematics passes all that it gets through its kernels.
PATH = ("track_id", "segment_id", "frame", "timestamp_s", "observed", "ground_x_smooth", "ground_y_smooth")


def _motion2(s, d):
    return motion.kinematics(_level2(s, d).select(*PATH), KINEMATICS_WINDOW)


def savgol_smooth(s, d):
    return rounded(_motion2(s, d).select("track_id", "segment_id", "frame", "position_x_px", "position_y_px"))


def gradient_velocity(s, d):
    rows = _motion2(s, d).select("track_id", "segment_id", "frame", "velocity_x_px_s", "velocity_y_px_s", "speed_px_s", "acceleration_x_px_s2", "acceleration_y_px_s2", "acceleration_magnitude_px_s2", "tangential_acceleration_px_s2")
    return rounded(rows, 5)


def heading_px(s, d):
    """Headings of first differences, which are exact in both engines."""
    w = Window.partitionBy("track_id", "segment_id").orderBy("frame")
    rows = _level1(s, d).withColumns({"dx": F.col("ground_x_smooth") - F.lag("ground_x_smooth").over(w), "dy": F.col("ground_y_smooth") - F.lag("ground_y_smooth").over(w)})
    rows = rows.filter("dx IS NOT NULL AND (abs(dx) > 1e-6 OR abs(dy) > 1e-6)")
    turned = F.pmod(F.round(heading(F.round("dx", 6), F.round("dy", 6)), 4), F.lit(360.0))
    return rows.select("track_id", "segment_id", "frame", turned.alias("heading_deg"))


def class_statistics(s, d):
    return rounded(insights.class_statistics(fx.raw_tracks(s, d)))


def relative_size(s, d):
    return rounded(appearance.relative_sizes(fx.raw_tracks(s, d)))


def colour_samples(s, d):
    return appearance.sample_rows(fx.raw_tracks(s, d)).select("track_id", "frame", "seq")


def hsv_family(s, d):
    return appearance.classify_pixels(fx.pixels(s, d)).groupBy("h", "s", "v", "color").agg(F.count(F.lit(1)).alias("n"))


def _votes(s, d):
    return appearance.pixel_vote(fx.pixels(s, d), "track_id", "frame")


def pixel_vote(s, d):
    return rounded(_votes(s, d))


def _colors(s, d):
    return appearance.color_vote(_votes(s, d), fx.raw_tracks(s, d))


def track_colour_vote(s, d):
    return rounded(_colors(s, d), 4)


def homography_project(s, d):
    x, y = geo.apply_homography(fx.matrix(), F.col("ground_x_smooth"), F.col("ground_y_smooth"))
    # a hair is added, since exact projections of three decimals end in ties
    return rounded(_level1(s, d).select("track_id", "segment_id", "frame", (x + 1e-9).alias("x_m"), (y + 1e-9).alias("y_m")))


def inside_hull(s, d):
    return _level1(s, d).select("track_id", "segment_id", "frame", geo.inside_polygon(geo.convex_hull(fx.REGION), F.col("ground_x_smooth"), F.col("ground_y_smooth")).alias("inside"))


def telemetry_segments(s, d):
    rows = fx.clip_telemetry(s, d).select("clip", F.col("frame").alias("place"), (F.col("frame") % 100).alias("frame"))
    return geo.telemetry_segments(rows, "clip")


def srt_parse(s, d):
    rows = tables.telemetry_from_text(fx.telemetry_text(s, d), clip="clip")
    return rounded(rows.select("clip", F.col("place").cast("long").alias("place"), "frame", "segment", *TELEMETRY_FIELDS))


def telemetry_dense(s, d):
    return rounded(geo.dense_telemetry(fx.clip_telemetry(s, d), clip="clip"), 7)


def _projected(s, d):
    return geo.project_telemetry(_level2(s, d), geo.dense_telemetry(fx.telemetry(s)), fx.WIDTH, fx.HEIGHT, fx.ORIGIN, uncovered="drop")


def telemetry_project(s, d):
    return rounded(_projected(s, d).select("track_id", "segment_id", "frame", "x_m", "y_m", "inside"), 5)


def telemetry_report(s, d):
    return rounded(geo.telemetry_report(fx.telemetry(s), geo.dense_telemetry(fx.telemetry(s)), _level2(s, d)))


def missing_frames(s, d):
    return geo.missing_frames(_level2(s, d), geo.dense_telemetry(fx.telemetry(s), 0)).limit(10)


def _metric2(s, d):
    rows = _level2(s, d).select(*PATH)
    mx, my = geo.apply_homography(fx.matrix(), F.col("ground_x_smooth"), F.col("ground_y_smooth"))
    inside = geo.inside_polygon(geo.convex_hull(fx.REGION), F.col("ground_x_smooth"), F.col("ground_y_smooth"))
    return motion.kinematics(rows, KINEMATICS_WINDOW, rows.withColumns({"x_m": mx, "y_m": my, "inside": inside}), "surveyed")


def metric_kinematics(s, d):
    return rounded(_metric2(s, d).select("track_id", "segment_id", "frame", "position_x_m", "position_y_m", "speed_m_s", "speed_kmh", "acceleration_magnitude_m_s2", "inside_calibration_region", "metric_calibration_quality"), 5)


def _insights(s, d, metric: bool):
    raw = fx.raw_tracks(s, d)
    moved = _metric2(s, d) if metric else _motion2(s, d)
    return insights.object_insights(raw, moved, _colors(s, d), appearance.relative_sizes(raw), FPS)


def object_insights(s, d):
    return rounded(_insights(s, d, False), 5)


def object_insights_metric(s, d):
    return rounded(_insights(s, d, True), 5)


def level2_distributions(s, d):
    return insights.distributions(_insights(s, d, False))


def metric_summary(s, d):
    return rounded(insights.metric_summary(_insights(s, d, True), "surveyed"), 3)


def longest_segment(s, d):
    return rounded(evidence.longest_segments(_objects(s, d)).select("track_id", "segment_id", "duration_s"))


def top_segments_profile(s, d):
    return rounded(evidence.top_segment_profiles(_objects(s, d), motion.pixel_motion(_level1(s, d), FPS)))


def _shown(s, d):
    raw = fx.raw_tracks(s, d)
    return evidence.scaled_boxes(evidence.shown_rows(raw, evidence.longest_segments(_objects(s, d)).filter("duration_s >= 2.0 AND displacement_px >= 12.0"), 0.2, 12), 0.5, 0.5)


def evidence_topk(s, d):
    return rounded(_shown(s, d).select("frame", "track_id", "seq", "place", "display_score", "ox1", "oy1", "ox2", "oy2"))


def evidence_trails(s, d):
    rows = evidence.trails(_shown(s, d), 20)
    return rows.select("frame", "track_id", "seq", F.size("trail").alias("points"), F.aggregate("trail", F.lit(0).cast("long"), lambda a, p: a + p["trail_x"] + p["trail_y"]).alias("sum_xy"))


def label_text(s, d):
    return evidence.labels(_shown(s, d), _insights(s, d, True), _metric2(s, d)).select("frame", "track_id", "seq", "label")


def label_overlap_pairs(s, d):
    return evidence.overlapping_pairs(_shown(s, d))


def label_packing(s, d):
    rows = evidence.labels(_shown(s, d), _insights(s, d, False), _motion2(s, d))
    packed = evidence.pack_labels(rows, fx.WIDTH // 2, fx.HEIGHT // 2)
    return packed.select("frame", "place", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("slot", "left", "top", "right", "bottom")))


def stable_tracks(s, d):
    return evidence.stable_tracks(_insights(s, d, False), consistency=0.3, color=0.3).select("track_id", "segment_id")


def suppressed_boxes(s, d):
    return tables.suppress_overlaps(fx.raw_tracks(s, d), 0.2).select("frame", "class_id", "seq")


def _crops(s, d):
    window = appearance.crop_window(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), fx.WIDTH, fx.HEIGHT)
    return fx.raw_tracks(s, d).select("seq", window.alias("c")).filter("c IS NOT NULL").select("seq", "c.*")


def crop_windows(s, d):
    return _crops(s, d)


def ellipse_pixels(s, d):
    sizes = _crops(s, d).select((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")).distinct()
    cells = sizes.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    return cells.filter(appearance.in_ellipse(*map(F.col, "xywh"))).groupBy("w", "h").agg(F.count(F.lit(1)).alias("pixels"))


def missing_frames_offset(s, d):
    return geo.missing_frames(_level2(s, d), geo.dense_telemetry(fx.telemetry(s), 0), 30).limit(10)


def annotation_plan(s, d):
    rows = evidence.annotation_plan(fx.raw_tracks(s, d), 20, 2)
    return rows.select("frame", "track_id", "seq", "label", F.size("trail").alias("points"), F.aggregate("trail", F.lit(0).cast("long"), lambda a, p: a + p["trail_x"] + p["trail_y"]).alias("sum_xy"))


def box_colours(s, d):
    color = evidence.box_color(F.col("dominant_color"))
    return _colors(s, d).select("track_id", *(color[k].alias(c) for k, c in enumerate("bgr")))


def _raw_stream(s: SparkSession, d: str, path: str) -> DataFrame:
    raw = fx.raw_tracks(s, d).select("track_id", "frame", "class_name")
    raw.write.parquet(f"{path}/in")
    return s.readStream.schema(raw.schema).parquet(f"{path}/in")


def session_segments_stream(s, d):
    path = shared_dir(s)
    return streams.run_to_table(streams.session_segments(_raw_stream(s, d, path), FPS, GAP), path)


def tumbling_counts_stream(s, d):
    path = shared_dir(s)
    return streams.run_to_table(streams.tumbling_counts(_raw_stream(s, d, path), FPS), path)


def _boxes(s, d):
    """The boxes of events without their track ids, as those of a few clips."""
    clip = F.concat(F.lit("clip"), (F.col("track_id") % 12).cast("string")).alias("clip")
    return fx.detections(s, d).select(clip, *[c for c in fx.detections(s, d).columns if c != "track_id"])


def tracked_boxes(s, d):
    return association.track_boxes(_boxes(s, d), association.TrackerSettings(match_thresh=0.95)).select("clip", "frame", "seq", "track_id")


def tracked_boxes_stream(s, d):
    """The same ids from a stream that is stopped and goes on, with rows out of order; ends are told by rows with a frame only."""
    rows, path = _boxes(s, d), shared_dir(s)
    after = (F.col("frame") >= 180) | ((F.col("frame") >= 174) & (F.col("seq") % 7 == 3))
    ends = rows.select("clip").distinct().select("clip", F.lit(100_000).cast("long").alias("frame"))
    for part in (rows.filter(~after), rows.filter(after), s.createDataFrame([], rows.schema).unionByName(ends, allowMissingColumns=True)):
        part.write.mode("append").parquet(f"{path}/in")
        source = s.readStream.schema(rows.schema).parquet(f"{path}/in")
        state.run_appended(track_streams.track_stream(source, FPS, association.TrackerSettings(match_thresh=0.95)), path)
    return s.read.parquet(f"{path}/table").select("clip", "frame", "seq", "track_id")


def _in_two_runs(s, rows, make) -> DataFrame:
    """The output of a stream over rows that is stopped halfway, with late rows; a last row far ahead moves the watermark on."""
    path = shared_dir(s)
    after = (F.col("frame") >= 180) | ((F.col("frame") >= 120) & (F.col("frame") % 7 == 3))
    end = s.createDataFrame([], rows.schema).unionByName(s.range(1).select(F.lit(100_000).cast("long").alias("frame"), F.lit(-1).cast("long").alias("track_id")), allowMissingColumns=True)
    for part in (rows.filter(~after), rows.filter(after), end):
        part.write.mode("append").parquet(f"{path}/in")
        state.run_appended(make(s.readStream.schema(rows.schema).parquet(f"{path}/in")), path)
    return s.read.parquet(f"{path}/table")


def counted_seconds_stream(s, d):
    return _in_two_runs(s, fx.raw_tracks(s, d).select("track_id", "frame", "class_name"), lambda r: state.counted_seconds(r, FPS))


def ordered_trails_stream(s, d):
    rows = fx.raw_tracks(s, d).select("track_id", "frame", "seq", F.floor("ground_x").cast("int").alias("trail_x"), F.floor("ground_y").cast("int").alias("trail_y"))
    made = _in_two_runs(s, rows, lambda r: state.ordered_trails(r, FPS, 20))
    return made.select("frame", "track_id", "seq", F.size("trail").alias("points"), F.aggregate("trail", F.lit(0).cast("long"), lambda a, p: a + p["x"] + p["y"]).alias("sum_xy"))


def first_appearance(s, d):
    return order.first_appearance(fx.raw_tracks(s, d), "track_id", "frame", "seq")


_ALL = (
    raw_tracks_projection, stride_time_class_filter, dedupe_keep_last, track_mode_class, class_consistency, gap_segments, dense_interpolated, rolling_median_smooth, pixel_motion, object_metrics, timeseries_counts,
    tracking_quality, tracks_by_class, density_histogram, density_blur, savgol_smooth, gradient_velocity, heading_px, class_statistics, relative_size, colour_samples, hsv_family, pixel_vote, track_colour_vote,
    homography_project, inside_hull, telemetry_segments, srt_parse, telemetry_dense, telemetry_project, telemetry_report, missing_frames, metric_kinematics, object_insights, object_insights_metric,
    level2_distributions, metric_summary, longest_segment, top_segments_profile, evidence_topk, evidence_trails, label_text, label_overlap_pairs, label_packing, session_segments_stream, tumbling_counts_stream, stable_tracks, suppressed_boxes, crop_windows, ellipse_pixels, missing_frames_offset, annotation_plan, box_colours,
    tracked_boxes, tracked_boxes_stream, counted_seconds_stream, ordered_trails_stream, first_appearance,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
