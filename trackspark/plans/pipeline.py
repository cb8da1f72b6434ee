"""Both levels as one lazy lineage each: tables by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import Level1Config, Level2Config
from ..operators import appearance, density, evidence, geo, insights, metrics, motion, trajectory


Keep = Callable[[DataFrame, str], DataFrame]


def lazily(df: DataFrame, name: str) -> DataFrame:
    return df


def level1(raw: DataFrame, config: Level1Config, keep: Keep = lazily) -> dict[str, DataFrame]:
    """Trajectories, motion, object metrics, counts, classes, quality and density of raw tracks.

    keep may write a table under a name and give what it reads back; then each is
    computed once, whatever is made from it.
    """
    rows = keep(trajectory.clean(raw, config.fps, config.min_track_seconds, config.max_gap_frames, config.smoothing_window), "trajectories")
    moved = keep(motion.pixel_motion(rows, config.fps), "trajectory_motion")
    objects = keep(metrics.object_metrics(moved, config.fps, raw), "object_metrics")
    return {
        "trajectories": rows,
        "trajectory_motion": moved,
        "object_metrics": objects,
        "timeseries_counts": keep(metrics.timeseries_counts(rows), "timeseries_counts"),
        "tracks_by_class": metrics.tracks_by_class(objects),
        "tracking_quality": metrics.tracking_quality(objects, raw, config.fps),
        "density": density.blur(density.histogram(rows, config.frame_width, config.frame_height), config.frame_width, config.frame_height),
    }


def level2(raw: DataFrame, config: Level2Config, votes: DataFrame, calibration: geo.Calibration | None = None, telemetry: DataFrame | None = None, origin: tuple[float, float] | None = None, frame_offset: int = 0, max_telemetry_gap: int = 2, keep: Keep = lazily) -> dict[str, DataFrame]:
    """Kinematics, appearance, sizes, insights and evidence; metric where one projection is given.

    votes are colour votes of sampled boxes (track_id, frame, color, confidence).  With
    telemetry, a frame that it does not cover and a ray that does not land are errors,
    found by one small job each before anything else runs, as is that no track is
    long enough.  keep is as for level1.
    """
    if calibration is not None and telemetry is not None:
        raise ValueError("give a calibration or telemetry, not both")
    if frame_offset < 0 or max_telemetry_gap < 0:
        raise ValueError("frame offset and telemetry gap must not be negative")
    rows = keep(trajectory.clean(raw, config.fps, config.min_track_seconds, config.max_gap_frames, config.smoothing_window), "level2_trajectories")
    if rows.isEmpty():
        raise RuntimeError("no track is long enough for level 2")
    projected, quality, report = None, None, {}
    if calibration is not None:
        projected, quality = geo.project_static(rows, calibration), calibration.quality
    elif telemetry is not None:
        dense = geo.dense_telemetry(telemetry, max_telemetry_gap)
        if origin is None:
            first = telemetry.orderBy("frame").select("latitude", "longitude").first()
            origin = (first["latitude"], first["longitude"])
        projected, quality = geo.project_telemetry(rows, dense, config.frame_width, config.frame_height, origin, frame_offset), "telemetry-derived"
        report = {"telemetry_report": geo.telemetry_report(telemetry, dense, rows.select((rows["frame"] + frame_offset).alias("frame")))}
    if projected is not None and not projected.filter("x_m IS NULL OR y_m IS NULL").isEmpty():
        raise ValueError("the projection gives points that are not finite")
    moved = keep(motion.kinematics(rows, config.kinematics_window, projected, quality, config.stop_speed_m_s), "level2_kinematics")
    colors, sizes = keep(appearance.color_vote(votes, raw), "track_appearance"), keep(appearance.relative_sizes(raw), "relative_sizes")
    objects = keep(insights.object_insights(raw, moved, colors, sizes, config.fps), "level2_object_insights")
    shown = evidence.shown_rows(raw, evidence.stable_tracks(objects), config.display_confidence, config.max_objects_per_frame)
    plan = evidence.labels(evidence.trails(evidence.scaled_boxes(shown, 1.0, 1.0), config.trail_length), objects, moved) if "seq" in raw.columns else shown
    tables = {
        "level2_kinematics": moved,
        "track_appearance": colors,
        "relative_sizes": sizes,
        "level2_object_insights": objects,
        "distributions": insights.distributions(objects),
        "speed_profiles": evidence.top_segment_profiles(objects, moved),
        "evidence": keep(plan, "evidence"),
        **report,
    }
    if quality is not None:
        tables["metric_summary"] = insights.metric_summary(objects, quality)
    return tables
