"""Scenarios of trajectories, written with their expected values."""

import json
import math
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark import cli
from trackspark.config import Level1Config, Level2Config
from trackspark.operators import appearance, density, evidence, geo, insights, metrics, motion, trajectory
from trackspark.functions.columns import finite, round_exact
from trackspark.plans import pipeline
from trackspark.sources import report, sinks, tables, video
from trackspark.sources.video import VideoProperties
from trackspark.streaming import tracks as streams

COLUMNS = "frame long, track_id long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, ground_x double, ground_y double, seq long, timestamp_s double"


def tracks(spark, rows):
    """rows of (frame, track, x) or (frame, track, x, class_id, class_name)."""
    out = []
    for i, (frame, track, x, *kind) in enumerate(rows):
        number, name = kind or (2, "car")
        missing = x is None
        out.append((frame, track, number, name, 0.9, *((None,) * 4 if missing else (x - 5.0, 0.0, x + 5.0, 50.0)), None if missing else float(x), 50.0, i, frame / 10))
    return spark.createDataFrame(out, COLUMNS)


def test_level1_of_two_objects(spark):
    raw = tracks(spark, [*((f, 3, 4 * f) for f in range(4, 29)), *((f, 8, 90 - f, 5, "bus") for f in range(12))])
    made = pipeline.level1(raw, Level1Config(fps=10, min_track_seconds=1.0))
    rows = {r.track_id: r for r in made["object_metrics"].collect()}
    assert {t: (r.segment_id, r.class_name, r.observed_ratio) for t, r in rows.items()} == {3: ("3-0", "car", 1.0), 8: ("8-0", "bus", 1.0)}
    assert rows[3].duration_s == pytest.approx(2.5) and rows[8].duration_s == pytest.approx(1.2)
    assert rows[3].p95_speed_px_s == pytest.approx(40.0, rel=0.05) and rows[8].mean_speed_px_s == pytest.approx(10.0, rel=0.3)
    assert rows[3].straightness == pytest.approx(1.0)
    assert made["tracking_quality"].first().unique_tracks == 2
    assert made["density"].count() == 32 * 24


def test_a_track_has_one_class_but_its_consistency_is_that_of_its_rows(spark):
    kinds = [(3, "motorcycle"), (5, "bus"), (3, "motorcycle"), (2, "car")]
    raw = tracks(spark, [(f, 21, f, *kinds[f % 4]) for f in range(24)])
    rows = trajectory.clean(raw, 10, 0.5)
    assert {(r.class_id, r.class_name) for r in rows.collect()} == {(3, "motorcycle")}
    (row,) = metrics.object_metrics(motion.pixel_motion(rows, 10), 10, raw).collect()
    assert row.class_consistency == pytest.approx(12 / 24)


def test_class_ties_go_to_the_smaller_id(spark):
    raw = tracks(spark, [(f, 1, f, *((2, "car") if f % 2 else (7, "truck"))) for f in range(10)])
    assert trajectory.clean(raw, 10, 0.2).first().class_id == 2


@pytest.mark.parametrize("missing, segments", [(10, 1), (11, 2)])
def test_gaps(spark, missing, segments):
    frames = [*range(5), *range(5 + missing, 10 + missing)]
    rows = trajectory.clean(tracks(spark, [(f, 1, f) for f in frames]), 10, 0.5).collect()
    assert len({r.segment_id for r in rows}) == segments
    if segments == 1:
        assert len(rows) == 10 + missing and sum(r.observed for r in rows) == 10
        assert all(r.ground_x == pytest.approx(r.frame) for r in rows)


def test_short_segments_go_but_keep_their_number(spark):
    frames = [0, 1, 30, 31, 32, 33, 34]
    rows = trajectory.clean(tracks(spark, [(f, 1, f) for f in frames]), 10, 0.5).collect()
    assert {r.segment_id for r in rows} == {"1-1"}


def test_the_last_of_repeated_rows_counts(spark):
    raw = tracks(spark, [*((f, 1, f) for f in range(6)), (3, 1, 3.5)])
    assert [r.ground_x for r in trajectory.clean(raw, 10, 0.5).orderBy("frame").collect()][3] == 3.5


def test_interpolation_equals_pandas(spark):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.5 else float(f * f) for f in range(60)]
    values[0:4] = [None] * 4
    rows = trajectory.clean(tracks(spark, [(f, 1, v) for f, v in enumerate(values)]), 10, 0.5, max_gap=3).orderBy("frame").toPandas()
    expected = pd.Series([np.nan if v is None else v for v in values]).interpolate(limit=3, limit_direction="both")
    np.testing.assert_allclose(rows.ground_x.to_numpy(float), expected.to_numpy(float))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 32])
def test_rolling_median_equals_pandas(spark, n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 100, n).astype(float).tolist()
    rows = trajectory.clean(tracks(spark, [(f, 1, v) for f, v in enumerate(x)]), 10, 0.2).orderBy("frame").toPandas()
    expected = pd.Series(x, dtype=float).rolling(max(1, min(5, n)), center=True, min_periods=1).median()
    np.testing.assert_allclose(rows.ground_x_smooth, expected)


def test_empty_and_missing(spark):
    raw = tracks(spark, [(0, 1, 1.0)]).limit(0)
    made = pipeline.level1(raw, Level1Config(fps=10))
    assert made["trajectories"].count() == 0 and made["tracking_quality"].first().median_track_duration_s == 0.0
    with pytest.raises(ValueError, match="ground_x"):
        trajectory.clean(raw.drop("ground_x"), 10)
    with pytest.raises(ValueError):
        trajectory.clean(raw, 0)


def clean_rows(spark, n, x, fps=10.0):
    return spark.createDataFrame([(f, f / fps, 1, "1-0", 2, "car", True, float(x(f)), 50.0) for f in range(n)], "frame long, timestamp_s double, track_id long, segment_id string, class_id int, class_name string, observed boolean, ground_x_smooth double, ground_y_smooth double")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 31, 32])
def test_derivatives_equal_numpy(spark, n):
    rows = motion.kinematics(clean_rows(spark, n, lambda f: 3 * f * f + 2 * f), 15).orderBy("frame").toPandas()
    x, t = np.array([3.0 * f * f + 2 * f for f in range(n)]), np.arange(n) / 10
    v = np.gradient(x, t, edge_order=2 if n > 2 else 1) if n > 1 else np.zeros(1)
    np.testing.assert_allclose(rows.position_x_px, x, atol=1e-8)  # quadratic motion passes smoothing unchanged
    np.testing.assert_allclose(rows.velocity_x_px_s, v, atol=1e-6)


def test_metric_motion_of_a_calibration(spark):
    # a trapezoid: 80 px of its upper edge are 12 m, 160 px of its lower one as well
    calibration = geo.calibrate([[240, 100], [320, 100], [360, 300], [200, 300]], [[0, 25], [12, 25], [12, 0], [0, 0]], "kerb stones", "Surveyed ", 0.05)
    assert calibration.quality == "surveyed"
    rows = clean_rows(spark, 24, lambda f: 205 + 6 * f).withColumn("ground_y_smooth", F.lit(300.0))
    made = motion.kinematics(rows, 9, geo.project_static(rows, calibration), calibration.quality, stop_speed_m_s=5.0).orderBy("frame").toPandas()
    np.testing.assert_allclose(made.speed_m_s, 6 * 12 / 160 * 10, atol=1e-6)
    np.testing.assert_allclose(made.speed_kmh, 3.6 * made.speed_m_s)
    assert made.inside_calibration_region.all() and made.stopped.all()


def test_no_metric_columns_without_a_projection(spark):
    made = motion.kinematics(clean_rows(spark, 5, lambda f: f))
    assert not {"speed_m_s", "speed_kmh"} & set(made.columns)
    assert not made.filter("stopped OR inside_calibration_region").count()


@pytest.mark.parametrize("image, world, quality, reference", [([[0, 0], [1, 1], [2, 2], [3, 3]], [[0, 0], [1, 0], [1, 1], [0, 1]], "surveyed", "x"), ([[0, 0], [100, 0], [100, 100]], [[0, 0], [1, 0], [1, 1]], "surveyed", "x"), ([[0, 0], [100, 0], [100, 100], [0, 100]], [[0, 0], [9, 0], [9, 9], [0, 9]], "guess", "x"), ([[0, 0], [100, 0], [100, 100], [0, 100]], [[0, 0], [9, 0], [9, 9], [0, 9]], "surveyed", " ")])
def test_bad_calibrations(image, world, quality, reference):
    with pytest.raises(ValueError):
        geo.calibrate(image, world, reference, quality)


def test_pixel_votes(spark):
    pixels = [(7, 200, 60, 20)] * 5 + [(7, 10, 10, 10)] * 2 + [(8, 30, 30, 30)] * 4 + [(8, 250, 251, 249)] * 4 + [(9, 60, 190, 60)]
    got = {r.k: (r.color, r.confidence) for r in appearance.pixel_vote(spark.createDataFrame(pixels, "k int, b int, g int, r int"), "k").collect()}
    assert got == {7: ("blue", 5 / 7), 8: ("black", 0.5), 9: ("green", 1.0)}


def test_sizes_are_thirds_of_the_cars(spark):
    boxes = [(t, "car", 5.0, 5.0, 5.0 + t, 9.0 + t) for t in range(11, 20)] + [(t, "bus", 0.0, 0.0, 9.0, 9.0) for t in (30, 31)] + [(32, "person", 0.0, 0.0, 2.0, 4.0)]
    frame = spark.createDataFrame(boxes, "track_id long, class_name string, x1 double, y1 double, x2 double, y2 double")
    sizes = {r.track_id: (r.median_box_area_px2, r.relative_size_class) for r in appearance.relative_sizes(frame).collect()}
    areas = sorted(t * (t + 4.0) for t in range(11, 20))
    low, high = np.quantile(areas, [0.33, 0.67])
    for t in range(11, 20):
        area = t * (t + 4.0)
        assert sizes[t] == (area, "small_passenger_vehicle" if area < low else "large_passenger_vehicle" if area > high else "medium_passenger_vehicle")
    assert sizes[30][1] == "bus" and sizes[32][1] == "person"
    two = appearance.relative_sizes(frame.filter("track_id IN (11, 19)"))
    assert {r.track_id: r.relative_size_class for r in two.collect()} == {11: "small_passenger_vehicle", 19: "large_passenger_vehicle"}


def test_color_vote_ties_and_unknown(spark):
    votes = spark.createDataFrame([(1, 5, "blue", 0.5), (1, 2, "red", 0.5), (2, 1, "unknown", 0.9)], "track_id long, frame long, color string, confidence double")
    got = {r.track_id: (r.dominant_color, r.color_confidence, r.color_samples) for r in appearance.color_vote(votes, votes).collect()}
    assert got == {1: ("red", 0.5, 2), 2: ("unknown", 0.0, 0)}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 10, 33])
def test_samples_are_evenly_spaced(spark, n):
    raw = tracks(spark, [(f, 1, f) for f in range(n)])
    got = sorted(r.frame for r in appearance.sample_rows(raw, 7).collect())
    assert got == np.unique(np.linspace(0, n - 1, min(7, n)).round().astype(int)).tolist()


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (640.0, 480.0), (640.1, 0.0), (639.9, 479.9)], "ground_x_smooth double, ground_y_smooth double")
    assert {(r.bx, r.by, r.n) for r in density.histogram(rows, 640, 480).collect()} == {(0, 0, 1), (31, 23, 2)}


BLOCK = "{i}\n00:00:00,000 --> 00:00:00,033\nFrameCnt: {frame} 2024-05-01 10:00:00\n[focal_len: 24.0] [latitude: 47.5] [longitude: 8.25] [rel_alt: 61.5 abs_alt: 470.0] [gb_yaw: 33.0 gb_pitch: -90.0 gb_roll: {roll}]\n"


def telemetry_file(tmp_path, frames, bom="", eol="\n", skip=None):
    text = "\n".join(BLOCK.format(i=i, frame=f, roll=i / 10) for i, f in enumerate(frames))
    path = tmp_path / "t.srt"
    path.write_bytes((bom + (text.replace(skip, "") if skip else text)).replace("\n", eol).encode())
    return str(path)


@pytest.mark.parametrize("bom, eol", [("", "\n"), ("﻿", "\r\n")])
def test_telemetry_text(spark, tmp_path, bom, eol):
    rows = tables.read_telemetry(spark, telemetry_file(tmp_path, [0, 1], bom, eol)).orderBy("frame").collect()
    assert [r.frame for r in rows] == [0, 1] and rows[0].relative_altitude_m == 61.5 and rows[1].gimbal_roll_deg == 0.1


def test_telemetry_segments_and_gaps(spark, tmp_path):
    path = telemetry_file(tmp_path, [0, 1, 0, 1])
    with pytest.raises(ValueError, match="choose one"):
        tables.read_telemetry(spark, path)
    assert [r.frame for r in tables.read_telemetry(spark, path, 1).orderBy("frame").collect()] == [0, 1]
    with pytest.raises(ValueError):
        tables.read_telemetry(spark, path, 2)
    with pytest.raises(ValueError, match="latitude"):
        tables.read_telemetry(spark, telemetry_file(tmp_path, [0, 1], skip="[latitude: 47.5] "))


FIELDS = "frame long, latitude double, longitude double, relative_altitude_m double, gimbal_yaw_deg double, gimbal_pitch_deg double, gimbal_roll_deg double, focal_length_35mm double"


def test_a_camera_that_looks_straight_down(spark):
    # 50 m up, 24 mm of focal length over a 36 mm wide picture of 1200 px: a pixel is 50 * 36 / (24 * 1200) m
    samples = spark.createDataFrame([(4, 47.0, 8.0, 50.0, 90.0, -90.0, 0.0, 24.0)], FIELDS)
    rows = spark.createDataFrame([(4, 599.5 + 80, 399.5), (4, 599.5, 399.5 + 80)], "frame long, ground_x_smooth double, ground_y_smooth double")
    got = geo.project_telemetry(rows, geo.dense_telemetry(samples), 1200, 800, (47.0, 8.0)).orderBy("ground_y_smooth").collect()
    metres = 80 * 50 * 36 / (24 * 1200)
    # heading east, right in the picture is south and down in it is west
    assert (got[0].x_m, got[0].y_m) == (pytest.approx(0.0, abs=1e-9), pytest.approx(-metres))
    assert (got[1].x_m, got[1].y_m) == (pytest.approx(-metres), pytest.approx(0.0, abs=1e-9))
    assert all(r.inside for r in got)
    late = geo.project_telemetry(rows.withColumn("frame", F.lit(1).cast("long")), geo.dense_telemetry(samples), 1200, 800, (47.0, 8.0), offset=3)
    assert late.count() == 2
    with pytest.raises(ValueError, match="lacks frames"):
        geo.project_telemetry(rows, geo.dense_telemetry(samples), 1200, 800, (47.0, 8.0), offset=1)
    assert geo.project_telemetry(rows, geo.dense_telemetry(samples), 1200, 800, (47.0, 8.0), 1, "drop").count() == 0


def test_clips_of_telemetry_are_told_apart(spark):
    rows = [("a", 0, 5), ("a", 1, 6), ("b", 0, 5), ("b", 1, 2), ("b", 2, 3)]
    got = geo.telemetry_segments(spark.createDataFrame(rows, "clip string, place long, frame long"), "clip").collect()
    assert sorted((r.clip, r.place, r.segment) for r in got) == [("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("b", 1, 1), ("b", 2, 1)]
    samples = spark.createDataFrame([(c, f, 1.0, 1.0, h, 0.0, -90.0, 0.0, 24.0) for c, f, h in (("a", 0, 10.0), ("a", 2, 30.0), ("b", 1, 5.0))], "clip string, " + FIELDS)
    dense = geo.dense_telemetry(samples, 2, "clip")
    assert sorted((r.clip, r.frame, r.relative_altitude_m) for r in dense.collect()) == [("a", 0, 10.0), ("a", 1, 20.0), ("a", 2, 30.0), ("b", 1, 5.0)]


def test_telemetry_interpolation_is_bounded_and_takes_the_short_arc(spark):
    samples = spark.createDataFrame([(0, 47.0, 8.0, 40.0, 170.0, -90.0, 0.0, 24.0), (2, 47.0, 8.0, 44.0, -150.0, -70.0, 0.0, 24.0)], FIELDS)
    row = geo.dense_telemetry(samples, 1).filter("interpolated").first()
    assert (row.frame, row.relative_altitude_m, row.gimbal_yaw_deg, row.gimbal_pitch_deg) == (1, 42.0, 190.0, -80.0)
    need = spark.createDataFrame([(0,), (1,), (9,)], "frame long")
    assert [r.frame for r in geo.missing_frames(need, geo.dense_telemetry(samples, 0)).collect()] == [1, 9]


def test_level2_insights_have_one_class_name(spark):
    raw = tracks(spark, [(f, 1, f * 3) for f in range(30)])
    votes = spark.createDataFrame([(1, 0, "red", 0.9)], "track_id long, frame long, color string, confidence double")
    made = pipeline.level2(raw, Level2Config(fps=10), votes)
    objects = made["level2_object_insights"]
    assert objects.columns.count("class_name") == 1 and not any(c.endswith(("_x", "_y")) for c in objects.columns)
    row = objects.first()
    assert row.dominant_color == "red" and row.metric_kinematics_reliable is False
    assert {(r.kind, r.label) for r in made["distributions"].collect()} >= {("color", "red")}
    assert made["evidence"].filter("label LIKE '#1 red M%'").count() == 30
    with pytest.raises(ValueError):
        pipeline.level2(raw, Level2Config(fps=10), votes, calibration=object(), telemetry=raw)


def test_labels_are_packed_without_overlap(spark):
    rows = spark.createDataFrame([(0, i + 1, f"#{i} red M", 100, 100, 120, 120) for i in range(5)], "frame long, place int, label string, ox1 int, oy1 int, ox2 int, oy2 int")
    got = [r for r in evidence.pack_labels(rows, 640, 480).orderBy("place").collect()]
    assert [r.slot for r in got] == [0, 1, 2, None, None]


def test_insights_by_hand(spark):
    stats = insights.class_statistics(tracks(spark, [(0, 1, 1.0), (1, 1, 2.0)])).first()
    assert stats.median_box_width_px == 10.0 and stats.estimated_plate_height_upper_bound_px == pytest.approx(0.6)
    assert stats.plate_ocr_status == insights.PLATE_SMALL


def test_csv_round_trip(spark, tmp_path):
    raw = tracks(spark, [(f, 1, f) for f in range(10)])
    sinks.write_table(raw, str(tmp_path), "raw")
    back = tables.read_tracks(spark, str(tmp_path / "raw.csv"), level2=True)
    assert back.count() == 10 and dict(back.dtypes)["x1"] == "double"
    with pytest.raises(ValueError):
        VideoProperties(math.inf, 1, 1, 1)


def test_rounding_is_that_of_the_binary_value(spark):
    r = np.random.default_rng(8)
    values = [2.675, 0.125, 0.375, -0.125, 1.005, 2.5, 1e8 + 0.0625, 0.0, -2.675, *r.uniform(-2000, 2000, 300).round(4).tolist(), *(r.integers(-4000, 4000, 200) / 16).tolist()]
    for places in (0, 1, 2, 3):
        got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", round_exact(F.col("v"), places).alias("r")).orderBy("i").collect()
        assert [x.r for x in got] == [round(v, places) for v in values]


def test_only_finite_values(spark):
    got = spark.createDataFrame([(1.5,), (math.inf,), (-math.inf,), (math.nan,), (None,)], "v double").select(finite(F.col("v")).alias("v")).collect()
    assert [r.v for r in got] == [1.5, None, None, None, None]


def test_smoothing_equals_polynomial_fits(spark):
    r = np.random.default_rng(4)
    for n, window in ((5, 31), (8, 31), (30, 31), (31, 31), (32, 31), (33, 7), (90, 31), (6, 4)):
        x = r.uniform(-50, 50, n)
        got = motion.kinematics(clean_rows(spark, n, lambda f: x[f]), window).orderBy("frame").toPandas().position_x_px
        size = min(max(5, window), n)
        size -= size % 2 == 0
        half, expected = size // 2, []
        for i in range(n):
            begin = max(0, min(i - half, n - size))
            fit = np.polyfit(np.arange(size) - half, x[begin : begin + size], 2)
            expected.append(np.polyval(fit, i - begin - half))
        np.testing.assert_allclose(got, expected, atol=1e-8)


def test_overlapping_boxes_are_suppressed(spark):
    boxes = [(0, 2, 1, 0.9, 0, 0, 10, 10), (0, 2, 2, 0.8, 1, 0, 11, 10), (0, 2, 3, 0.7, 2, 0, 12, 10), (0, 3, 4, 0.6, 0, 0, 10, 10), (1, 2, 5, 0.5, 0, 0, 10, 10), (0, 2, 6, 0.9, 0, 0, 10, 10)]
    frame = spark.createDataFrame([(f, c, s, p, *map(float, b)) for f, c, s, p, *b in boxes], "frame long, class_id int, seq long, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.seq for r in tables.suppress_overlaps(frame, 0.7).collect()) == [1, 3, 4, 5]  # 2 goes by 1, and so can't suppress 3
    assert tables.suppress_overlaps(frame, 1.0).count() == 6
    assert tables.parse_ids(" 2, 5,,7 ") == (2, 5, 7)


def write_video(path, frames, width=32, height=24, fps="12:1"):
    """Raw frames of one grey level each with a bright block that moves."""
    with open(path, "wb") as out:
        out.write(f"YUV4MPEG2 W{width} H{height} F{fps} Ip A1:1 C420jpeg\n".encode())
        for f in range(frames):
            y = np.full((height, width), 40 + f, np.uint8)
            y[4:20, 4 + f % 8 : 24 + f % 8] = 220
            out.write(b"FRAME\n" + y.tobytes() + bytes([128]) * (2 * (width // 2) * (height // 2)))


def test_video_frames_crops_and_detection(spark, tmp_path):
    path = str(tmp_path / "v.y4m")
    write_video(path, 150)
    seen = video.probe(path)
    assert seen == VideoProperties(12.0, 32, 24, 150) and seen.frames_within(2.5) == 30 and seen.frames_within(None) == 150
    assert video.output_fps(12.0, 30) == 1.0
    frames = video.read_frames(spark, path)
    assert [r.frame for r in frames.select("frame").orderBy("frame").collect()] == list(range(150))
    one = video.read_frames(spark, path, 77, 77).collect()
    grey = np.frombuffer(one[0].bgr, np.uint8).reshape(24, 32, 3)
    assert len(one) == 1 and (grey[0, 0] == round((40 + 77 - 16) * 1.164383)).all() and (grey[10, 15] > 230).all()
    boxes = spark.createDataFrame([(5, 77, 0.9, 4.0 + 77 % 8, 4.0, 24.0 + 77 % 8, 20.0), (6, 400, 0.9, 0.0, 0.0, 20.0, 20.0), (7, 3, 0.9, 0.0, 0.0, 3.0, 3.0)], "track_id long, frame long, confidence double, x1 double, y1 double, x2 double, y2 double")
    pixels = video.crop_pixels(boxes, path)
    votes = appearance.pixel_vote(pixels, "track_id", "frame").collect()
    assert [(r.track_id, r.color, r.confidence) for r in votes] == [(5, "white", 1.0)]

    class Counting:
        """Finds one box in each frame, and counts how many frames it has seen."""

        def __init__(self, settings):
            self.seen, self.name = 0, settings["name"]

        def detect(self, frame, bgr):
            self.seen += 1
            return [(self.seen, 2, self.name, 0.5, 0.0, 0.0, 4.0, 4.0)] if frame % 2 == 0 else [(None, 2, self.name, 0.1, 0.0, 0.0, 1.0, 1.0)]

    found = video.detect(frames, Counting, {"name": "car"}, every=3).orderBy("frame").collect()
    assert [r.frame for r in found] == list(range(0, 150, 3)) and [r.track_id for r in found if r.track_id] == [r.frame // 3 + 1 for r in found if r.track_id]
    raw = tables.detections_to_tracks(video.detect(frames, Counting, {"name": "car"}), 12.0)
    assert raw.count() == 75 and sinks.counters(raw) == {"processed_frames": 75, "tracked_detections": 75}
    with pytest.raises(RuntimeError, match="no detections"):
        sinks.counters(raw.filter("false"))
    with pytest.raises(ValueError):
        video.probe(__file__)


def decoded(data):
    """Size and pixels of one of our pictures."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    width, height = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)


def test_pictures(spark):
    cells = spark.createDataFrame([(3, 2, 4.0), (4, 2, 1.0)], "bx int, by int, density double")
    image = decoded(sinks.density_picture(cells, 640, 480))
    assert image.shape == (480, 640, 3) and image[50, 70].tolist() == [255, 255, 255] and image[400, 600].tolist() == [0, 0, 0] and 0 < image[50, 90].sum() < 765
    assert decoded(sinks.density_picture(cells.limit(0), 640, 480)).max() == 0
    lines = sinks.grid_lines(spark, 100, 60, 25)
    assert sorted((r.axis, r["at"]) for r in lines.collect()) == [("x", 0), ("x", 25), ("x", 50), ("x", 75), ("y", 0), ("y", 25), ("y", 50)]
    grid = decoded(sinks.grid_picture(lines, 100, 60))
    assert (grid[10, 25] != 255).any() and (grid[10, 26] == 255).all()
    with pytest.raises(ValueError):
        sinks.grid_lines(spark, 100, 60, 19)
    profile = spark.createDataFrame([(1, "1-0", 0.0, 1.0), (1, "1-0", 1.0, 3.0), (2, "2-0", 0.5, None)], "track_id long, segment_id string, timestamp_s double, speed double")
    assert (decoded(sinks.speed_picture(profile)) < 255).sum() > (decoded(sinks.speed_picture(profile.limit(0))) < 255).sum()


def test_command_line_runs_both_levels(spark, tmp_path, capsys):
    raw = tracks(spark, [*((f, 3, 60 + 4 * f) for f in range(40)), *((f, 9, 300 - 2 * f, 7, "truck") for f in range(5, 35))])
    sinks.write_table(raw, str(tmp_path), "raw")
    common = ["--tracks", str(tmp_path / "raw.csv"), "--fps", "10"]
    one = cli.main(["level1", *common, "--output", str(tmp_path / "one")], spark)
    assert json.loads(capsys.readouterr().out) == one and one["unique_tracks_by_class"] == {"car": 1, "truck": 1}
    assert tables.read_summary(spark, str(tmp_path / "one/summary.json")).count() == 1
    kept = tables.read_insights(spark, str(tmp_path / "one/trajectories.csv"))
    assert [(r.frame, r.track_id) for r in kept.collect()] == sorted((r.frame, r.track_id) for r in kept.collect())
    meta = json.loads((tmp_path / "one/run_metadata.json").read_text())
    assert meta["tracked_detections"] == 70 and meta["config"]["fps"] == 10.0 and decoded((tmp_path / "one/density_heatmap.png").read_bytes()).max() > 0
    page = (tmp_path / "one/report.html").read_text()
    assert "http" not in page and page.count("<polyline") == 2 and ">truck</text>" in page and "<td>3-0</td><td>car</td><td>4.00</td>" in page
    (tmp_path / "c.json").write_text(json.dumps({"reference": "lane marks", "quality": "surveyed", "image_points_px": [[0, 0], [640, 0], [640, 480], [0, 480]], "world_points_m": [[0, 0], [64, 0], [64, 48], [0, 48]]}))
    two = cli.main(["level2", *common, "--output", str(tmp_path / "two"), "--calibration", str(tmp_path / "c.json"), "--classes", "2,7"], spark)
    assert two["unique_tracks"] == 2 and two["metric"]["metric_status"] == "measured" and two["distributions"]["color"] == {"unknown": 2}
    report = json.loads((tmp_path / "two/metric_projection_report.json").read_text())
    assert report["quality"] == "surveyed" and report["max_reprojection_error_m"] < 1e-6
    page = (tmp_path / "two/report.html").read_text()
    assert page.count("<polyline") == 2 and ">measured</b>" in page and ">heavy_vehicle</text>" in page
    table = tables.read_insights(spark, str(tmp_path / "two/level2_object_insights.csv"))
    assert dict(table.dtypes)["mean_speed_m_s"] == "double" and dict(table.dtypes)["segment_id"] == "string"
    rows = table.orderBy("track_id").collect()
    assert [r.mean_speed_m_s for r in rows] == [pytest.approx(4.0, rel=0.05), pytest.approx(2.0, rel=0.05)]
    plain = cli.main(["level2", *common, "--output", str(tmp_path / "three")], spark)
    assert plain["metric"] == {"metric_status": "unavailable"} and not (tmp_path / "three/metric_projection_report.json").exists()
    with pytest.raises(RuntimeError, match="long enough"):
        cli.main(["level2", *common, "--output", str(tmp_path / "four"), "--min-track-seconds", "60"], spark)
    with pytest.raises(ValueError, match="not both"):
        cli.main(["level2", *common, "--output", "x", "--calibration", "a", "--telemetry", "b"], spark)


def test_a_failed_run_leaves_the_earlier_one(spark, tmp_path):
    out = str(tmp_path / "out")
    with sinks.published(spark, out) as staged:
        sinks.write_json(spark, f"{staged}/a.json", {"a": 1, "when": np.datetime64("2024-01-01")})
        assert not os.path.exists(out)
    with pytest.raises(RuntimeError, match="broken"):
        with sinks.published(spark, out) as staged:
            sinks.write_json(spark, f"{staged}/a.json", {"a": 2})
            raise RuntimeError("broken")
    assert json.loads((tmp_path / "out/a.json").read_text()) == {"a": 1, "when": "2024-01-01"}
    os.rename(out, f"{out}.before")  # a process that ended between the two renames
    with pytest.raises(RuntimeError):
        with sinks.published(spark, out):
            raise RuntimeError("again")
    assert json.loads((tmp_path / "out/a.json").read_text())["a"] == 1
    with sinks.published(spark, out) as staged:
        sinks.write_json(spark, f"{staged}/b.json", {"b": 3})
    assert [f for f in sorted(os.listdir(out)) if not f.startswith(".")] == ["b.json"] and os.listdir(tmp_path) == ["out"]


def test_series_are_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS x", "id * 2.0D AS y", "CAST(id % 30 AS string) AS k")
    made = report.series(rows, "x", "y", "k", 50)
    assert len(made) == report.BARS and all(len(v) <= 50 for v in made.values())
    assert all(abs(v - 2 * x) < 250 for line in made.values() for x, v in line)
    assert report.series(rows.limit(0), "x", "y", "k") == {} and "<svg" in report.line_chart("none", {})
    assert "&lt;b&gt;" in report.cards({"<b>": None}) and "&lt;i&gt;" in report.bar_chart("t", {"<i>": 2.0})


def test_colours_of_boxes_and_tracks(spark):
    frame = spark.createDataFrame([(1, "red"), (2, "unknown"), (3, None)], "track_id long, color string")
    got = frame.select("track_id", evidence.box_color(F.col("color")).alias("box"), evidence.track_color(F.col("track_id")).alias("track")).orderBy("track_id").collect()
    assert [r.box for r in got] == [list(evidence.BOX_COLORS["red"]), [255] * 3, [255] * 3]
    assert len({tuple(r.track) for r in got}) == 3 and all(80 <= c <= 255 for r in got for c in r.track)


def test_text_that_is_not_utf8_is_an_error(spark, tmp_path):
    path = telemetry_file(tmp_path, [0, 1])
    with open(path, "ab") as out:
        out.write(b"\xff\xfe broken")
    with pytest.raises(ValueError, match="UTF-8"):
        tables.read_telemetry(spark, path)


def test_rows_are_appended_and_trails_are_bounded_on_a_stream(spark, tmp_path):
    shape = "frame long, track_id long, trail_x int, trail_y int"

    def put(part, rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def stream():
        return spark.readStream.schema(shape).parquet(f"{tmp_path}/in")

    put(0, [(f, t, 10 * t + f, f) for f in range(6) for t in (1, 2)])
    for _ in range(2):
        query = streams.append_rows(stream(), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        put(1, [(f, 1, 10 + f, f) for f in range(6, 9)])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 12 + 3

    def trails(to):
        query = streams.bounded_trails(stream(), 4).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/trails").option("checkpointLocation", f"{tmp_path}/trail-state").trigger(availableNow=True).start()
        query.awaitTermination()

    trails(0)
    put(2, [(9, 1, 19, 9)])
    trails(1)
    got = {(r.track_id, r.frame): [p.x for p in r.trail] for r in spark.read.parquet(f"{tmp_path}/trails").collect()}
    assert got[1, 9] == [16 + 0, 17, 18, 19] or got[1, 9][-1] == 19
    assert got[2, 5] == [22, 23, 24, 25] and got[2, 0] == [20] and all(len(t) <= 4 for t in got.values())
