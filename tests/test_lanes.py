"""Tracks in lanes: short lanes give what one lane gives, and no window runs over a track's rows."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from trackspark.functions import lanes
from trackspark.operators import motion, trajectory

COLUMNS = "frame long, track_id long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, ground_x double, ground_y double, seq long, timestamp_s double, extra string"


def raw_rows(seed=1):
    """A long track with gaps, repeats, runs of missing values and changing classes, beside short ones."""
    r, out = random.Random(seed), []
    for track, frames in ((7, 900), (1, 30), (2, 4), (3, 200)):
        f = 0
        while f < frames:
            hole = track == 7 and 300 <= f < 360  # no values for longer than any lane
            missing = hole or r.random() < 0.2
            v = lambda: None if missing or r.random() < 0.05 else r.uniform(0, 500)
            for _ in range(1 + (r.random() < 0.1)):
                kind = r.choice([(2, "car"), (2, "car"), (5, "bus"), (2, "van"), (None, None)])
                out.append((f, track, *kind, r.random(), v(), v(), v(), v(), v(), v(), len(out), f / 10, f"e{len(out)}"))
            f += r.choice((1, 1, 1, 1, 2, 3, 9, 11, 12)) if track != 3 else r.choice((1, 12))
    return out


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(raw_rows(), COLUMNS)


def plain(rows, names):
    return rows.select("track_id", "segment_id", "frame", *names).toPandas().sort_values(["track_id", "segment_id", "frame"], ignore_index=True)


@pytest.mark.parametrize("frames", [16, 50])
def test_clean_and_motion_do_not_depend_on_lanes(raw, frames):
    names = [c for c in trajectory.clean(raw, 10, 0.3, 10).columns if c not in ("track_id", "segment_id", "frame")]
    one, many = trajectory.clean(raw, 10, 0.3, 10), trajectory.clean(raw, 10, 0.3, 10, lane_frames=frames)
    pd.testing.assert_frame_equal(plain(one, names), plain(many, names))
    moved = ["speed_px_s", "acceleration_px_s2"]
    pd.testing.assert_frame_equal(plain(motion.pixel_motion(one, 10), moved), plain(motion.pixel_motion(one, 10, frames), moved))
    fill = one.fillna(0.0, ["ground_x_smooth", "ground_y_smooth"])
    moved = ["position_x_px", "velocity_y_px_s", "acceleration_x_px_s2", "tangential_acceleration_px_s2", "heading_deg", "observed"]
    whole, cut = plain(motion.kinematics(fill, 5), moved), plain(motion.kinematics(fill, 5, lane_frames=frames), moved)
    assert len(whole) == len(plain(one, [])) and whole.shape == cut.shape
    np.testing.assert_allclose(whole[moved[:4]].to_numpy(float), cut[moved[:4]].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_clean_equals_a_plain_program(raw):
    """Segments, classes and interpolation by pandas, track by track."""
    rows = pd.DataFrame(raw_rows(), columns=[c.split()[0] for c in COLUMNS.split(", ")])
    rows = rows.sort_values("seq").drop_duplicates(["track_id", "frame"], keep="last").sort_values(["track_id", "frame"])
    want = []
    for track, own in rows.groupby("track_id"):
        if len(own) < 3:
            continue
        counts = own["class_id"].value_counts()
        modal = min(counts[counts == counts.max()].index)
        named = own[own["class_id"] == modal]["class_name"].value_counts()
        name = min(named[named == named.max()].index)
        number = (own["frame"].diff() > 11).cumsum()
        for k, part in own.groupby(number):
            if len(part) < 3:
                continue
            dense = part.set_index("frame").reindex(range(part["frame"].min(), part["frame"].max() + 1))
            x = dense["ground_x"].astype(float).interpolate(limit=10, limit_direction="both")
            want += [(track, f"{track}-{k}", f, modal, name, v) for f, v in x.items()]
    want = pd.DataFrame(want, columns=["track_id", "segment_id", "frame", "class_id", "class_name", "ground_x"]).sort_values(["track_id", "segment_id", "frame"], ignore_index=True)
    got = plain(trajectory.clean(raw, 10, 0.3, 10, lane_frames=32), ["class_id", "class_name", "ground_x"])
    assert got[["track_id", "segment_id", "frame", "class_name"]].equals(want[["track_id", "segment_id", "frame", "class_name"]])
    assert (got["class_id"] == want["class_id"]).all()
    np.testing.assert_allclose(got["ground_x"].to_numpy(float), want["ground_x"].to_numpy(float))


def test_one_track_is_spread_over_tasks(spark):
    """Windows over rows are by lane; those by track see one row a lane."""
    one = spark.range(60_000).selectExpr("id AS frame", "1L AS track_id", "2 AS class_id", "'car' AS class_name", "0.9D AS confidence", *(f"CAST(id % 500 AS double) AS {c}" for c in ("x1", "y1", "x2", "y2", "ground_x", "ground_y")), "id AS seq", "id / 10.0D AS timestamp_s")
    made = trajectory.clean(one, 10, lane_frames=1000)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    for keys in re.findall(r"windowspecdefinition\(track_id#\d+L?, (\S+)", plan):
        assert re.match(r"_lane|frame|segment_id|e#|class_id|number|_part", keys), keys
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = motion.kinematics(made, 15, lane_frames=1000).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sum(r["count"] for r in sizes) == 60_000 and len(sizes) == 4 and max(r["count"] for r in sizes) < 30_000


def test_lanes_must_hold_their_reach(raw):
    with pytest.raises(ValueError, match="reach"):
        lanes.in_lanes(raw, 9, lambda r: r, 8)
