"""Long tracks in lanes: pieces of a fixed number of frames, with as many neighbouring rows as a computation reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of a lane; what one task orders at least together.
LANE_FRAMES = 4096


def lane_of(frame: Column, frames: int = LANE_FRAMES) -> Column:
    return F.floor(frame / frames).cast("long")


def in_lanes(rows: DataFrame, reach: int, body: Callable[[DataFrame], DataFrame], frames: int = LANE_FRAMES) -> DataFrame:
    """body(rows), where body works on each (track_id, segment_id) by itself and a row depends on rows at most reach frames away.

    body sees a segment as lanes under segment_ids of their own, each with the reach
    frames on both sides of it; of its result a lane's own rows are kept.  A lane's
    end is a segment's end or at least reach rows from all that is kept, so body may
    treat both alike.  Segments that are longer than a lane must have a row for every
    frame, as clean trajectories do.  Only rows near the ends are copied.
    """
    if not 0 <= reach <= frames:
        raise ValueError("a lane must be as long as the reach")
    own = lane_of(F.col("frame"), frames)
    place = F.col("frame") - own * frames
    lanes = F.array_compact(F.array(own, F.when(place < reach, own - 1), F.when(place >= frames - reach, own + 1)))
    spread = rows.withColumn("_lane", F.explode(lanes)).withColumn("_segment", F.col("segment_id"))
    done = body(spread.withColumn("segment_id", F.concat_ws("#", F.col("segment_id").cast("string"), F.col("_lane").cast("string"))))
    return done.filter(own == F.col("_lane")).withColumn("segment_id", F.col("_segment")).drop("_lane", "_segment")


def on_lanes(rows: DataFrame, per_track: DataFrame, frames: int = LANE_FRAMES) -> DataFrame:
    """rows with the columns of per_track (track_id, ...), joined by track and lane so that a hot track is spread; other tracks go."""
    rows = rows.withColumn("_lane", lane_of(F.col("frame"), frames))
    lanes = rows.select("track_id", "_lane").distinct().join(per_track, "track_id")
    return rows.join(lanes, ["track_id", "_lane"]).drop("_lane")
