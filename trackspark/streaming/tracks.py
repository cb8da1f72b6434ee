"""Streams of track rows: sessions by gaps, and distinct tracks a second; both equal their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..schema import positive_fps


def with_event_time(rows: DataFrame, fps: float) -> DataFrame:
    """event_time of a frame, in whole microseconds from the epoch."""
    micros = F.floor(F.col("frame") * (1_000_000.0 / positive_fps(fps))).cast("long")
    return rows.withColumn("event_time", F.timestamp_micros(micros))


def session_segments(rows: DataFrame, fps: float, max_gap: int = 10, late: str = "10 seconds") -> DataFrame:
    """track_id, first_frame, last_frame, rows of each run without more than max_gap missing frames.

    A session ends one gap of (max_gap + 1) frames after its last row; rows exactly that
    far apart still join.  On a stream, sessions are emitted when the watermark passes.
    """
    gap = int((max_gap + 1) * 1_000_000 / positive_fps(fps))
    timed = with_event_time(rows, fps)
    timed = timed.withWatermark("event_time", late) if rows.isStreaming else timed
    found = timed.groupBy(F.session_window("event_time", f"{gap} microseconds"), "track_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("rows"))
    return found.select("track_id", "first_frame", "last_frame", "rows")


def tumbling_counts(rows: DataFrame, fps: float, late: str = "10 seconds") -> DataFrame:
    """second, class_name, visible_objects: exact distinct tracks; the state holds each second's track ids."""
    timed = with_event_time(rows, fps)
    timed = timed.withWatermark("event_time", late) if rows.isStreaming else timed
    counts = timed.groupBy(F.window("event_time", "1 second"), "class_name").agg(F.size(F.collect_set("track_id")).cast("long").alias("visible_objects"))
    return counts.select(F.unix_seconds("window.start").alias("second"), "class_name", "visible_objects")


def run_to_table(result: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and give the Parquet table at path that its last batch leaves."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    query = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/table")


def append_rows(rows: DataFrame, path: str, state: str, form: str = "csv"):
    """A query that appends raw rows to a folder as they come, each once, also after a restart; CSV parts have a header."""
    writer = rows.writeStream.outputMode("append").format(form).option("path", path).option("checkpointLocation", state)
    return writer.option("header", True).trigger(availableNow=True).start()


TRAIL = "frame long, track_id long, trail array<struct<x:int,y:int>>"


def bounded_trails(rows: DataFrame, length: int) -> DataFrame:
    """The last length points of each track at each row (frame, track_id, trail_x, trail_y), on a stream of rows in order.

    The state of a track is those points and nothing else, so it never grows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        points: list[tuple[int, int]] = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            out = []
            for r in batch.sort_values("frame", kind="stable").itertuples(index=False):
                points = [*points, (int(r.trail_x), int(r.trail_y))][-length:]
                out.append((r.frame, key[0], [{"x": x, "y": y} for x, y in points]))
            yield pd.DataFrame(out, columns=["frame", "track_id", "trail"])
        xs, ys = zip(*points)
        state.update((list(xs), list(ys)))

    return rows.groupBy("track_id").applyInPandasWithState(step, TRAIL, "xs array<int>, ys array<int>", "append", "NoTimeout")
