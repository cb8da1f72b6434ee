"""Processors that keep state of their own: rows in event-time order by key, distinct tracks of a second, bounded trails."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import positive_fps
from .tracks import with_event_time

#: Event time of frame 0; a stream's first watermark is the epoch, and rows of that very time would be late.
START_MS = 1000
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def timed(rows: DataFrame, fps: float, late: str) -> DataFrame:
    """rows with event_time, START_MS after the frame's time, and a watermark."""
    later = F.col("event_time") + F.expr(f"INTERVAL {START_MS} MILLISECONDS")
    return with_event_time(rows, fps).withColumn("event_time", later).withWatermark("event_time", late)


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """The session's streams keep their state in RocksDB, which these processors need; set back afterwards."""
    name, value = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_appended(result: DataFrame, path: str) -> None:
    """Run a stream over what is there now; its rows go to path/table, its state to path/state, from which the next run goes on."""
    with keyed_store(result.sparkSession):
        query = result.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class OrderedProcessor(StatefulProcessor):
    """Holds rows until the watermark has passed their frame, then hands them over in order; state of a key is what waits.

    A subclass names its columns (ROW, beginning with frame) and takes ordered rows in ``take``.  A row
    without anything but a frame says that the key is over and lets all out.  Rows wait as
    parts of BLOCK frames, an entry of the state each, so that neither a key's rows nor
    a single state value grow with what waits: memory is that of HELD rows or of a block.
    """

    ROW = "frame long"
    BLOCK, HELD = 4096, 50_000

    def __init__(self, fps: float):
        self.fps = positive_fps(fps)
        self.columns = [c.split()[0] for c in self.ROW.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long, part int", "rows binary")
        self.blocks = handle.getMapState("blocks", "block long", "parts int, first long")
        self.done = handle.getValueState("done", "frame long")

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def refuse(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows whose frame has been handed over already; by default they go."""
        yield from ()

    def _millis(self, frame: int) -> int:
        return int(frame * 1000.0 / self.fps) + START_MS

    def _wait(self, rows: pd.DataFrame) -> None:
        """A further part of each block that has some of the rows."""
        for block, part in rows.groupby(rows["frame"] // self.BLOCK):
            name, first = (int(block),), int(part["frame"].min())
            parts, before = self.blocks.getValue(name) if self.blocks.containsKey(name) else (0, first)
            self.waiting.updateValue((int(block), parts), (_packed(part),))
            self.blocks.updateValue(name, (parts + 1, min(first, before)))

    def _block(self, block: int, parts: int) -> pd.DataFrame:
        """A block's rows in order; they leave the state."""
        rows = pd.concat([pa.ipc.open_stream(self.waiting.getValue((block, i))[0]).read_pandas() for i in range(parts)], ignore_index=True)
        for i in range(parts):
            self.waiting.removeKey((block, i))
        self.blocks.removeKey((block,))
        return rows.sort_values([c for c in ("frame", "seq") if c in self.columns], kind="stable", ignore_index=True)

    def _advance(self, key: tuple, until: int | None) -> Iterator[pd.DataFrame]:
        """Hand over the frames whose time is up (all, if until is None), block by block; the others wait on."""
        first = None
        for (block,), (parts, least) in sorted((tuple(k), tuple(v)) for k, v in self.blocks.iterator()):
            if until is None or self._millis(least) < until:
                rows = self._block(block, parts)
                ready = rows["frame"].map(self._millis) < until if until is not None else pd.Series(True, rows.index)
                if ready.any():
                    yield from self.take(key, rows[ready])
                    self.done.update((int(rows.loc[ready, "frame"].iloc[-1]),))
                if ready.all():
                    continue
                self._wait(rows[~ready])
                least = int(rows.loc[~ready, "frame"].min())
            first = least if first is None else first
        if first is not None:
            self.handle.registerTimer(self._millis(first))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.done.get()[0] if self.done.exists() else None
        over, new, n = False, [], 0
        for batch in rows:
            batch = batch[self.columns]
            ends = batch.drop(columns="frame").isna().all(axis=1)
            over = over or bool(ends.any())
            late = (batch["frame"] <= last) & ~ends if last is not None else pd.Series(False, batch.index)
            if late.any():
                yield from self.refuse(key, batch[late])
            new.append(batch[~late & ~ends])
            n += len(new[-1])
            if n >= self.HELD:
                self._wait(pd.concat(new, ignore_index=True))
                new, n = [], 0
        if n:
            self._wait(pd.concat([b for b in new if len(b)], ignore_index=True))
        yield from self._advance(key, None if over else timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() + 1)

    def close(self) -> None:
        pass


class _Trails(OrderedProcessor):
    ROW = "frame long, seq long, trail_x int, trail_y int"

    def __init__(self, fps: float, length: int):
        super().__init__(fps)
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.points = handle.getValueState("points", "xs array<int>, ys array<int>")

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        points = list(zip(*self.points.get())) if self.points.exists() else []
        out = []
        for r in rows.itertuples(index=False):
            points = [*points, (int(r.trail_x), int(r.trail_y))][-self.length :]
            out.append((r.frame, key[0], r.seq, [{"x": x, "y": y} for x, y in points]))
        xs, ys = zip(*points)
        self.points.update((list(xs), list(ys)))
        yield pd.DataFrame(out, columns=["frame", "track_id", "seq", "trail"])


def ordered_trails(rows: DataFrame, fps: float, length: int, late: str = "10 seconds") -> DataFrame:
    """frame, track_id, seq, trail: the last length points of each track at each row (frame, track_id, seq, trail_x, trail_y).

    Rows may come in any order within late, also across batches; later ones are dropped.
    A track's state is length points and the rows that wait.
    """
    if length < 1:
        raise ValueError("a trail has at least one point")
    keyed = timed(rows, fps, late).select("track_id", "frame", "seq", "trail_x", "trail_y", "event_time").groupBy("track_id")
    return keyed.transformWithStateInPandas(_Trails(fps, length), "frame long, track_id long, seq long, trail array<struct<x:int,y:int>>", "append", "eventTime")


class _Seconds(StatefulProcessor):
    """Distinct tracks of a second and class, an entry of a map each; they leave with the second's only output."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "track_id long", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for track in pd.concat(list(rows), ignore_index=True)["track_id"].dropna().unique():
            if not self.seen.containsKey((int(track),)):
                self.seen.updateValue((int(track),), (1,))
        self.handle.registerTimer(int(key[0]) * 1000 + 1000 + START_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = sum(1 for _ in self.seen.keys())
        self.seen.clear()
        if n:
            yield pd.DataFrame({"second": [key[0]], "class_name": [key[1]], "visible_objects": [n]})

    def close(self) -> None:
        pass


def counted_seconds(rows: DataFrame, fps: float, late: str = "10 seconds") -> DataFrame:
    """second, class_name, visible_objects of a stream: exact distinct tracks, given once when the watermark passes the second.

    A new track is one entry in the state; no set is rewritten.
    """
    second = F.floor((F.unix_millis("event_time") - START_MS) / 1000).alias("second")
    keyed = timed(rows, fps, late).select(second, "class_name", "track_id", "event_time").groupBy("second", "class_name")
    return keyed.transformWithStateInPandas(_Seconds(), "second long, class_name string, visible_objects long", "append", "eventTime")
