"""The tracker on a stream: state by clip, frames in the order of event time, the same ids as the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ..operators.association import BOXES, Tracker, TrackerSettings, numbered
from ..schema import require_columns
from .state import OrderedProcessor, timed

ROW = "frame long, seq long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]
OUT = f"clip string, {ROW}, track_id long"


class _ClipTracker(OrderedProcessor):
    """State of a clip: its waiting rows, its tracks (live, fresh and lost within the buffer, so bounded), step and last number."""

    ROW, BLOCK = ROW, 8

    def __init__(self, fps: float, settings: TrackerSettings):
        super().__init__(fps)
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tracks = handle.getListState("tracks", "head array<long>, filter array<double>")
        self.clock = handle.getValueState("clock", "step long, given long")

    def _tracker(self) -> Tracker:
        step, given = self.clock.get() if self.clock.exists() else (0, 0)
        held = list(self.tracks.get()) if self.tracks.exists() else []
        heads = np.array([t[0] for t in held], np.int64).reshape(-1, 4)
        return Tracker(self.settings, step, given, heads, np.array([t[1] for t in held], float).reshape(-1, 4, 5))

    def _advance(self, key: tuple, until: int | None) -> Iterator[pd.DataFrame]:
        """As in general, with the clip's tracks read before the first block and written after the last."""
        self.tracker: Tracker | None = None
        yield from super()._advance(key, until)
        if self.tracker is None:
            return
        self.clock.update((self.tracker.step, self.tracker.given))
        if len(self.tracker.heads):
            self.tracks.put([(h.tolist(), f.ravel().tolist()) for h, f in zip(self.tracker.heads, self.tracker.filters)])
        else:
            self.tracks.clear()

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        self.tracker = self.tracker or self._tracker()
        for _, frame in rows.groupby("frame", sort=False):
            yield numbered(self.tracker, frame).assign(clip=key[0])[["clip", *_COLUMNS, "track_id"]]

    def refuse(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield rows.assign(clip=key[0], track_id=pd.array([None] * len(rows), "Int64"))[["clip", *_COLUMNS, "track_id"]]


def track_stream(detections: DataFrame, fps: float, settings: TrackerSettings = TrackerSettings(), late: str = "1 second") -> DataFrame:
    """Rows (clip, frame, seq, class_id, class_name, confidence, box) of a stream with the track_id that track_boxes gives.

    Rows may come in any order within late; what comes later is dropped, or after the clip's
    end given without a track.  A row of a clip with nothing but a frame above all others
    says that the clip is over and lets its last frames out.  Needs the RocksDB state
    store (see state.keyed_store); ids go on after a restart.
    """
    require_columns(detections, {"clip", *_COLUMNS, *BOXES}, "detections")
    keyed = timed(detections, fps, late).select("clip", *_COLUMNS, "event_time").groupBy("clip")
    return keyed.transformWithStateInPandas(_ClipTracker(fps, settings), OUT, "append", "eventTime")
