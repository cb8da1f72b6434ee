"""Raw video: a reader and a writer of frames, pixels of boxes, drawn plans, and a boundary to detection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.appearance import crop_window
from . import drawing

#: Frames of one task.
FRAMES_PER_TASK = 64
FRAME_SCHEMA = "clip string, frame long, height int, width int, bgr binary"


@dataclass(frozen=True)
class VideoProperties:
    fps: float
    width: int
    height: int
    frames: int

    def __post_init__(self) -> None:
        if not 0 < self.fps < float("inf"):
            raise ValueError("fps must be positive and finite")
        if min(self.width, self.height, self.frames) <= 0:
            raise ValueError("video size and length must be positive")

    def frames_within(self, seconds: float | None) -> int:
        """How many frames a run of so many seconds reads."""
        return self.frames if seconds is None else min(self.frames, int(seconds * self.fps))


class _Raw:
    """A YUV4MPEG2 file (.y4m) with 4:2:0 colour: a header line, then frames of one size, so any frame is found by its number."""

    def __init__(self, path: str, default_fps: float | None = None):
        self.files, self.path = _store(path)
        size = self.files.get_file_info(self.path).size
        if size is None:
            raise FileNotFoundError(path)
        with self.files.open_input_file(self.path) as file:
            head = file.read(256).split(b"\n", 1)[0]
        marks = {m[:1]: m[1:] for m in head.split(b" ")[1:]}
        if not head.startswith(b"YUV4MPEG2") or not marks.get(b"C", b"420").startswith(b"420"):
            raise ValueError(f"{path} is not a YUV4MPEG2 video with 4:2:0 colour")
        self.width, self.height = int(marks[b"W"]), int(marks[b"H"])
        over, under = (int(x) for x in marks.get(b"F", b"0:0").split(b":"))
        fps = over / under if over and under else default_fps or 0.0
        self.luma, half = self.width * self.height, ((self.width + 1) // 2) * ((self.height + 1) // 2)
        self.begin, self.each = len(head) + 1, 6 + self.luma + 2 * half
        self.properties = VideoProperties(fps, self.width, self.height, (size - self.begin) // self.each)

    def read(self, numbers: Iterator[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers and blue, green, red bytes of the frames asked for; nothing else is read."""
        with self.files.open_input_file(self.path) as file:
            for n in numbers:
                file.seek(self.begin + n * self.each)
                yield n, self._decoded(n, file.read(self.each))

    def _decoded(self, n: int, data: bytes) -> np.ndarray:
        if data[:6] != b"FRAME\n" or len(data) != self.each:
            raise ValueError(f"{self.path}: frame {n} has parameters or is broken")
        w, h = (self.width + 1) // 2, (self.height + 1) // 2
        flat = np.frombuffer(data, np.uint8)[6:].astype(np.float64)
        y = flat[: self.luma].reshape(self.height, self.width)
        u, v = (p.reshape(h, w).repeat(2, 0).repeat(2, 1)[: self.height, : self.width] - 128 for p in (flat[self.luma : self.luma + w * h], flat[self.luma + w * h :]))
        y = (y - 16) * 1.164383
        bgr = np.stack([y + 2.017232 * u, y - 0.391762 * u - 0.812968 * v, y + 1.596027 * v], axis=-1)
        return np.clip(np.rint(bgr), 0, 255).astype(np.uint8)


def _store(path: str) -> tuple[Any, str]:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def probe(path: str, default_fps: float | None = None) -> VideoProperties:
    """Size, length and frame rate of a video; default_fps where its header has none."""
    return _Raw(path, default_fps).properties


@dataclass
class _Part(InputPartition):
    start: int
    end: int


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.first = options["path"], int(options.get("first", "0"))
        self.last = int(options["last"]) if "last" in options else None

    def partitions(self) -> list[InputPartition]:
        frames = _Raw(self.path, 1.0).properties.frames
        end = frames if self.last is None else min(frames, self.last + 1)
        return [_Part(k, min(k + FRAMES_PER_TASK, end)) for k in range(self.first, end, FRAMES_PER_TASK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        raw = _Raw(self.path, 1.0)
        for n, bgr in raw.read(iter(range(partition.start, partition.end))):  # type: ignore[attr-defined]
            yield self.path, n, raw.height, raw.width, bgr.tobytes()


class Frames(DataSource):
    """``frames``: the frames of a raw video; options path, first and last (frame numbers)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(dict(self.options))


def read_frames(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """clip, frame, height, width, bgr of the frames from first to last, read by tasks of a few each; one frame is a seek."""
    if first < 0:
        raise ValueError("frame numbers start at 0")
    spark.dataSource.register(Frames)
    reader = spark.read.format("frames").option("first", first)
    return (reader if last is None else reader.option("last", last)).load(path)


def _by_frame(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by runs of frames and sorted by frame, so that a task reads its frames once and in order."""
    return rows.repartition(F.floor(F.col("frame") / FRAMES_PER_TASK)).sortWithinPartitions("frame", *order)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Frame numbers and their rows, of rows sorted by frame; a frame may go on from batch to batch."""
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        ends = rows["frame"] == rows["frame"].iloc[-1]
        held = rows[ends]
        yield from ((int(n), own) for n, own in rows[~ends].groupby("frame", sort=False))  # type: ignore[call-overload]
    if held is not None and len(held):
        yield int(held["frame"].iloc[0]), held


def crop_pixels(detections: DataFrame, path: str, inset: float = 0.22) -> DataFrame:
    """track_id, frame, confidence, b, g, r of the pixels in the inner ellipse of each box of the video at path.

    Boxes go to the frames: they are dealt by runs of frames, and a task reads each frame
    that has a box once, by its place in the file.  Frames without a box are never read,
    and no frame is shuffled or copied for a box.  Boxes that are too small to read, and
    those of frames that are absent, have no pixels.
    """
    seen = probe(path, 1.0)
    window = crop_window(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(seen.width), F.lit(seen.height), inset)
    boxes = detections.filter(F.col("frame").between(0, seen.frames - 1)).select("track_id", F.col("frame").cast("long").alias("frame"), "confidence", window.alias("c")).filter("c IS NOT NULL")
    boxes = boxes.select("track_id", "frame", "confidence", *(F.col(f"c.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, waiting = _Raw(path, 1.0), []

        def wanted() -> Iterator[int]:
            for n, rows in _groups(batches):
                waiting.append(rows)
                yield n

        for n, image in raw.read(wanted()):
            for r in waiting.pop().itertuples(index=False):
                crop = image[r.y1 : r.y2, r.x1 : r.x2]
                h, w = crop.shape[:2]
                y, x = np.mgrid[:h, :w]
                a, b = max(1, w // 2 - 1), max(1, h // 2 - 1)
                inside = crop[((x - w // 2) / a) ** 2 + ((y - h // 2) / b) ** 2 <= 1].astype(int)
                yield pd.DataFrame({"track_id": r.track_id, "frame": n, "confidence": r.confidence, "b": inside[:, 0], "g": inside[:, 1], "r": inside[:, 2]})

    return _by_frame(boxes, "track_id").mapInPandas(cut, "track_id long, frame long, confidence double, b int, g int, r int")


class Detector(Protocol):
    """Turns the frames of one clip, in order, into detections with track ids; keeps its state between frames."""

    def detect(self, frame: int, bgr: np.ndarray) -> list[tuple[int | None, int, str, float, float, float, float, float]]:
        """Track id (or none), class id, class name, confidence, x1, y1, x2, y2 of what is in a frame."""
        ...


DETECTIONS = "clip string, frame long, track_id long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def detect(frames: DataFrame, make: Callable[[dict], Detector], settings: dict | None = None, every: int = 1) -> DataFrame:
    """Detections of each clip by a detector of its own, made on the executor from settings, which are passed on as they are.

    Clips are dealt to tasks and their frames streamed in order, so that state goes on
    from frame to frame and no clip is held in memory.
    """
    if every < 1:
        raise ValueError("every must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, detector = None, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples(index=False):
                if detector is None or r.clip != clip:
                    clip, detector = r.clip, make(settings or {})
                found = detector.detect(r.frame, np.frombuffer(r.bgr, np.uint8).reshape(r.height, r.width, 3))
                out += [(clip, r.frame, *d) for d in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DETECTIONS.split(", ")]).astype({"track_id": "Int64"})

    kept = frames.filter(F.col("frame") % every == 0)
    return kept.repartition("clip").sortWithinPartitions("clip", "frame").mapInPandas(run, DETECTIONS)


def output_fps(fps: float, every: int) -> float:
    """Frame rate of a video that shows every so many frames of another."""
    return max(1.0, fps / every)


def draw_plan(plan: DataFrame, path: str, every: int = 1, frames: int | None = None, scale: int = 2) -> DataFrame:
    """Every so many frames of the video at path, numbered anew from 0, with the boxes, trails and labels of a plan drawn in.

    plan has frame, x1, y1, x2, y2, label, color (b, g, r) and trail (trail_x, trail_y), as
    annotation_plan and evidence_drawing give it; a label stands above its box, or, where
    the plan has them, within left, top, right and bottom.  Later rows by seq cover earlier ones.  Frames without rows are shown
    as they are.  The plan's rows go to the frames, which are read in place and never
    shuffled; a task's frames are a run of the video.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    seen = probe(path, 1.0)
    end = seen.frames if frames is None else min(frames, seen.frames)
    at = [c for c in ("left", "top", "right", "bottom") if c in plan.columns]
    shown = plan.filter((F.col("frame") % every == 0) & F.col("frame").between(0, end - 1))
    points = F.transform("trail", lambda p: F.array(p["trail_x"].cast("int"), p["trail_y"].cast("int")))
    order = F.col("seq") if "seq" in plan.columns else F.xxhash64("x1", "y1", "x2", "y2", "label")
    corners = [F.bround(F.col(c).cast("double")).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    rows = shown.select(F.col("frame").cast("long").alias("frame"), order.alias("seq"), *corners, "label", "color", points.alias("trail"), *(F.col(c).cast("int").alias(c) for c in at))
    rows = plan.sparkSession.range(0, end, every).select(F.col("id").alias("frame")).unionByName(rows, allowMissingColumns=True)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, waiting = _Raw(path, 1.0), []

        def wanted() -> Iterator[int]:
            for n, own in _groups(batches):
                waiting.append(own[own["label"].notna() | own["x1"].notna()])
                yield n

        for n, image in raw.read(wanted()):
            image = image.copy()
            own = waiting.pop()
            for r in own.itertuples(index=False):
                drawing.line(image, [tuple(p) for p in r.trail] if r.trail is not None else [], r.color)
            for r in own.itertuples(index=False):
                drawing.box(image, int(r.x1), int(r.y1), int(r.x2), int(r.y2), r.color)
            for r in own.itertuples(index=False):
                if r.label and len(at) == 4:
                    drawing.label(image[: int(r.bottom), : int(r.right)], r.label, int(r.left), int(r.top), r.color, scale)
                elif r.label:
                    drawing.label(image, r.label, int(r.x1), int(r.y1) - drawing.text_size(r.label, scale)[1], r.color, scale)
            yield pd.DataFrame({"clip": [path], "frame": [n // every], "height": [raw.height], "width": [raw.width], "bgr": [image.tobytes()]})

    dealt = rows.repartitionByRange("frame").sortWithinPartitions("frame", "seq")
    return dealt.mapInPandas(draw, FRAME_SCHEMA)


def encoded(bgr: np.ndarray) -> bytes:
    """A frame of a raw video with 4:2:0 colour; the planes of an odd side are padded by their last pixels."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    y = 16 + 0.256788 * r + 0.504129 * g + 0.097906 * b
    u, v = 128 - 0.148223 * r - 0.290993 * g + 0.439216 * b, 128 + 0.439216 * r - 0.367788 * g - 0.071427 * b

    def halved(p: np.ndarray) -> np.ndarray:
        p = np.pad(p, ((0, p.shape[0] % 2), (0, p.shape[1] % 2)), mode="edge")
        return (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4

    return b"FRAME\n" + b"".join(np.clip(np.rint(p), 0, 255).astype(np.uint8).tobytes() for p in (y, halved(u), halved(v)))


@dataclass
class _Written(WriterCommitMessage):
    path: str
    first: int
    last: int
    width: int
    height: int


class _VideoWriter(DataSourceWriter):
    """Each task writes its frames, which must ascend, as a part of its own; the commit joins the parts in order and publishes them by one rename."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.fps = options["path"], Fraction(float(options["fps"])).limit_denominator(1001)
        if self.fps <= 0:
            raise ValueError("fps must be positive")
        files, path = _store(self.path)
        if not overwrite and files.get_file_info(path).type.name != "NotFound":
            raise FileExistsError(self.path)
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        files.create_dir(self.parts, recursive=True)

    def write(self, iterator: Iterator[Any]) -> WriterCommitMessage:
        files, _ = _store(self.path)
        out, done = None, _Written(f"{self.parts}/{uuid.uuid4().hex}", -1, -1, 0, 0)  # an attempt's own file
        try:
            for row in iterator:
                if out is None:
                    files.create_dir(self.parts, recursive=True)
                    out = files.open_output_stream(done.path)
                    done.first, done.width, done.height = row.frame, row.width, row.height
                if row.frame <= done.last or (row.width, row.height) != (done.width, done.height):
                    raise ValueError("frames must ascend and be of one size")
                done.last = row.frame
                out.write(encoded(np.frombuffer(row.bgr, np.uint8).reshape(row.height, row.width, 3)))
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, path = _store(self.path)
        parts = sorted((m for m in messages if isinstance(m, _Written) and m.first >= 0), key=lambda m: m.first)
        try:
            if any(b.first <= a.last or (a.width, a.height) != (b.width, b.height) for a, b in zip(parts, parts[1:])):
                raise ValueError("the frames of tasks overlap or differ in size")
            if not parts:
                raise ValueError("there are no frames to write")
            joined = f"{self.parts}/joined"
            with files.open_output_stream(joined) as out:
                out.write(f"YUV4MPEG2 W{parts[0].width} H{parts[0].height} F{self.fps.numerator}:{self.fps.denominator} Ip A1:1 C420jpeg\n".encode())
                for part in parts:
                    with files.open_input_stream(part.path) as source:
                        while block := source.read(8 << 20):  # bytes pass in blocks
                            out.write(block)
            files.move(joined, path)
        finally:
            files.delete_dir(self.parts)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = _store(self.path)
        if files.get_file_info(self.parts).type.name != "NotFound":
            files.delete_dir(self.parts)


class Video(DataSource):
    """``y4m``: frames written as one raw video; options path and fps."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _VideoWriter(dict(self.options), overwrite)


def write_video(frames: DataFrame, path: str, fps: float, overwrite: bool = False) -> None:
    """Frames (of draw_plan, or sorted runs of frames in partitions) as one raw video; a run that fails leaves what was there."""
    frames.sparkSession.dataSource.register(Video)
    frames.select("clip", F.col("frame").cast("long").alias("frame"), "height", "width", "bgr").write.format("y4m").option("path", path).option("fps", fps).mode("overwrite" if overwrite else "append").save()
