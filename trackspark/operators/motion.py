"""Motion along segments: first differences, quadratic least-squares smoothing, derivatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import segment_window
from ..functions.lanes import LANE_FRAMES, in_lanes
from ..schema import positive_fps, require_columns

#: Rows that a task gathers before it computes the segments that are complete.
_BLOCK = 20_000


def pixel_motion(rows: DataFrame, fps: float, lane_frames: int = LANE_FRAMES) -> DataFrame:
    """speed_px_s and acceleration_px_s2 by first differences; both are 0 on a segment's first row."""
    dt = 1.0 / positive_fps(fps)

    def body(rows: DataFrame) -> DataFrame:
        w = segment_window()
        step = F.hypot(F.col("ground_x_smooth") - F.lag("ground_x_smooth").over(w), F.col("ground_y_smooth") - F.lag("ground_y_smooth").over(w))
        rows = rows.withColumn("speed_px_s", F.coalesce(step, F.lit(0.0)) / dt)
        return rows.withColumn("acceleration_px_s2", F.coalesce(F.col("speed_px_s") - F.lag("speed_px_s").over(w), F.lit(0.0)) / dt)

    return in_lanes(rows, 2, body, lane_frames)


# kernels: columns of rows in order, with each row's number i in its segment and the segment's length n


def smooth(v: np.ndarray, i: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Quadratic least-squares smoothing (Savitzky & Golay 1964) of all segments at once.

    The window is the greater of 5 and window, at most the segment, and odd; the first
    and last half windows take the fit of the end window; fewer than 5 rows stay as they are.
    """
    widest = max(5, window)
    widest -= widest % 2 == 0
    size = np.minimum(widest, n)
    size = size - (size % 2 == 0)
    half = (size - 1) // 2
    out = v.copy()
    reach = widest // 2
    k = np.arange(-reach, reach + 1)
    mean = reach * (reach + 1) / 3
    q = ((k * k - mean) ** 2).sum()
    inner = np.flatnonzero((n >= 5) & (i > half) & (i < n - 1 - half))
    total = np.zeros(len(inner))
    for step, weight in zip(k, 1 / widest - mean * (k * k - mean) / q):
        total += v[inner + step] * weight
    out[inner] = total
    ends = np.flatnonzero((n >= 5) & ((i <= half) | (i >= n - 1 - half)))
    s, h = size[ends], half[ends].astype(float)
    late = i[ends] > half[ends]
    begin = ends - i[ends] + np.where(late, n[ends] - s, 0)
    e = (ends - begin) - h
    s0, s1, s2 = (np.zeros(len(ends)) for _ in range(3))
    for step in range(widest):
        inside = step < s
        value, place = np.where(inside, v[np.where(inside, begin + step, begin)], 0.0), step - h
        s0, s1, s2 = s0 + value, s1 + place * value, s2 + place * place * value
    spread, mean_at = h * (h + 1) * (2 * h + 1) / 3, h * (h + 1) / 3
    q_at = h * (h + 1) * (2 * h + 1) * (3 * h * h + 3 * h - 1) / 15 - s * mean_at * mean_at
    with np.errstate(divide="ignore", invalid="ignore"):
        out[ends] = s0 / s + e * s1 / spread + (e * e - mean_at) * (s2 - mean_at * s0) / q_at
    return out


def gradient(f: np.ndarray, x: np.ndarray, i: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Second-order finite differences of f by x in each segment; one-sided at the ends, 0 for one row."""
    at = np.arange(len(f))
    top = max(0, len(f) - 1)

    def near(values: np.ndarray, step: int) -> np.ndarray:
        return values[np.clip(at + step, 0, top)]

    with np.errstate(divide="ignore", invalid="ignore"):
        hs, hd = x - near(x, -1), near(x, 1) - x
        out = (hs * hs * near(f, 1) + (hd * hd - hs * hs) * f - hd * hd * near(f, -1)) / (hs * hd * (hs + hd))
        d1, d2 = near(x, 1) - x, near(x, 2) - near(x, 1)
        left = -(d1 * 2 + d2) / (d1 * (d1 + d2)) * f + (d1 + d2) / (d1 * d2) * near(f, 1) - d1 / (d2 * (d1 + d2)) * near(f, 2)
        e1, e2 = near(x, -1) - near(x, -2), x - near(x, -1)
        right = e2 / (e1 * (e1 + e2)) * near(f, -2) - (e1 + e2) / (e1 * e2) * near(f, -1) + (e2 * 2 + e1) / (e2 * (e1 + e2)) * f
        pair_first, pair_last = (near(f, 1) - f) / d1, (f - near(f, -1)) / hs
    first, last = i == 0, i == n - 1
    return np.select([n == 1, (n == 2) & first, n == 2, first, last], [np.zeros(len(f)), pair_first, pair_last, left, right], out)


def motion_columns(t: np.ndarray, x: np.ndarray, y: np.ndarray, i: np.ndarray, n: np.ndarray, unit: str, window: int) -> dict[str, np.ndarray]:
    """The ten motion columns of one coordinate pair; heading_deg is overwritten by the last call."""
    px, py = smooth(x, i, n, window), smooth(y, i, n, window)
    vx, vy = gradient(px, t, i, n), gradient(py, t, i, n)
    v = np.hypot(vx, vy)
    ax, ay = gradient(vx, t, i, n), gradient(vy, t, i, n)
    return {
        f"position_x_{unit}": px,
        f"position_y_{unit}": py,
        f"velocity_x_{unit}_s": vx,
        f"velocity_y_{unit}_s": vy,
        f"speed_{unit}_s": v,
        f"acceleration_x_{unit}_s2": ax,
        f"acceleration_y_{unit}_s2": ay,
        f"acceleration_magnitude_{unit}_s2": np.hypot(ax, ay),
        f"tangential_acceleration_{unit}_s2": gradient(v, t, i, n),
        "heading_deg": np.mod(np.degrees(np.arctan2(vy, vx)) + 360.0, 360.0),
    }


def _mover(pairs: list[tuple[str, str, str]], window: int, names: list[str]):
    """Adds the motion columns to a task's rows, which come sorted by segment and time, a block of whole segments at a time."""

    def changes(table: pa.Table) -> np.ndarray:
        """Whether each row but the first belongs to another segment than the one before."""
        out = np.zeros(table.num_rows - 1, bool)
        for c in ("track_id", "segment_id"):
            column = table.column(c).combine_chunks()
            a, b = column[1:], column[:-1]
            out |= ~pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        return out

    def numbers(table: pa.Table, c: str) -> np.ndarray:
        return table.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy()

    def move(table: pa.Table) -> Iterator[pa.RecordBatch]:
        fresh = np.append(True, changes(table))
        t = numbers(table, "timestamp_s")
        table = table.filter(pa.array(fresh | np.append(True, t[1:] != t[:-1])))  # of equal times the first, the highest frame
        fresh = np.append(True, changes(table))
        begin = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begin, len(fresh)))
        n, i = np.repeat(sizes, sizes), np.arange(len(fresh)) - np.repeat(begin, sizes)
        t, made = numbers(table, "timestamp_s"), {}
        for x, y, unit in pairs:
            made |= motion_columns(t, numbers(table, x), numbers(table, y), i, n, unit, window)
        for c in names:
            table = table.append_column(c, pa.array(made[c], pa.float64(), mask=np.isnan(made[c])))
        yield from table.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= _BLOCK:
                cuts = np.flatnonzero(changes(held))
                if len(cuts):  # the last segment may go on
                    yield from move(held.slice(0, int(cuts[-1]) + 1))
                    held = held.slice(int(cuts[-1]) + 1)
        if held is not None and held.num_rows:
            yield from move(held)

    return run


def kinematics(rows: DataFrame, window: int = 15, projected: DataFrame | None = None, quality: str | None = None, stop_speed_m_s: float = 0.5, lane_frames: int = LANE_FRAMES) -> DataFrame:
    """Pixel motion and, where rows carry x_m, y_m and inside (see geo), metric motion, km/h and the stopped flag.

    Without a projection no metric column exists.  Rows that repeat a segment's time
    count once, the one of the highest frame.  Segments are dealt to tasks in lanes with
    a halo of a window and what the derivatives reach, sorted, and computed in columns.
    """
    require_columns(rows, {"track_id", "segment_id", "frame", "timestamp_s", "ground_x_smooth", "ground_y_smooth"}, "trajectories")
    rows = projected if projected is not None else rows
    pairs = [("ground_x_smooth", "ground_y_smooth", "px"), *([("x_m", "y_m", "m")] if projected is not None else [])]
    names = list(dict.fromkeys(c for p in pairs for c in motion_columns(*[np.zeros(0)] * 3, *[np.zeros(0, int)] * 2, p[2], 5)))

    def body(lanes: DataFrame) -> DataFrame:
        lanes = lanes.drop(*names)
        schema = T.StructType([*lanes.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])
        return lanes.repartition("track_id", "segment_id").sortWithinPartitions("track_id", "segment_id", "timestamp_s", F.desc("frame")).mapInArrow(_mover(pairs, window, names), schema)

    rows = in_lanes(rows, max(5, window) + 8, body, lane_frames)
    if projected is not None:
        rows = rows.withColumns({"speed_kmh": F.col("speed_m_s") * 3.6, "inside_calibration_region": F.col("inside"), "metric_calibration_quality": F.lit(quality), "stopped": F.col("speed_m_s") < stop_speed_m_s}).drop("x_m", "y_m", "inside")
    else:
        rows = rows.withColumns({"inside_calibration_region": F.lit(False), "metric_calibration_quality": F.lit("unavailable"), "stopped": F.lit(False)})
    return rows
