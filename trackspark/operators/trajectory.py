"""Clean trajectories: one row a frame, stable classes, gap-free segments, interpolated and smoothed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import middle, no_nan
from ..functions.lanes import LANE_FRAMES, in_lanes, lane_of, on_lanes
from ..schema import CLEAN_NEEDS, INTERPOLATED, positive_fps, require_columns


def _order(df: DataFrame) -> Column:
    """What tells the later of two rows of one track and frame: seq, or else a hash of the row."""
    return F.col("seq") if "seq" in df.columns else F.xxhash64(*df.columns)


def least_observations(fps: float, min_seconds: float) -> int:
    return max(2, int(round(min_seconds * positive_fps(fps))))


def latest_rows(raw: DataFrame, *more: str) -> DataFrame:
    """One row for each track and frame, the latest; more names columns that follow from track and frame and by which rows are dealt."""
    place = F.row_number().over(Window.partitionBy("track_id", *more, "frame").orderBy(_order(raw).desc()))
    return raw.withColumn("_place", place).filter("_place = 1").drop("_place")


def modal_classes(rows: DataFrame) -> DataFrame:
    """track_id, class_id, class_name: the most frequent id, and the most frequent name among its rows; ties to the smallest, nulls only if there is nothing else."""
    counts = rows.groupBy("track_id", "class_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("of_id", F.sum("n").over(Window.partitionBy("track_id", "class_id")))  # a row for each class of a track
    known = F.struct(F.col("class_id").isNull(), -F.col("of_id"), "class_id", F.col("class_name").isNull(), -F.col("n"), "class_name")
    return counts.groupBy("track_id").agg(F.min_by(F.struct("class_id", F.when(F.col("class_id").isNotNull(), F.col("class_name")).alias("class_name")), known).alias("c")).select("track_id", "c.*")


def stable_classes(rows: DataFrame, lane_frames: int = LANE_FRAMES) -> DataFrame:
    """class_id and class_name replaced by the track's modal ones."""
    columns = rows.columns
    return on_lanes(rows.drop("class_id", "class_name"), modal_classes(rows), lane_frames).select(*columns)


# Segments of tracks that are dealt in lanes: what a lane must know of the others is found from one summary row of each lane.

def _run():
    return Window.partitionBy("track_id", "_lane", "_part")


def _parts(rows: DataFrame, max_gap: int) -> DataFrame:
    """_part, the number of a row's run within its lane, and _parts, the last such number."""
    lane = Window.partitionBy("track_id", "_lane")
    cut = F.coalesce((F.col("frame") - F.lag("frame").over(lane.orderBy("frame")) > max_gap + 1).cast("int"), F.lit(0))
    rows = rows.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(lane.orderBy("frame")).cast("long")).drop("_cut")
    return rows.withColumn("_parts", F.max("_part").over(lane))


def _known(c: str) -> Column:
    return F.struct(F.col(c).alias("v"), F.col("frame").alias("f"))


def _lanes(rows: DataFrame, max_gap: int, values: list[str]) -> DataFrame:
    """A row for each track and lane: _base, the number of its first segment; _n, the track's rows; _head_n and _tail_n, the
    rows of its first and last segment, in all lanes; _after, the frame that follows its last one in that segment; for each of
    values the last known one before its first segment's rows and the first known one after its last segment's (_prev_, _next_).

    Windows here run over lanes, not rows: 1 / LANE_FRAMES of the input.
    """
    first, last = F.col("_part") == 0, F.col("_part") == F.col("_parts")
    found = []
    for c in values:
        has = F.col(c).isNotNull()
        found += [F.min_by(_known(c), F.when(first & has, F.col("frame"))).alias(f"_first_{c}"), F.max_by(_known(c), F.when(last & has, F.col("frame"))).alias(f"_last_{c}")]
    lanes = rows.groupBy("track_id", "_lane").agg(F.min("frame").alias("_from"), F.max("frame").alias("_to"), F.max("_part").alias("_parts"), F.count(F.lit(1)).alias("_rows"), F.count_if(first).alias("_head"), F.count_if(last).alias("_tail"), *found)
    track = Window.partitionBy("track_id").orderBy("_lane")
    goes_on = F.lead("_from").over(track) - F.col("_to") <= max_gap + 1
    apart = F.coalesce((F.col("_from") - F.lag("_to").over(track) > max_gap + 1).cast("long"), F.lit(0))
    lanes = lanes.withColumns({"_apart": apart, "_after": F.when(goes_on, F.lead("_from").over(track)), "_n": F.sum("_rows").over(Window.partitionBy("track_id"))})
    lanes = lanes.withColumn("_base", F.sum(F.col("_parts") + F.col("_apart")).over(track) - F.col("_parts"))
    single = F.col("_parts") == 0
    entry = [F.struct(F.lit(True).alias("head"), single.alias("tail"), F.col("_base").alias("number"), F.col("_head").alias("n"), *(F.col(f"_first_{c}").alias(f"f_{c}") for c in values), *(F.when(single, F.col(f"_last_{c}")).alias(f"l_{c}") for c in values))]
    entry.append(F.when(~single, F.struct(F.lit(False).alias("head"), F.lit(True).alias("tail"), (F.col("_base") + F.col("_parts")).alias("number"), F.col("_tail").alias("n"), *(F.lit(None).cast(lanes.schema[f"_first_{c}"].dataType).alias(f"f_{c}") for c in values), *(F.col(f"_last_{c}").alias(f"l_{c}") for c in values))))
    ends = lanes.select("track_id", "_lane", "_base", "_n", "_after", F.explode(F.array_compact(F.array(*entry))).alias("e"))
    segment = Window.partitionBy("track_id", "e.number")
    before, after = segment.orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1), segment.orderBy("_lane").rowsBetween(1, Window.unboundedFollowing)
    sides = {f"p_{c}": F.last(f"e.l_{c}", True).over(before) for c in values} | {f"q_{c}": F.first(f"e.f_{c}", True).over(after) for c in values}
    ends = ends.withColumns({"total": F.sum("e.n").over(segment), **sides})
    head, tail = F.col("e.head"), F.col("e.tail")
    out = [F.max(F.when(head, F.col("total"))).alias("_head_n"), F.max(F.when(tail, F.col("total"))).alias("_tail_n")]
    out += [F.max(F.when(head, F.col(f"p_{c}"))).alias(f"_prev_{c}") for c in values] + [F.max(F.when(tail, F.col(f"q_{c}"))).alias(f"_next_{c}") for c in values]
    return ends.groupBy("track_id", "_lane", "_base", "_n", "_after").agg(*out)


def _numbered(rows: DataFrame, lanes: DataFrame, least: int) -> DataFrame:
    """rows (of _parts) with their lane's columns and segment_id; short segments go, their numbers stay used."""
    rows = rows.join(lanes, ["track_id", "_lane"])
    size = F.when(F.col("_part") == 0, F.col("_head_n")).when(F.col("_part") == F.col("_parts"), F.col("_tail_n")).otherwise(F.count(F.lit(1)).over(_run()))
    number = (F.col("_base") + F.col("_part")).cast("string")
    return rows.withColumns({"segment_id": F.concat(F.col("track_id").cast("string"), F.lit("-"), number), "_size": size}).filter(F.col("_size") >= least).drop("_size")


def split_segments(rows: DataFrame, max_gap: int, least: int, lane_frames: int = LANE_FRAMES) -> DataFrame:
    """segment_id added: a new segment begins after more than max_gap missing frames; segments of fewer than least rows go, their numbers stay used."""
    columns = rows.columns
    dealt = _parts(rows.withColumn("_lane", lane_of(F.col("frame"), lane_frames)).repartition("track_id", "_lane"), max_gap)
    return _numbered(dealt, _lanes(dealt, max_gap, []), least).select(*columns, "segment_id")


def _neighbours(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each of names the last known value up to a row (_a_) and the first one after it (_b_) in its segment, with their frames.

    Taken over real rows, before the frames between them are put in.
    """
    up = _run().orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    down = _run().orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.col("_part") == 0, F.col("_part") == F.col("_parts")

    def near(c: str, window, end: Column, beyond: str) -> Column:
        return F.coalesce(F.last(F.when(F.col(c).isNotNull(), _known(c)), True).over(window), F.when(end, F.col(beyond)))

    rows = rows.withColumns({f"_b_{c}": near(c, down, last, f"_next_{c}") for c in names})
    return rows.withColumns({f"_a_{c}": near(c, up, first, f"_prev_{c}") for c in names})


def _densify(rows: DataFrame, fps: float, limit: int, names: list[str]) -> DataFrame:
    """A row for every frame of a segment; observed tells real rows, whose columns the others lack.

    Of names, values that are missing lie on a line between their neighbours, and beyond
    the first and last are those, up to limit frames from a value.
    """
    following = F.coalesce(F.lead("frame").over(_run().orderBy("frame")), F.when(F.col("_part") == F.col("_parts"), F.col("_after")))
    keys = ("track_id", "segment_id", "class_id", "class_name")
    rows = rows.withColumn("_to", F.coalesce(following - 1, F.col("frame")))
    rows = rows.withColumn("_frame", F.explode(F.sequence("frame", "_to")))
    frame, real = F.col("_frame"), F.col("_frame") == F.col("frame")

    def filled(c: str) -> Column:
        prev, after = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        back, ahead = frame - prev["f"], after["f"] - frame
        line = prev["v"] + (after["v"] - prev["v"]) * (back / (back + ahead))
        value = F.when(prev.isNull(), F.when(ahead <= limit, after["v"])).when(after.isNull(), F.when(back <= limit, prev["v"])).when((back <= limit) | (ahead <= limit), line)
        return F.when(real & F.col(c).isNotNull(), F.col(c)).otherwise(value)

    values = {c: filled(c) if c in names else F.when(real, F.col(c)) for c in rows.columns if c not in (*keys, "frame", "timestamp_s") and not c.startswith("_")}
    rows = rows.withColumns({**values, "observed": real}).withColumn("frame", frame)
    rows = rows.withColumn("timestamp_s", F.col("frame").cast("double") / F.lit(float(fps)))
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def rolling_median(rows: DataFrame, columns: dict[str, str], window: int) -> DataFrame:
    """Centred rolling medians over window frames, or over the segment's length where that is less; new names to columns."""
    part = Window.partitionBy("track_id", "segment_id")
    rows = rows.withColumn("_w", F.least(F.lit(window), F.count(F.lit(1)).over(part)).cast("int"))
    line = part.orderBy("frame")
    low, high = -F.floor(F.col("_w") / 2), F.floor((F.col("_w") - 1) / 2)

    def median(c: str) -> Column:
        # rows of a segment are dense, so neighbours in frames are neighbours in rows
        near = [F.lag(c, -k).over(line) if k < 0 else F.lead(c, k).over(line) if k else F.col(c) for k in range(-(window // 2), window // 2 + 1)]
        inside = [F.when(F.lit(k).between(low, high), v) for k, v in zip(range(-(window // 2), window // 2 + 1), near)]
        return middle(F.array_compact(F.array(*inside)))

    return rows.withColumns({new: median(c) for new, c in columns.items()}).drop("_w")


def clean(raw: DataFrame, fps: float, min_seconds: float = 0.5, max_gap: int = 10, window: int = 5, lane_frames: int = LANE_FRAMES) -> DataFrame:
    """All steps in one lineage: rows are dealt by track and lane, and once more for the rolling median.

    A track of a third of all rows is spread over tasks: no window runs over a track's
    rows.  NaN counts as null.  Extra columns pass through and are null in filled rows.
    """
    require_columns(raw, CLEAN_NEEDS, "raw tracks")
    least = least_observations(fps, min_seconds)
    floats = [c for c, kind in raw.dtypes if kind in ("double", "float")]
    raw = raw.withColumns({c: no_nan(F.col(c)) for c in floats}) if floats else raw
    names = [c for c in INTERPOLATED if c in raw.columns]
    rows = latest_rows(raw.withColumn("_lane", lane_of(F.col("frame"), lane_frames)).repartition("track_id", "_lane"), "_lane")
    parts = _parts(rows, max_gap)
    lanes = _lanes(parts, max_gap, names).filter(F.col("_n") >= least).join(modal_classes(rows), "track_id")
    rows = _densify(_neighbours(_numbered(parts.drop("class_id", "class_name"), lanes, least), names), fps, max_gap, names)
    return in_lanes(rows, window, lambda r: rolling_median(r, {"ground_x_smooth": "ground_x", "ground_y_smooth": "ground_y"}, window), lane_frames)
