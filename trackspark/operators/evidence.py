"""What an evidence video would show: which objects, where, with what label and trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import box_area, let

#: Fixed values of the data format.
SIZE_SHORT = {"small_passenger_vehicle": "S", "medium_passenger_vehicle": "M", "large_passenger_vehicle": "L", "two_wheeler": "2W", "heavy_vehicle": "HGV"}
COLOR_SHORT = {"silver_gray": "gray"}


def _duration() -> Column:
    """duration_s without the last bits that differences of times leave: as many frames are as long, wherever they begin."""
    return F.round("duration_s", 9)


def longest_segments(objects: DataFrame) -> DataFrame:
    """Each track's longest segment, ties to the smaller segment_id."""
    w = Window.partitionBy("track_id").orderBy(_duration().desc(), "segment_id")
    return objects.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def stable_tracks(objects: DataFrame, seconds: float = 2.0, consistency: float = 0.80, color: float = 0.55, displacement_px: float = 12.0) -> DataFrame:
    """Longest segments that last, keep their class and colour and move; the defaults are fixed values of the evidence format."""
    good = (_duration() >= seconds) & (F.col("raw_class_consistency") >= consistency) & (F.col("color_confidence") >= color) & (F.col("displacement_px") >= displacement_px)
    return longest_segments(objects).filter(good)


def shown_rows(raw: DataFrame, tracks: DataFrame, least_confidence: float, most: int) -> DataFrame:
    """The most best-scored confident rows of tracks in each frame, ties to the earlier row."""
    rows = raw.filter(F.col("confidence") >= least_confidence).join(tracks.select("track_id"), "track_id", "left_semi")
    rows = rows.withColumn("box_area_px2", box_area()).withColumn("display_score", F.col("confidence") * F.sqrt(F.greatest(F.col("box_area_px2"), F.lit(1.0))))
    order = "seq" if "seq" in rows.columns else "track_id"
    place = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("display_score"), order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def scaled_boxes(rows: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """Boxes in output pixels and the point that a trail passes through."""
    rows = rows.withColumns({f"o{c}": (F.col(c) * s).cast("int") for c, s in (("x1", scale_x), ("x2", scale_x), ("y1", scale_y), ("y2", scale_y))})
    return rows.withColumns({"trail_x": F.floor((F.col("ox1") + F.col("ox2")) / 2).cast("int"), "trail_y": F.col("oy2")})


def trails(rows: DataFrame, length: int) -> DataFrame:
    """The last length shown points of each track at each shown row, oldest first."""
    w = Window.partitionBy("track_id").orderBy("frame", "seq").rowsBetween(-(length - 1), 0)
    return rows.withColumn("trail", F.collect_list(F.struct("trail_x", "trail_y")).over(w))


def short_name(column: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for long, short in names.items():
        out = F.when(column == long, short).otherwise(out)
    return F.coalesce(out, column)


def labels(rows: DataFrame, objects: DataFrame, kinematics: DataFrame) -> DataFrame:
    """A label for each shown row: number, colour, size and, inside the projection's region, speed."""
    insight = longest_segments(objects).select("track_id", "dominant_color", "relative_size_class")
    rows = rows.join(insight, "track_id")
    metric = "speed_kmh" in kinematics.columns
    if metric:
        speeds = kinematics.groupBy("frame", "track_id").agg(F.min_by("speed_kmh", "segment_id").alias("_v"), F.min_by("inside_calibration_region", "segment_id").alias("_in"))
        rows = rows.join(speeds, ["frame", "track_id"], "left")
    speed = F.when(F.col("_in"), F.concat(F.lit(" ~"), F.bround("_v").cast("long").cast("string"), F.lit("km/h"))) if metric else F.lit(None).cast("string")
    color, size = F.coalesce("dominant_color", F.lit("unknown")), F.coalesce("relative_size_class", F.lit("unknown"))
    label = F.concat(F.lit("#"), F.col("track_id").cast("string"), F.lit(" "), short_name(color, COLOR_SHORT), F.lit(" "), short_name(size, SIZE_SHORT), F.coalesce(speed, F.lit("")))
    return rows.withColumn("label", label).drop("_v", "_in")


def overlapping_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of shown boxes of one frame that overlap; a frame shows a bounded number, touching is no overlap."""
    a = rows.select("frame", F.col("place").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("ox1", "oy1", "ox2", "oy2")))
    b = rows.select("frame", F.col("place").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("ox1", "oy1", "ox2", "oy2")))
    hit = (F.col("a_ox1") < F.col("b_ox2")) & (F.col("a_ox2") > F.col("b_ox1")) & (F.col("a_oy1") < F.col("b_oy2")) & (F.col("a_oy2") > F.col("b_oy1"))
    return a.join(b, "frame").filter((F.col("a") < F.col("b")) & hit).select("frame", "a", "b")


#: Fixed values of the evidence format: where a label may stand, from its box, in this order.
SLOTS = (("x1", "y1", 0, -7, -1), ("x1", "y2", 0, 7, 1), ("x2", "y1", 3, 3, 0))


def pack_labels(rows: DataFrame, width: int, height: int, char_width: int = 7, text_height: int = 9, baseline: int = 4) -> DataFrame:
    """frame, place, slot and background of each label: the first of three slots that is not empty and free; slot is null if none is.

    A fold over each frame's few shown rows in their order, in the JVM; text is as wide
    as its characters, since fonts belong to a drawing adapter.
    """
    box = "struct<left:int,top:int,right:int,bottom:int>"
    kind = "array<struct<place:int,slot:int,left:int,top:int,right:int,bottom:int>>"

    def options(r: Column) -> Column:
        out = []
        for slot, (ax, ay, dx, dy, side) in enumerate(SLOTS):
            tx = r[ax] + dx
            ty = r[ay] + dy + (side * (text_height + baseline) if side else text_height)
            edges = (F.greatest(F.lit(0), tx - 2), F.greatest(F.lit(0), ty - text_height - 3), F.least(F.lit(width - 1), tx + F.length(r["label"]) * char_width + 3), F.least(F.lit(height - 1), ty + baseline + 2))
            out.append(F.struct(F.lit(slot).alias("slot"), *(e.cast("int").alias(n) for e, n in zip(edges, ("left", "top", "right", "bottom")))))
        return F.array(*out)

    def step(seen: Column, r: Column) -> Column:
        def fits(o: Column) -> Column:
            hit = F.exists(seen["taken"], lambda u: (o["left"] < u["right"]) & (o["right"] > u["left"]) & (o["top"] < u["bottom"]) & (o["bottom"] > u["top"]))
            return (o["right"] > o["left"]) & (o["bottom"] > o["top"]) & ~hit

        def put(o: Column) -> Column:
            edges = [o[n].alias(n) for n in ("left", "top", "right", "bottom")]
            taken = F.when(o.isNotNull(), F.concat(seen["taken"], F.array(F.struct(*edges)))).otherwise(seen["taken"])
            return F.struct(taken.alias("taken"), F.concat(seen["out"], F.array(F.struct(r["place"].cast("int").alias("place"), o["slot"].alias("slot"), *edges))).alias("out"))

        return let(F.get(F.filter(options(r), fits), 0), put)

    inputs = F.array_sort(F.collect_list(F.struct("place", "label", *(F.col(f"o{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))))
    start = F.struct(F.array().cast(f"array<{box}>").alias("taken"), F.array().cast(kind).alias("out"))
    packed = rows.groupBy("frame").agg(F.aggregate(inputs, start, step, lambda s: s["out"]).alias("labels"))
    return packed.select("frame", F.inline("labels"))


#: Fixed values of the evidence format: the blue, green and red of a colour family's boxes.
BOX_COLORS = {
    "black": (80, 80, 80),
    "white": (245, 245, 245),
    "silver_gray": (180, 180, 180),
    "red": (40, 40, 230),
    "orange": (40, 150, 245),
    "yellow": (40, 225, 245),
    "green": (70, 200, 70),
    "blue": (230, 130, 40),
    "purple": (210, 80, 200),
}


def box_color(name: Column) -> Column:
    """b, g, r of a box by its colour family, white for all others."""
    out = F.lit(None)
    for k, bgr in BOX_COLORS.items():
        out = F.when(name == k, F.array(*map(F.lit, bgr))).otherwise(out)
    return F.coalesce(out, F.array(F.lit(255), F.lit(255), F.lit(255)))


def track_color(track: Column) -> Column:
    """b, g, r of a track's boxes and trail, bright and the same in every run."""
    spread = F.xxhash64(track)
    return F.array(*(F.pmod(F.shiftright(spread, 8 * k), F.lit(176)).cast("int") + 80 for k in range(3)))


def evidence_drawing(rows: DataFrame, width: int, height: int, char_width: int = 8) -> DataFrame:
    """The plan of an evidence video from labelled rows with trails: boxes by colour, labels where pack_labels puts them, none where there is no room.

    char_width is that of the drawn glyphs, so that a label fits its place.
    """
    packed = pack_labels(rows, width, height, char_width)
    rows = rows.join(packed, ["frame", "place"], "left")
    return rows.select("frame", F.col("place").alias("seq"), *(F.col(f"o{c}").alias(c) for c in ("x1", "y1", "x2", "y2")), F.when(F.col("slot").isNotNull(), F.col("label")).alias("label"), box_color(F.col("dominant_color")).alias("color"), "trail", "left", "top", "right", "bottom")


def annotation_plan(raw: DataFrame, length: int = 20, every: int = 1) -> DataFrame:
    """What a tracking video shows: of every frame kept its boxes, labels, track colours and trails."""
    rows = raw.filter(F.col("frame") % every == 0).withColumns({"trail_x": F.floor("ground_x").cast("int"), "trail_y": F.floor("ground_y").cast("int")})
    rows = trails(rows if "seq" in rows.columns else rows.withColumn("seq", F.xxhash64(*rows.columns)), length)
    label = F.concat(F.lit("#"), F.col("track_id").cast("string"), F.lit(" "), F.col("class_name"))
    return rows.select("frame", "track_id", "seq", "x1", "y1", "x2", "y2", label.alias("label"), track_color(F.col("track_id")).alias("color"), "trail")


def top_segment_profiles(objects: DataFrame, kinematics: DataFrame, most: int = 12) -> DataFrame:
    """Speed over time of the most longest segments; metric and inside the region where there is a projection."""
    top = objects.orderBy(_duration().desc(), "track_id", "segment_id").limit(most).select("track_id", "segment_id")
    metric = "speed_kmh" in kinematics.columns
    rows = (kinematics.filter("inside_calibration_region") if metric else kinematics).join(F.broadcast(top), ["track_id", "segment_id"])
    return rows.select("track_id", "segment_id", "timestamp_s", F.col("speed_kmh" if metric else "speed_px_s").alias("speed"))
