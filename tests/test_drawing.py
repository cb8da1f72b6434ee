"""Drawn videos read back against a plain drawing; crops that read their own frames only; writes that fail leave nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import appearance, evidence
from trackspark.sources import drawing, video

W, H, N = 64, 48, 90


@pytest.fixture(scope="module")
def clip(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clip") / "c.y4m")
    with open(path, "wb") as out:
        out.write(f"YUV4MPEG2 W{W} H{H} F10:1 Ip A1:1 C420jpeg\n".encode())
        for f in range(N):
            out.write(video.encoded(np.full((H, W, 3), (30 + f, 60, 90), np.uint8)))
    return path


PLAN = "frame long, seq long, x1 double, y1 double, x2 double, y2 double, label string, color array<int>, trail array<struct<trail_x:int,trail_y:int>>"


def plan_rows():
    return [(f, f * 10 + k, 8.0 + 2 * (f % 10) + 20 * k, 20.0, 24.0 + 2 * (f % 10) + 20 * k, 40.0, f"#{k}" if f % 2 else None, [250, 240 - 100 * k, 20], [(4 + 2 * j, 44) for j in range(f % 5)]) for f in range(0, N, 3) for k in range(2)]


def plainly_drawn(f):
    """A frame by loops over pixels."""
    image = np.empty((H, W, 3), np.uint8)
    image[:] = (30 + f, 60, 90)

    def dot(x, y, c):
        if 0 <= x < W and 0 <= y < H:
            image[y, x] = c

    own = [r for r in plan_rows() if r[0] == f]
    for r in own:
        for (ax, ay), (bx, _) in zip(r[8], r[8][1:]):
            for x in range(ax, bx + 1):
                for dx in (0, 1):
                    for dy in (0, 1):
                        dot(x + dx, ay + dy, r[7])
    for r in own:
        x1, y1, x2, y2 = map(int, r[2:6])
        for x in range(x1, x2):
            for y in range(y1, y2):
                if x < x1 + 2 or x >= x2 - 2 or y < y1 + 2 or y >= y2 - 2:
                    dot(x, y, r[7])
    for r in own:
        if r[6]:
            x, y = int(r[2]), int(r[3]) - 14
            for dx in range(2 * (4 * len(r[6]) + 1)):
                for dy in range(14):
                    column, row = dx // 2 - 1, dy // 2 - 1
                    sign, place = divmod(column, 4) if column >= 0 else (0, 3)
                    on = 0 <= row < 5 and place < 3 and sign < len(r[6]) and int(drawing.GLYPHS[r[6][sign]][row]) >> (2 - place) & 1
                    dot(x + dx, y + dy, r[7] if on else (0, 0, 0))
    return image


@pytest.mark.parametrize("every", [1, 3])
def test_a_drawn_video_equals_a_plain_drawing(spark, clip, tmp_path, every):
    plan = spark.createDataFrame(plan_rows() + [(500, 1, 0.0, 0.0, 9.0, 9.0, "x", [1, 2, 3], [])], PLAN).repartition(3)
    out = str(tmp_path / "drawn.y4m")
    video.write_video(video.draw_plan(plan, clip, every), out, video.output_fps(10.0, every))
    assert os.listdir(tmp_path) == ["drawn.y4m"]  # no parts are left
    seen = video.probe(out)
    assert (seen.fps, seen.width, seen.height, seen.frames) == (10.0 / every, W, H, -(-N // every))
    got = {r.frame: np.frombuffer(r.bgr, np.uint8).reshape(H, W, 3) for r in video.read_frames(spark, out).collect()}
    for f in range(0, N, every):
        raw = video.encoded(plainly_drawn(f))
        luma = np.frombuffer(raw, np.uint8)[6 : 6 + W * H].reshape(H, W)
        again = np.frombuffer(video.encoded(got[f // every]), np.uint8)[6 : 6 + W * H].reshape(H, W)
        inside = np.abs(luma.astype(int) - again.astype(int)) <= 12  # colours are halved and cut off, brightness stays
        assert inside.mean() > 0.97, f


def test_a_failed_write_leaves_what_was_there(spark, clip, tmp_path):
    out = str(tmp_path / "v.y4m")
    frames = video.read_frames(spark, clip, 0, 9)
    video.write_video(frames, out, 10.0)
    before = open(out, "rb").read()
    with pytest.raises(Exception, match="v.y4m"):
        video.write_video(frames, out, 10.0)
    fails = frames.withColumn("height", F.when(F.col("frame") == 5, F.col("height") + 1).otherwise(F.col("height")))
    for bad in (fails, frames.filter("false"), frames.unionAll(frames)):
        with pytest.raises(Exception):
            video.write_video(bad, out, 10.0, overwrite=True)
    assert open(out, "rb").read() == before and os.listdir(tmp_path) == ["v.y4m"]
    video.write_video(video.read_frames(spark, clip, 3, 4), out, 10.0, overwrite=True)
    assert video.probe(out).frames == 2


def test_crops_read_only_frames_with_boxes(spark, clip, tmp_path):
    data = bytearray(open(clip, "rb").read())
    each = 6 + W * H * 3 // 2
    begin = len(data) - N * each
    for f in range(N):
        if f not in (7, 70):
            data[begin + f * each : begin + f * each + 6] = b"BROKEN"
    broken = str(tmp_path / "b.y4m")
    open(broken, "wb").write(data)
    boxes = spark.createDataFrame([(1, 7, 0.9, 5.0, 5.0, 40.0, 40.0), (2, 7, 0.8, 10.0, 10.0, 30.0, 30.0), (3, 70, 0.7, 0.0, 0.0, 20.0, 20.0), (4, 400, 0.9, 0.0, 0.0, 20.0, 20.0), (5, -1, 0.9, 0.0, 0.0, 20.0, 20.0)], "track_id long, frame long, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = video.crop_pixels(boxes.repartition(4), broken)
    sizes = {r.track_id: r.n for r in got.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(sizes) == {1, 2, 3}
    window = appearance.crop_window(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(W), F.lit(H))
    cells = boxes.select("track_id", window.alias("c")).selectExpr("track_id", "c.x2 - c.x1 AS w", "c.y2 - c.y1 AS h").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    want = {r.track_id: r.n for r in cells.filter(appearance.in_ellipse(*map(F.col, "xywh"))).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {k: want[k] for k in sizes}
    assert got.filter("frame = 7 AND abs(b - 37) > 2").isEmpty()
    with pytest.raises(Exception, match="broken"):
        video.crop_pixels(boxes.withColumn("frame", F.col("frame") + 1), broken).count()


def test_text_sizes_and_glyphs():
    assert drawing.text_size("#12 car", 2) == (2 * 29, 14)
    assert all(len(g) == 5 and set(g) <= set("01234567") for g in drawing.GLYPHS.values())
    mask = drawing.text_mask("1", 1)
    assert mask.shape == (7, 5) and mask[1:6, 1:4].astype(int).tolist() == [[0, 1, 0], [1, 1, 0], [0, 1, 0], [0, 1, 0], [1, 1, 1]]
    image = np.zeros((10, 10, 3), np.uint8)
    drawing.label(image, "AB", -3, 8, (9, 9, 9))  # partly outside
    drawing.box(image, -2, -2, 50, 50, (5, 5, 5))
    assert image.max() <= 9


def test_the_plan_of_a_level_is_drawn(spark, clip, tmp_path):
    rows = [(f, 1, 2, "car", float(f % 20), 10.0, float(f % 20) + 15, 30.0, float(f % 20) + 7, 30.0, f) for f in range(0, 30)]
    raw = spark.createDataFrame(rows, "frame long, track_id long, class_id int, class_name string, x1 double, y1 double, x2 double, y2 double, ground_x double, ground_y double, seq long")
    out = str(tmp_path / "a.y4m")
    video.write_video(video.draw_plan(evidence.annotation_plan(raw), clip, frames=30), out, 10.0)
    assert video.probe(out).frames == 30


def test_evidence_labels_stay_in_their_places(spark, clip, tmp_path):
    """Labels of crowded boxes: no drawn pixel lies outside a packed place or a box, and places do not overlap."""
    rows = [(f, k, 100 * f + k, 3 + 5 * k, 12 + 9 * (k % 3), 30 + 5 * k, 40, "#1 M", "red", []) for f in range(4) for k in range(1, 6)]
    labelled = spark.createDataFrame(rows, "frame long, place int, seq long, ox1 int, oy1 int, ox2 int, oy2 int, label string, dominant_color string, trail array<struct<trail_x:int,trail_y:int>>")
    plan = evidence.evidence_drawing(labelled, W, H)
    places = [tuple(r) for r in plan.filter("frame = 1 AND label IS NOT NULL").select("left", "top", "right", "bottom").collect()]
    assert 1 <= len(places) < 5 and plan.filter("frame = 1").count() == 5
    assert not any(a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1] for i, a in enumerate(places) for b in places[:i])
    out = str(tmp_path / "e.y4m")
    video.write_video(video.draw_plan(plan, clip, frames=4), out, 10.0)
    image = np.frombuffer(video.read_frames(spark, out, 1, 1).first().bgr, np.uint8).reshape(H, W, 3).astype(int)
    allowed = np.zeros((H, W), bool)
    for left, top, right, bottom in places:
        allowed[top:bottom, left:right] = True
        assert (image[top:bottom, left:right].sum(-1) < 60).any()  # a label's black ground
    for f, _, _, x1, y1, x2, y2, *_ in rows:
        if f == 1:
            allowed[y1:y2, x1:x2] = True
    allowed = allowed | np.roll(allowed, 1, 0) | np.roll(allowed, -1, 0)
    allowed = allowed | np.roll(allowed, 1, 1) | np.roll(allowed, -1, 1)  # colours are halved
    assert (np.abs(image - (31, 60, 90)).max(-1) <= 6)[~allowed].all()
