"""The tracker against a plain program with eight-dimensional filters and tried-out assignments; the stream against the batch."""

import itertools
import os
import random
import time

import numpy as np
import pytest

from trackspark.operators import association
from trackspark.operators.association import Tracker, TrackerSettings
from trackspark.streaming import tracker as streamed


def plain_iou(a, b):
    wide, tall = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or tall <= 0:
        return 0.0
    return wide * tall / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - wide * tall)


def plain_assign(cost, limit):
    """Row by row, every free column or none; the choice that saves most."""
    states = {frozenset(): (0.0, [])}
    for i, line in enumerate(cost):
        new = {}
        for taken, (gain, pairs) in states.items():
            for j in (None, *(j for j, c in enumerate(line) if c < limit and j not in taken)):
                key = taken if j is None else taken | {j}
                value = (gain, pairs) if j is None else (gain + limit - line[j], [*pairs, (i, j)])
                if key not in new or value[0] > new[key][0] + 1e-12:
                    new[key] = value
        states = new
    return max(states.values(), key=lambda v: v[0])[1]


class PlainTracker:
    """One track at a time, with matrices."""

    F = np.eye(8) + np.eye(8, k=4)
    H = np.eye(4, 8)

    def __init__(self, s):
        self.s, self.tracks, self.step, self.given = s, [], 0, 0

    def noise(self, t, a, b):
        w, h = t["x"][2], t["x"][3]
        return np.diag([(a * v / 20) ** 2 for v in (w, h, w, h)] + [(b * v / 160) ** 2 for v in (w, h, w, h)])

    def box(self, t):
        x, y, w, h = t["x"][:4]
        return (x - w / 2, y - h / 2, x + w / 2, y + h / 2)

    def next_frame(self, boxes, scores):
        s, ids = self.s, [0] * len(boxes)
        self.step += 1
        for t in self.tracks:
            if t["state"] != "tracked":
                t["x"][6:] = 0
            q = self.noise(t, 1, 1)
            t["x"], t["P"] = self.F @ t["x"], self.F @ t["P"] @ self.F.T + q

        def match(tracks, chosen, limit, fused):
            cost = [[1 - plain_iou(self.box(t), boxes[j]) * (scores[j] if fused else 1) for j in chosen] for t in tracks]
            cost = [[c if plain_iou(self.box(t), boxes[j]) > 0 else 9 for c, j in zip(line, chosen)] for line, t in zip(cost, tracks)]
            pairs = plain_assign(cost, limit)
            for a, b in pairs:
                t, j = tracks[a], chosen[b]
                x1, y1, x2, y2 = boxes[j]
                r = self.noise(t, 1, 1)[:4, :4]
                k = t["P"] @ self.H.T @ np.linalg.inv(self.H @ t["P"] @ self.H.T + r)
                t["x"] = t["x"] + k @ (np.array([(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1]) - self.H @ t["x"])
                t["P"] = (np.eye(8) - k @ self.H) @ t["P"]
                t["state"], t["last"], ids[j] = "tracked", self.step, t["id"]
            return [t for a, t in enumerate(tracks) if a not in {p[0] for p in pairs}], [j for b, j in enumerate(chosen) if b not in {p[1] for p in pairs}]

        strong = [j for j, v in enumerate(scores) if v >= s.track_high_thresh]
        weak = [j for j, v in enumerate(scores) if s.track_low_thresh < v < s.track_high_thresh]
        fresh, live = [t for t in self.tracks if t["state"] == "fresh"], {id(t) for t in self.tracks if t["state"] == "tracked"}
        left, strong = match([t for t in self.tracks if t["state"] != "fresh"], strong, s.match_thresh, s.fuse_score)
        left, _ = match([t for t in left if id(t) in live], weak, 0.5, False)
        for t in left:
            t["state"] = "lost"
        gone, strong = match(fresh, strong, 0.7, s.fuse_score)
        born = []
        for j in strong:
            if scores[j] >= s.new_track_thresh:
                self.given += 1
                x1, y1, x2, y2 = boxes[j]
                t = {"id": self.given, "state": "tracked" if self.step == 1 else "fresh", "first": self.step, "last": self.step, "x": np.array([(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1, 0, 0, 0, 0], float)}
                t["P"] = self.noise(t, 2, 10)
                ids[j] = t["id"] if self.step == 1 else 0
                born.append(t)
        out = {id(t) for t in gone} | {id(t) for t in self.tracks if t["state"] == "lost" and self.step - t["last"] > s.track_buffer}
        for a in [t for t in self.tracks if t["state"] == "tracked"]:
            for b in [t for t in self.tracks if t["state"] == "lost"]:
                if 1 - plain_iou(self.box(a), self.box(b)) < 0.15:
                    out.add(id(b) if a["last"] - a["first"] > b["last"] - b["first"] else id(a))
        self.tracks = [t for t in self.tracks if id(t) not in out] + born
        return ids


def scene(seed, frames=60, objects=4):
    """Boxes that drift, cross, fade, vanish for a while and come back, and false ones."""
    r = random.Random(seed)
    movers = [[r.uniform(0, 200), r.uniform(0, 100), r.uniform(-6, 6), r.uniform(-3, 3), r.uniform(15, 40), r.uniform(10, 30)] for _ in range(objects)]
    for f in range(frames):
        rows = []
        for m in movers:
            m[0], m[1] = m[0] + m[2] + r.gauss(0, 1), m[1] + m[3] + r.gauss(0, 1)
            if r.random() < 0.85:
                rows.append((m[0], m[1], m[0] + m[4] * r.uniform(0.9, 1.1), m[1] + m[5] * r.uniform(0.9, 1.1), r.uniform(0.03, 1)))
        if r.random() < 0.2:
            x, y = r.uniform(0, 300), r.uniform(0, 150)
            rows.append((x, y, x + 20, y + 20, r.uniform(0, 1)))
        yield f, rows


@pytest.mark.parametrize("seed", range(12))
def test_tracker_equals_a_plain_program(seed):
    s = TrackerSettings(track_buffer=5 if seed % 2 else 60, fuse_score=seed % 3 > 0, match_thresh=0.8 if seed % 4 else 0.95)
    quick, plain = Tracker(s), PlainTracker(s)
    seen = set()
    for _, rows in scene(seed):
        boxes, scores = np.array([b[:4] for b in rows]).reshape(-1, 4), np.array([b[4] for b in rows])
        got = quick.next_frame(boxes, scores).tolist()
        assert got == plain.next_frame([b[:4] for b in rows], [b[4] for b in rows])
        seen |= set(got)
    assert len(seen) > 3
    assert sorted(quick.heads[:, 0].tolist()) == sorted(t["id"] for t in plain.tracks)


def test_optimal_assignment_equals_all_ways():
    r = random.Random(1)
    for _ in range(150):
        n, m = r.randint(1, 4), r.randint(1, 4)
        cost = np.array([[r.random() if r.random() < 0.7 else 1.0 for _ in range(m)] for _ in range(n)])
        i, j = np.nonzero(cost < 1)
        got = association.assign(i, j, cost[i, j], 0.8)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        assert sum(0.8 - cost[p] for p in got) == pytest.approx(sum(0.8 - cost[p] for p in plain_assign(cost.tolist(), 0.8)))


def test_overlaps_of_a_crowd():
    r = np.random.default_rng(4)
    corner = r.uniform(0, 300, (80, 2))
    boxes = np.concatenate([corner, corner + r.uniform(1, 40, (80, 2))], axis=1)
    i, j, iou = association.overlaps(boxes[:30], boxes)
    want = {(a, b): plain_iou(boxes[a], boxes[b]) for a in range(30) for b in range(80)}
    assert {(a, b): v for a, b, v in zip(i.tolist(), j.tolist(), iou)} == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_suppression_equals_a_plain_program():
    r = np.random.default_rng(6)
    for n in (0, 1, 7, 60, 300):
        corner = r.integers(0, 60, (n, 2)).astype(float)
        boxes = np.concatenate([corner, corner + r.integers(0, 30, (n, 2))], axis=1)
        if n > 7:
            boxes[5] = np.nan
        want = []
        for k, b in enumerate(boxes):
            want.append(not any(w and plain_iou(boxes[i], b) > 0.3 for i, w in enumerate(want)))
        for block in (4, 512):
            assert association.unsuppressed(boxes, 0.3, block).tolist() == want


def test_a_crowded_frame_is_swept():
    r = np.random.default_rng(7)
    corner = r.uniform(0, 20_000, (100_000, 2))
    boxes = np.concatenate([corner, corner + r.uniform(5, 40, (100_000, 2))], axis=1)
    began = time.process_time()
    kept = association.unsuppressed(boxes, 0.5)
    assert 50_000 < kept.sum() < 100_000 and time.process_time() - began < 120


def test_settings_are_read_by_their_names():
    got = TrackerSettings.of({"other": "left out", "track_high_thresh": 0.3, "track_buffer": 7, "fuse_score": False})
    assert (got.track_high_thresh, got.track_buffer, got.fuse_score, got.match_thresh) == (0.3, 7, False, 0.8)
    for bad in ({"track_low_thresh": 0.5}, {"track_buffer": -1}, {"match_thresh": 0.0}, {"new_track_thresh": 2.0}):
        with pytest.raises(ValueError):
            TrackerSettings.of(bad)


SCHEMA = "clip string, seq long, frame long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def detections(clips=3, frames=50):
    out = []
    for c in range(clips):
        for f, rows in scene(100 + c, frames):
            out += [(f"clip{c}", len(out) + k, f, 2, "car", b[4], *b[:4]) for k, b in enumerate(rows)]
    return out


def plain_ids(rows, settings):
    trackers, out = {}, {}
    for (clip, _), group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[2], r[1])), key=lambda r: (r[0], r[2])):
        frame = list(group)
        ids = trackers.setdefault(clip, PlainTracker(settings)).next_frame([r[6:] for r in frame], [r[5] for r in frame])
        out |= {r[1]: i or None for r, i in zip(frame, ids)}
    return out


def test_batch_of_clips(spark):
    rows = detections()
    frame = spark.createDataFrame(rows + [(None, 9999, 1, 2, "car", 0.9, 0.0, 0.0, 5.0, 5.0), ("clip0", 9998, 3, 2, "car", None, 1.0, 1.0, 9.0, 9.0), ("clip1", 9997, 3, 2, "car", 0.9, None, 1.0, 9.0, 9.0)], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames go on across batches
    try:
        got = {r["seq"]: r["track_id"] for r in association.track_boxes(frame.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_ids(rows, TrackerSettings()) | {9999: None, 9998: None, 9997: None}
    assert association.track_boxes(frame.limit(0)).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = detections(2, 40)
        random.Random(3).shuffle(rows)
        rows.sort(key=lambda r: r[2] // 5)  # out of order within half a second

        def run(part):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            out = streamed.track_stream(source, 10.0)
            query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()

        end = [(f"clip{c}", None, 1000, None, None, None, None, None, None, None) for c in range(2)]
        third = len(rows) // 3
        for part in (rows[:third], rows[third : 2 * third], rows[2 * third :], end):
            run(part)
        run([("clip0", 7777, 2, 2, "car", 0.9, 0.0, 0.0, 9.0, 9.0)])  # far too late
        got = {r["seq"]: r["track_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert got.pop(7777, None) is None
        assert got == plain_ids(rows, TrackerSettings())
        assert os.path.isdir(f"{tmp_path}/state")
    finally:
        spark.conf.unset(name)
