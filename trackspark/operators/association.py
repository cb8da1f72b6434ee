"""Boxes to tracks: constant-velocity filters and two rounds of overlap assignment, a clip's frames in order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns

FRESH, TRACKED, LOST = 0, 1, 2
#: Fixed values of the association: spreads of a box's place and speed as parts of its size, limits of the
#: second round and of fresh tracks, and the overlap distance below which a lost and a live track are one.
PLACE_SPREAD, SPEED_SPREAD = 1 / 20, 1 / 160
SECOND_LIMIT, FRESH_LIMIT, SAME = 0.5, 0.7, 0.15
#: Rounds of bids before the rows that are left are placed one at a time; any number gives an optimum.
BID_ROUNDS = 400
#: Candidate pairs of boxes that are looked at together.
PAIRS = 1 << 18


@dataclass(frozen=True)
class TrackerSettings:
    """Thresholds by the names of tracker files (fixed values); ``of`` takes such a file's values and leaves others out."""

    track_high_thresh: float = 0.2
    track_low_thresh: float = 0.05
    new_track_thresh: float = 0.2
    track_buffer: int = 60
    match_thresh: float = 0.8
    fuse_score: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.track_low_thresh <= self.track_high_thresh <= 1 or not 0 <= self.new_track_thresh <= 1:
            raise ValueError("thresholds must be from 0 to 1, the low one at most the high one")
        if not 0 < self.match_thresh <= 1 or self.track_buffer < 0:
            raise ValueError("match_thresh must be above 0 and up to 1, track_buffer not negative")

    @classmethod
    def of(cls, values: dict[str, object]) -> TrackerSettings:
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})  # type: ignore[arg-type]


def common_areas(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, common area and area of the union of all pairs of boxes (x1, y1, x2, y2) that overlap, by a sweep along x.

    Boxes are swept by classes of width, each at most twice as wide as its narrowest, and
    PAIRS candidates at a time: one wide box adds no candidates to the others, and memory
    is that of the pairs that overlap.
    """
    wide = b[:, 2] - b[:, 0]
    kind = np.frexp(np.where(wide > 0, wide, 0.0))[1]  # boxes without a width overlap nothing
    found = []
    for k in np.unique(kind[wide > 0]):
        members = np.flatnonzero((kind == k) & (wide > 0))
        members = members[np.argsort(b[members, 0], kind="stable")]
        left = b[members, 0]
        low, high = np.searchsorted(left, a[:, 0] - wide[members].max(), "left"), np.searchsorted(left, a[:, 2], "left")
        n = np.maximum(0, high - low)
        ends = np.cumsum(n)
        start = 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            m = n[start:stop]
            i = np.repeat(np.arange(start, stop), m)
            j = members[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - low[start:stop], m)]
            tall = np.minimum(a[i, 3], b[j, 3]) - np.maximum(a[i, 1], b[j, 1])
            i, j, tall = i[tall > 0], j[tall > 0], tall[tall > 0]
            across = np.minimum(a[i, 2], b[j, 2]) - np.maximum(a[i, 0], b[j, 0])
            good = across > 0
            found.append((i[good], j[good], (across * tall)[good]))
            start = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    i, j, common = (np.concatenate(c) for c in zip(*found))
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return i, j, common, size(a)[i] + size(b)[j] - common


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and intersection over union of all pairs of boxes that overlap."""
    i, j, common, union = common_areas(a, b)
    return i, j, common / union


def unsuppressed(boxes: np.ndarray, least_iou: float, block: int = 512) -> np.ndarray:
    """Which of boxes, best first, no better one that is kept overlaps by more than least_iou; pairs are found a block of boxes at a time."""
    kept = np.ones(len(boxes), bool)
    for start in range(0, len(boxes), block):
        rows = start + np.flatnonzero(kept[start : start + block])  # what is gone by now suppresses none
        i, j, common, union = common_areas(boxes[rows], boxes)
        i = rows[i]
        good = (j > i) & (common > least_iou * union)
        i, j = i[good], j[good]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        begin = np.searchsorted(i, rows)
        for row, low, high in zip(rows.tolist(), begin.tolist(), [*begin[1:].tolist(), len(i)]):
            if kept[row]:
                kept[j[low:high]] = False
    return kept


def _bid(start: np.ndarray, c: np.ndarray, gain: np.ndarray, price: np.ndarray, owner: np.ndarray, rounds: int) -> None:
    """Rows without a column bid for their best one what it is worth more than their second best, or than none; the highest bid has it.

    A price rises only with a bid, so a column without an owner costs nothing, and no
    owner would rather have another column; _augment places the rows that are left.
    """
    free = np.arange(len(start) - 1)
    for _ in range(rounds):
        n = start[free + 1] - start[free]
        at = np.cumsum(n) - n
        e = np.arange(n.sum()) - np.repeat(at - start[free], n)
        net = gain[e] - price[c[e]]
        best = np.maximum.reduceat(net, at)
        tops = np.flatnonzero(net == np.repeat(best, n))
        first = tops[np.searchsorted(tops, at)]
        net[first] = 0
        more = best - np.maximum(0, np.maximum.reduceat(net, at))
        want = c[e[first]]
        bids = np.flatnonzero((best > 0) & ((more > 0) | (owner[want] < 0)))
        if not len(bids):
            return
        bids = bids[np.lexsort((more[bids], want[bids]))]
        won = bids[np.append(want[bids][1:] != want[bids][:-1], True)]
        before = owner[want[won]]
        owner[want[won]] = free[won]
        price[want[won]] += more[won]
        stay = best > 0
        stay[won] = False
        free = np.concatenate([free[stay], before[before >= 0]])
        if not len(free):
            return


def _augment(start: np.ndarray, c: np.ndarray, gain: np.ndarray, price: np.ndarray, owner: np.ndarray) -> None:
    """Rows without a column get one, or none, by cheapest alternating paths (Dijkstra); a path ends at a column without an owner or at a row that gives up its own."""
    column = np.full(len(start) - 1, -1)
    column[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    worth = np.maximum(0, np.maximum.reduceat(gain - price[c], start[:-1]))  # of each row, at these prices
    for source in np.flatnonzero((column < 0) & (worth > 0)).tolist():
        far, way, passed = np.full(len(price), np.inf), np.full(len(price), -1), np.zeros(len(price), bool)
        row, here, rows, columns, last, least = source, 0.0, [], [], source, np.inf
        while True:
            rows.append((row, here))
            if here + worth[row] < least:
                last, least = row, here + worth[row]
            edges = slice(start[row], start[row + 1])
            to = c[edges]
            cost = here + np.maximum(0, worth[row] - gain[edges] + price[to])
            near = (cost < far[to]) & (cost < least) & ~passed[to]
            far[to[near]], way[to[near]] = cost[near], row
            at = int(np.argmin(far))
            if far[at] >= least:  # the cheapest end is a row without a column
                at, here = int(column[last]), least
                break
            here = float(far[at])
            if owner[at] < 0:
                break
            columns.append((at, here))
            far[at], passed[at] = np.inf, True
            row = int(owner[at])
        for k, d in rows:
            worth[k] = max(0.0, worth[k] - (here - d))
        for k, d in columns:
            price[k] += here - d
        if here == least and at == column[last]:
            column[last] = -1
        while at >= 0:
            row = int(way[at])
            owner[at] = row
            at, column[row] = int(column[row]), at


def _optimal(r: np.ndarray, c: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs (r, c), each number once, whose gains are most in all; all gains are above 0, every row and column from 0 has a pair."""
    if len(r) == 1:
        return r, c
    order = np.lexsort((c, r))
    r, c, gain = r[order], c[order], gain[order]
    start = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r))
    columns = int(c.max()) + 1
    price, owner = np.zeros(columns), np.full(columns, -1)
    _bid(start, c, gain, price, owner, BID_ROUNDS)
    _augment(start, c, gain, price, owner)
    taken = np.flatnonzero(owner >= 0)
    return owner[taken], taken


def _groups(i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the pairs of each connected part."""
    of_i, of_j = i.copy(), np.full(int(j.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    label = np.arange(int(i.max(initial=-1)) + 1)
    while True:
        of_j[:] = np.iinfo(np.int64).max
        np.minimum.at(of_j, j, label[i])
        new = label.copy()
        np.minimum.at(new, i, of_j[j])
        if (new == label).all():
            break
        label = new
    of_i = label[i]
    order = np.argsort(of_i, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(of_i[order])) + 1) if len(i) else ()


def assign(i: np.ndarray, j: np.ndarray, cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The pairs, each number once, whose costs below limit save most in all; each connected part is solved by itself."""
    good = cost < limit
    i, j, gain = i[good], j[good], limit - cost[good]
    out: list[tuple[int, int]] = []
    for part in _groups(i, j):
        rows, r = np.unique(i[part], return_inverse=True)
        columns, c = np.unique(j[part], return_inverse=True)
        a, b = _optimal(r, c, gain[part])
        out += zip(rows[a].tolist(), columns[b].tolist())
    return out


class Tracker:
    """The tracks of one clip: number, state, first and last step, and filters of centre and size [track, 4, (value, speed, three covariances)].

    The noises of x, y, width and height do not depend on each other, so the usual
    eight-dimensional filter is four of two dimensions.  Frames without boxes are no steps.
    """

    def __init__(self, settings: TrackerSettings, step: int = 0, given: int = 0, heads: np.ndarray | None = None, filters: np.ndarray | None = None):
        self.settings, self.step, self.given = settings, step, given
        self.heads = np.zeros((0, 4), np.int64) if heads is None else heads  # number, state, first and last step
        self.filters = np.zeros((0, 4, 5)) if filters is None else filters

    def _spread(self, rows: np.ndarray | slice) -> np.ndarray:
        return self.filters[rows][:, [2, 3, 2, 3], 0]

    def _predict(self) -> None:
        f, size = self.filters, self._spread(slice(None))
        f[self.heads[:, 1] != TRACKED, 2:, 1] = 0  # what is not seen keeps its size
        f[..., 0] += f[..., 1]
        f[..., 2] += 2 * f[..., 3] + f[..., 4] + (PLACE_SPREAD * size) ** 2
        f[..., 3] += f[..., 4]
        f[..., 4] += (SPEED_SPREAD * size) ** 2

    def _update(self, rows: np.ndarray, boxes: np.ndarray) -> None:
        f = self.filters[rows]
        all_ = f[..., 2] + (PLACE_SPREAD * self._spread(rows)) ** 2
        k0, k1 = f[..., 2] / all_, f[..., 3] / all_
        off = _centred(boxes) - f[..., 0]
        out = np.stack([f[..., 0] + k0 * off, f[..., 1] + k1 * off, f[..., 2] * (1 - k0), f[..., 3] * (1 - k0), f[..., 4] - k1 * f[..., 3]], axis=-1)
        self.filters[rows] = out
        self.heads[rows, 1], self.heads[rows, 3] = TRACKED, self.step

    def _boxes(self, rows: np.ndarray) -> np.ndarray:
        c = self.filters[rows][..., 0]
        return np.concatenate([c[:, :2] - c[:, 2:] / 2, c[:, :2] + c[:, 2:] / 2], axis=1)

    def _round(self, rows: np.ndarray, chosen: np.ndarray, boxes: np.ndarray, scores: np.ndarray, limit: float, fused: bool, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Match tracks with boxes, and give what is left of both."""
        i, j, iou = overlaps(self._boxes(rows), boxes[chosen])
        pairs = assign(i, j, 1 - iou * scores[chosen][j] if fused else 1 - iou, limit)
        a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        self._update(rows[a], boxes[chosen[b]])
        ids[chosen[b]] = self.heads[rows[a], 0]
        return np.delete(rows, a), np.delete(chosen, b)

    def next_frame(self, boxes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Track numbers, from 1, of a frame's boxes; 0 where a box has none (yet)."""
        s, ids = self.settings, np.zeros(len(boxes), np.int64)
        self.step += 1
        sound = (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])
        strong = np.flatnonzero(sound & (scores >= s.track_high_thresh))
        weak = np.flatnonzero(sound & (scores > s.track_low_thresh) & (scores < s.track_high_thresh))
        self._predict()
        state = self.heads[:, 1].copy()
        left, strong = self._round(np.flatnonzero(state != FRESH), strong, boxes, scores, s.match_thresh, s.fuse_score, ids)
        left, _ = self._round(left[state[left] == TRACKED], weak, boxes, scores, SECOND_LIMIT, False, ids)
        self.heads[left, 1] = LOST
        gone, strong = self._round(np.flatnonzero(state == FRESH), strong, boxes, scores, FRESH_LIMIT, s.fuse_score, ids)
        born = strong[scores[strong] >= s.new_track_thresh]
        numbers = self.given + 1 + np.arange(len(born))
        self.given += len(born)
        first = self.step == 1
        ids[born] = numbers if first else 0
        late = np.flatnonzero((self.heads[:, 1] == LOST) & (self.step - self.heads[:, 3] > s.track_buffer))
        keep = np.setdiff1d(np.arange(len(self.heads)), np.concatenate([gone, late, self._twins()]))
        place = _centred(boxes[born])
        size = place[:, [2, 3, 2, 3]]
        filters = np.stack([place, np.zeros_like(place), (2 * PLACE_SPREAD * size) ** 2, np.zeros_like(place), (10 * SPEED_SPREAD * size) ** 2], axis=-1)
        heads = np.stack([numbers, np.full(len(born), TRACKED if first else FRESH), *[np.full(len(born), self.step)] * 2], axis=1).astype(np.int64)
        self.heads, self.filters = np.concatenate([self.heads[keep], heads]), np.concatenate([self.filters[keep], filters])
        return ids

    def _twins(self) -> np.ndarray:
        """The shorter-lived ones of live and lost tracks that all but coincide."""
        live, lost = np.flatnonzero(self.heads[:, 1] == TRACKED), np.flatnonzero(self.heads[:, 1] == LOST)
        i, j, iou = overlaps(self._boxes(live), self._boxes(lost))
        same = 1 - iou < SAME
        i, j = live[i[same]], lost[j[same]]
        age = self.heads[:, 3] - self.heads[:, 2]
        return np.where(age[i] > age[j], j, i)


def _centred(boxes: np.ndarray) -> np.ndarray:
    return np.concatenate([(boxes[:, :2] + boxes[:, 2:]) / 2, boxes[:, 2:] - boxes[:, :2]], axis=1)


BOXES = ("x1", "y1", "x2", "y2")
NEEDS = ("clip", "frame", "seq", "confidence", *BOXES)


def numbered(tracker: Tracker, rows: pd.DataFrame) -> pd.DataFrame:
    """One frame's rows with track_id, null where a box has no track."""
    ids = tracker.next_frame(rows[list(BOXES)].to_numpy(float), rows["confidence"].to_numpy(float))
    return rows.assign(track_id=pd.arrays.IntegerArray(ids, ids == 0))


def track_boxes(detections: DataFrame, settings: TrackerSettings = TrackerSettings()) -> DataFrame:
    """Detections (clip, frame, seq, confidence, box; other columns pass through) with a track_id, numbered from 1 in each clip.

    Strong boxes go to predicted live and lost tracks, weak ones to the live tracks
    that are left (Zhang et al. 2022, Aharon et al. 2022), by the best assignment of
    intersection over union.  A clip's first boxes are tracks at once; later ones have
    an id from their second match on, before that it is null.  A clip is a sequence:
    clips are dealt to tasks and streamed in order, no clip is held; boxes without an
    area, a null confidence or null corners never have a track.
    """
    require_columns(detections, set(NEEDS), "detections")
    plain = detections.drop("track_id")
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in plain.dtypes), "track_id long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, tracker, held = None, None, None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows.iloc[-1]
            ends = (rows["clip"] == last["clip"]) & (rows["frame"] == last["frame"])  # the last frame may go on in the next batch
            held, done = rows[ends], rows[~ends]
            for (name, _), frame in done.groupby(["clip", "frame"], sort=False):
                if tracker is None or name != clip:
                    clip, tracker = name, Tracker(settings)
                yield numbered(tracker, frame)
        if held is not None and len(held):
            yield numbered(tracker if tracker is not None and held.iloc[0]["clip"] == clip else Tracker(settings), held)

    known = F.col("clip").isNotNull() & F.col("frame").isNotNull()
    return plain.filter(known).repartition("clip").sortWithinPartitions("clip", "frame", "seq").mapInPandas(run, schema).unionByName(plain.filter(~known).withColumn("track_id", F.lit(None).cast("long")))
