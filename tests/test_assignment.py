"""Assignment of a crowd: the same optimum as a dense method, in a time that a crowded frame allows."""

import time
import tracemalloc

import numpy as np
import pytest

from trackspark.operators import association


def dense(gain):
    """The most that pairs of a matrix can gain in all, by shortest augmenting paths over whole rows."""
    n, m = gain.shape
    cost = np.concatenate([-gain, np.zeros((n, n))], axis=1)
    m += n
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        best, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[at]:
            used[at] = True
            slack = np.append(np.inf, cost[row_of[at] - 1] - u[row_of[at]] - v[1:])
            less = ~used & (slack < best)
            best[less], way[less] = slack[less], at
            step = int(np.argmin(np.where(used, np.inf, best)))
            d = best[step]
            u[row_of[used]] += d
            v[used] -= d
            best[~used] -= d
            at = step
        while at:
            row_of[at], at = row_of[way[at]], way[at]
    return sum(max(0.0, gain[row_of[k] - 1, k - 1]) for k in range(1, gain.shape[1] + 1) if row_of[k])


@pytest.mark.parametrize("rounds", [0, 1, 50])
def test_assignment_is_optimal(monkeypatch, rounds):
    monkeypatch.setattr(association, "BID_ROUNDS", rounds, raising=False)
    r = np.random.default_rng(rounds)
    for k in range(60):
        n, m = r.integers(1, 25, 2)
        gain = np.where(r.random((n, m)) < 0.4, r.random((n, m)), 0.0)
        if k % 3 == 0:
            gain = np.ceil(gain * 4) / 4  # many ties
        i, j = np.nonzero(gain)
        got = association.assign(i, j, 1 - gain[i, j], 1.0)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        assert sum(gain[p] for p in got) == pytest.approx(dense(gain))


def test_a_crowd_is_assigned_in_time():
    r = np.random.default_rng(5)
    corner = r.uniform(0, 300, (2400, 2))
    boxes = np.concatenate([corner, corner + r.uniform(10, 60, (2400, 2))], axis=1)
    i, j, iou = association.overlaps(boxes[:1200], boxes[1200:])
    began = time.process_time()
    got = association.assign(i, j, 1 - iou, 0.95)
    assert len(got) > 1000 and time.process_time() - began < 3


def test_overlaps_hold_few_candidates():
    r = np.random.default_rng(8)
    corner = r.uniform(0, 10_000, (3000, 2))
    boxes = np.concatenate([corner, corner + r.uniform(5, 40, (3000, 2))], axis=1)
    boxes[0] = (0, 0, 10_000, 5)  # one wide box made candidates of all pairs
    tracemalloc.start()
    try:
        i, j, iou = association.overlaps(boxes, boxes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    own = iou[i == j]
    assert len(own) == 3000 and own == pytest.approx(np.ones(3000)) and peak < 100e6
