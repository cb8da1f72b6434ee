"""Rows that wait in a stream's state: in bounded parts, handed over whole and in order."""

import numpy as np
import pandas as pd

from trackspark.streaming.state import OrderedProcessor


class Store:
    """State of one key that notes how many rows it was ever given at once."""

    largest = 0

    def __init__(self):
        self.held = {}

    def note(self, value):
        rows = len(value[0]) // 20 if isinstance(value, tuple) and isinstance(value[0], bytes) else len(value) if isinstance(value, list) else 1
        Store.largest = max(Store.largest, rows)

    def updateValue(self, key, value):
        self.note(value)
        self.held[tuple(key)] = value

    def getValue(self, key):
        return self.held[tuple(key)]

    def containsKey(self, key):
        return tuple(key) in self.held

    def removeKey(self, key):
        del self.held[tuple(key)]

    def iterator(self):
        return iter(list(self.held.items()))

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[()]

    def put(self, value):
        self.updateValue((), value)

    update = put

    def clear(self):
        self.held = {}


class Handle:
    def getMapState(self, *_):
        return Store()

    getListState = getValueState = getMapState

    def registerTimer(self, _):
        pass


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


class Ordered(OrderedProcessor):
    ROW, BLOCK, HELD = "frame long, seq long", 4, 1000

    def take(self, key, rows):
        yield rows


def test_what_waits_is_held_in_parts():
    r = np.random.default_rng(2)
    rows = pd.DataFrame({"frame": r.integers(0, 40, 20_000), "seq": r.permutation(20_000)})
    Store.largest = 0
    held = Ordered(10.0)
    held.init(Handle())
    assert not list(held.handleInputRows(("a",), (rows[k : k + 500] for k in range(0, 20_000, 500)), Clock(0)))
    assert Store.largest <= 1000
    first = pd.concat(held.handleExpiredTimer(("a",), Clock(1000 + 2150), None))
    late = list(held.handleInputRows(("a",), iter([pd.DataFrame({"frame": [3, 30], "seq": [20_000, 20_001]})]), Clock(1000 + 2150)))
    end = pd.concat(held.handleInputRows(("a",), iter([pd.DataFrame({"frame": [1000], "seq": [None]})]), Clock(1000 + 2150)))
    assert not late and first["frame"].max() == 21 and end["frame"].min() == 22
    want = pd.concat([rows, pd.DataFrame({"frame": [30], "seq": [20_001]})]).sort_values(["frame", "seq"])
    got = pd.concat([first, end])
    assert got["frame"].tolist() == want["frame"].tolist() and got["seq"].tolist() == want["seq"].tolist()
    assert not held.blocks.held and not held.waiting.held
