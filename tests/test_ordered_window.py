"""Rows of a key that wait for the watermark: state is touched a few times a batch, and both ways of waiting agree."""

import random
from types import SimpleNamespace

import pandas as pd

from quillspark.streaming import jobs as J


class Store(dict):
    """A value state or a map state that counts its calls."""

    calls = 0

    def __getattribute__(self, name):
        if not name.startswith("_") and name not in ("calls", "values"):
            Store.calls += 1
        return super().__getattribute__(name)

    exists = lambda self: None in self.keys()
    get = lambda self: self[None]
    update = lambda self, v: self.__setitem__(None, v)
    clear = lambda self: self.__delitem__(None) if None in self.keys() else None
    getValue = lambda self, k: self[k] if k in list(self) else None
    updateValue = lambda self, k, v: self.__setitem__(k, v)
    removeKey = lambda self, k: self.__delitem__(k)


def run(rows, watermarks):
    timers = []
    handle = SimpleNamespace(getValueState=lambda *a: Store(), getMapState=lambda *a: Store(), registerTimer=timers.append)
    window = J._OrderedWindow(50, True, 10_000, "bigint")
    window.init(handle)
    Store.calls, out = 0, []
    for i in range(0, len(rows), 30):
        list(window.handleInputRows(("k",), iter([pd.DataFrame(rows[i:i + 30], columns=["t", "id"])]), None))
    calls = Store.calls
    for w in watermarks:
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: w)
        for at in sorted(x for x in timers if x <= w):
            timers.remove(at)
            info = SimpleNamespace(getExpiryTimeInMs=lambda: at)
            out += [r for df in window.handleExpiredTimer(("k",), values, info) for r in df[["t", "id", "start", "n"]].itertuples(index=False)]
    return [tuple(r) for r in out], calls


def test_few_and_many_rows_agree(monkeypatch):
    rng = random.Random(1)
    rows = [(rng.randrange(300_000), i) for i in range(90)]
    marks = [100, 101, 250, 1000]
    few, calls = run(rows, marks)
    assert calls <= 12  # 30 buckets, so over 100 before
    monkeypatch.setattr(J, "PIECE", 7)
    many, _ = run(rows, marks)
    assert few == many and [r[:2] for r in few] == sorted(rows)
