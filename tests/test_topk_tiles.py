"""The running top k partitions only the first tile of a batch; single precision decides nothing."""

import numpy as np
import pytest

from quillspark.operators import similarity as S


@pytest.mark.parametrize("k, floor, strict, slack", [(7, None, False, None), (3, 0.2, True, None), (None, 0.3, False, None), (5, None, False, 0.05)])
def test_equals_brute_force(monkeypatch, k, floor, strict, slack):
    monkeypatch.setattr(S, "_SCORES_AT_ONCE", 5_000)
    monkeypatch.setattr(S, "_QUERY_TILE", 50)
    rng, sorted_scores = np.random.default_rng(2), []
    partition = np.partition

    def counted(scores, *args, **kwargs):
        sorted_scores.append(scores.size)
        return partition(scores, *args, **kwargs)
    monkeypatch.setattr(np, "partition", counted)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 1000)] + rng.normal(size=(1000, 8)) / 3
    x[500:540], x[540:560] = x[:40], x[0] + 1e-8 * rng.normal(size=(20, 8))  # equal and nearly equal vectors
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids, names = np.arange(1000), np.r_[np.arange(120), np.arange(10)]  # ids of queries come twice
    top = S._TopK(names, x[names], k, True, floor, strict, slack)
    for at in range(0, 1000, 400):
        top.add(ids[at:at + 400], x[at:at + 400])
    q, c, scores = top.compact()
    want = x[names] @ x.T
    want[names[:, None] == ids[None, :]] = -np.inf
    for row in range(len(names)):
        mine = dict(zip(c[q == row].tolist(), scores[q == row].tolist()))
        least = -np.inf if floor is None else floor
        least = max(least, (np.sort(want[row])[-k] if k else -np.inf) - (slack or 0))
        assert all(abs(s - want[row, i]) < 1e-12 and s >= least - 1e-12 for i, s in mine.items())
        assert set(np.flatnonzero(want[row] > least + 1e-12)) <= set(mine) and (k is None or slack or len(mine) <= k)
    assert sum(sorted_scores) <= (9 * 5_000 if k and slack is None else 0)
