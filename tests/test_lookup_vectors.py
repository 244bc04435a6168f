"""Equal vectors of the answer cache are searched once, whatever the number of queries and entries that hold them."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import cache as K, similarity as S


def test_equal_vectors_meet_once(spark, monkeypatch):
    seen = []
    search = K.vector_topk
    monkeypatch.setattr(K, "vector_topk", lambda q, c, *a, **k: (seen.append((q.count(), c.count())), search(q, c, *a, **k))[1])
    base = np.random.default_rng(2).normal(size=(4, 6)).astype("float32")
    vectors = [[float(x) for x in v] for v in base]
    later = dt.datetime(2024, 3, 1)
    cache = spark.createDataFrame([(i, f"c{i}", vectors[i % 3], later) for i in range(5, 30)] + [(1, "x", None, later)],
                                  "id long, hash string, emb array<float>, expires_at timestamp")
    queries = spark.createDataFrame([(i, f"q{i // 2}", vectors[i // 2 % 4]) for i in range(40)] + [(99, "n", None)],
                                    "qid long, hash string, emb array<float>")
    found = {r["qid"]: (r["cache_id"], round(r["similarity"], 6)) for r in K.lookup_semantic(queries, cache, F.lit("2024-02-01").cast("timestamp"), -1.0).collect()}
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    scores = unit @ unit[:3].T
    first = {0: 6, 1: 7, 2: 5}  # smallest id of each vector
    assert found == {i: (first[int(scores[i // 2 % 4].argmax())], round(float(scores[i // 2 % 4].max()), 6)) for i in range(40)}
    assert seen == [(4, 4)] or seen == [(4, 3)]


def test_scores_kept_are_bounded():
    rng = np.random.default_rng(1)
    queries = rng.normal(size=(50, 8))
    top = S._TopK(np.arange(50), queries, 3, True, None, False, None)
    ids, rows = np.arange(5000), rng.normal(size=(5000, 8))
    top.add(ids, rows)
    assert top.pending <= 50 * 3 * 2  # every score of the first rows was kept before
    q, found, _ = top.compact()
    scores = queries @ rows.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    assert all(set(found[q == i]) == set(np.argsort(-scores[i])[:3]) for i in range(50))
