"""The weighted search in one scan gives what the joins of large query batches give."""

import random

import numpy as np

from quillspark.operators import retrieval as R


def test_scan_equals_joins(spark, monkeypatch):
    monkeypatch.setattr(R, "WEIGHTED_BLOCK", 7)
    rng, normal = random.Random(5), np.random.default_rng(5)
    words = ["quill", "spark", "paper", "ink", "letter", "margin", "line"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    vector = lambda: [float(x) for x in normal.normal(size=4)]
    chunks = spark.createDataFrame([(i, text(3 + i % 5), vector() if i % 9 else None, "public") for i in range(120)],
                                   "chunk_id long, content string, emb array<float>, access string").repartition(5)
    queries = spark.createDataFrame([(i, text(2), vector()) for i in range(9)] + [(50, "!", vector()), (51, "ink", [0.0] * 4)],
                                    "qid long, text string, emb array<float>")
    rows = [sorted((r["qid"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in R.hybrid_search_weighted(
        queries, chunks, match_threshold=0.3, limit=4, max_queries=n).collect()) for n in (1024, 2)]
    assert len(rows[0]) > 30 and rows[0] == rows[1]
