"""The trained index with more queries than are broadcast."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import similarity as S, vector_index as VI


def test_blocks_count_and_prune(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 16))[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) / 4)]
    vectors = spark.createDataFrame(rows, "chunk_id long, emb array<float>").cache()
    book = VI.fit(vectors, 16)
    VI.write_index(vectors, book, str(tmp_path / "index"))
    queries = vectors.select(F.col("chunk_id").alias("qid"), "emb")
    scores = VI.index_scores(queries, VI.cells(spark, str(tmp_path / "index")), book, 10, True, max_queries=400).collect()
    scored = sum(r["vector_score"] for r in scores if r["qid"] is None)
    assert 10 * 1500 <= scored < 0.5 * 1500 ** 2
    found = {(r["qid"], r["chunk_id"]) for r in scores if r["qid"] is not None}
    exact = {(r["qid"], r["chunk_id"]) for r in S.vector_topk(queries, vectors, 10, True).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
