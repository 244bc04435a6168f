"""Embedding and splitting take Arrow batches as they are, not as pandas columns of whole texts."""

from pyspark.sql import functions as F

from quillspark.functions import hooks
from quillspark.operators import chunking as C

PANDAS_ITER = ", 204"  # Spark's number of the pandas iterator UDF


def test_no_pandas_columns(spark):
    texts = [None if i % 9 == 4 else "" if i % 9 == 5 else f"word{i} " * (i * 40 % 900) for i in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    embedded = hooks.embed(rows, "text", hooks.hashing_embedder(8), 8)
    assert PANDAS_ITER not in embedded._jdf.queryExecution().toString()
    got = {r["doc_id"]: r["emb"] for r in embedded.collect()}
    want = hooks.hashing_embedder(8)([t or "" for t in texts])
    assert all(max(abs(a - b) for a, b in zip(got[i], v)) < 1e-6 for i, v in enumerate(want)) and len(got) == len(texts)
    segs = rows.where("text IS NOT NULL").select("doc_id", F.lit(0).alias("seg_no"), F.lit(1).alias("page"), F.lit("").alias("header_path"), "text")
    parts = C.split_long(segs, 300, 0.1)
    assert PANDAS_ITER not in parts._jdf.queryExecution().toString()
    found = {}
    for r in sorted(parts.collect(), key=lambda r: (r["doc_id"], r["part_no"])):
        found.setdefault(r["doc_id"], []).append(r["text"])
    assert all(found[i] == C.split_text(t, 300, 0.1) for i, t in enumerate(texts) if t and len(t.split()) * 1.5 > 300)


def test_texts_reach_python_in_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    """The near-duplicate survey and the posting lists read long texts a few at a time; the user's own size holds."""
    from quillspark import session
    from quillspark.llm import jaccard_join

    texts = spark.range(0, 400, 1, 1).select(
        F.nullif("id", F.lit(-1)).alias("doc_id"), F.concat_ws(" ", F.col("id"), F.repeat(F.lit("word "), 20_000)).alias("text"))
    seen = []
    plain = jaccard_join.survey

    def sizes(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def watched(docs, n):
        seen.append(docs.select("doc_id", "text").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0])
        return plain(docs, n)

    monkeypatch.setattr(jaccard_join, "survey", watched)
    jaccard_join.similar_classes(texts)
    assert seen[0] < 2 * session.TEXT_BATCH_BYTES < 400 * 100_000
    assert spark.conf.get(session.ARROW_BYTES, None) is None
    spark.conf.set(session.ARROW_BYTES, "12345")
    try:
        with session.arrow_batches(spark):
            assert spark.conf.get(session.ARROW_BYTES) == "12345"
        assert spark.conf.get(session.ARROW_BYTES) == "12345"
    finally:
        spark.conf.unset(session.ARROW_BYTES)
