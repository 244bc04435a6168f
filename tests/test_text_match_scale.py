"""Text match reads the texts once and finds what brute force finds."""

import math
import random

from pyspark.sql import functions as F

from quillspark.operators import retrieval as R


def test_texts_are_counted_once(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    texts = [[rng.choice(words[:1 + rng.randrange(12)]) for _ in range(rng.randrange(0, 30))] for _ in range(120)]
    asked = [rng.sample(words, rng.randrange(1, 7)) for _ in range(60)] + [["w0", "absent"], []]
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text
    chunks = (spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "chunk_id long, content string").repartition(4)
              .withColumn("content", seen.asNondeterministic()("content")))
    queries = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(asked)], "qid long, text string")
    got = {(r["qid"], r["chunk_id"]): r["text_score"] for r in R.text_match(queries, R.term_counts(chunks, queries)).collect()}
    assert reads.value == len(texts)
    want = {}
    for q, terms in enumerate(asked):
        for c, text in enumerate(texts):
            if terms and set(terms) <= set(text):
                s = sum(math.log1p(text.count(w)) for w in terms) / (1 + math.log(len(text)))
                want[q, c] = s / (1 + s)
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert any(len(asked[q]) > 3 for q, _ in want) and any(len(asked[q]) == 1 for q, _ in want)


def test_pairs_are_neither_exchanged_nor_written(spark, monkeypatch):
    """Copies of a text and of a query, null ids, and blocks smaller than the data."""
    for name, size in (("TEXT_BLOCK", 40), ("QUERY_BLOCK", 7), ("PAIR_BLOCK", 11), ("RESULT_ROWS", 5)):
        monkeypatch.setattr(R, name, size)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(15)]
    texts = [(i, " ".join(rng.choice(words[:1 + rng.randrange(15)]) for _ in range(rng.randrange(0, 25)))) for i in range(90)]
    texts += texts[:20] + [(None, "w0"), (None, "w0 w1")]
    asked = [(i % 50, " ".join(rng.sample(words, rng.randrange(1, 6)))) for i in range(70)] + [(None, "w0 w1"), (3, None), (4, " "), (5, "w1 absent")]
    queries = spark.createDataFrame(asked, "qid long, text string")
    found = R.text_match(queries, R.term_counts(spark.createDataFrame(texts, "chunk_id long, content string"), queries))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for q, asks in asked:
        terms = set((asks or "").split())
        for c, text in texts:
            if terms and terms <= set(text.split()) and (c is not None or len(terms) == 1):
                s = sum(math.log1p(text.split().count(w)) for w in terms) / (1 + math.log(len(text.split())))
                want.append((q, c, round(s / (1 + s), 9)))
    got = [(r["qid"], r["chunk_id"], round(r["text_score"], 9)) for r in found.collect()]
    assert len(want) > 500 and sorted(map(repr, got)) == sorted(map(repr, want))
