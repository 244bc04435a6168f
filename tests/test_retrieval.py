"""Vector search, text match, rerank, cache: edge inputs, hot buckets, brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.hooks import embed, lexical_scorer
from quillspark.operators import cache as K, fuzzy, retrieval as R, similarity as S, vector_index as VI

VECTORS = "chunk_id long, emb array<float>"


def random_vectors(n, dim=16, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype("float32")


def frames(spark, matrix, n_queries):
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], VECTORS)
    queries = chunks.where(F.col("chunk_id") < n_queries).select(F.col("chunk_id").alias("qid"), "emb")
    return queries, chunks


def brute(matrix, n_queries, k):
    unit = matrix.astype("float64") / np.linalg.norm(matrix.astype("float64"), axis=1, keepdims=True)
    scores = unit[:n_queries] @ unit.T
    np.fill_diagonal(scores[:, :n_queries], -np.inf)
    return {q: sorted(range(len(matrix)), key=lambda c: (-scores[q, c], c))[:k] for q in range(n_queries)}


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qid"], []).append((r["rank"], r["chunk_id"]))
    return {q: [c for _, c in sorted(rows)] for q, rows in out.items()}


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_topk_is_exact(spark, strategy, monkeypatch):
    monkeypatch.setattr(S, "QUERY_CELL", 7)
    monkeypatch.setattr(S, "CHUNK_CELL", 40)
    matrix = random_vectors(200)
    queries, chunks = frames(spark, matrix, 20)
    assert ranked(S.vector_topk(queries, chunks, 5, True, strategy=strategy)) == brute(matrix, 20, 5)


def test_large_batches_go_to_blocks(spark):
    matrix = random_vectors(60)
    queries, chunks = frames(spark, matrix, 20)
    job = S.vector_scores(queries, chunks, 5, True, max_queries=10)
    assert ranked(S.rank_scores(job, 5)) == brute(matrix, 20, 5)
    with pytest.raises(ValueError):
        S.vector_scores(queries, chunks, 5, strategy="broadcast", max_queries=10)


def test_ties_and_copies(spark):
    """A third of all rows are copies of one vector: order by id, nothing lost."""
    matrix = np.vstack([np.tile(random_vectors(1, seed=3), (50, 1)), random_vectors(100, seed=4)])
    queries, chunks = frames(spark, matrix, 3)
    assert ranked(S.vector_topk(queries, chunks, 10, True)) == brute(matrix, 3, 10)


def test_unusable_vectors_are_left_out(spark):
    chunks = spark.createDataFrame([(1, [1., 0.]), (2, None), (3, [0., 0.]), (4, [1.]), (5, [0., 1.])], VECTORS)
    queries = spark.createDataFrame([(1, [1., 0.]), (2, None), (3, [0., 0.])], "qid long, emb array<float>")
    for strategy in ("broadcast", "blocks"):
        assert ranked(S.vector_topk(queries, chunks, 5, strategy=strategy)) == {1: [1, 5]}


def test_hot_bucket_is_cut_and_exact(spark):
    matrix = random_vectors(120)
    queries, chunks = frames(spark, matrix, 30)
    cut = S.bucket_scores(queries.withColumn("b", F.lit(1)), chunks.withColumn("b", F.when(F.col("chunk_id") < 110, 1).otherwise(2)),
                          "b", 4, True, query_cell=8, chunk_cell=25)
    want = brute(matrix[:110], 30, 4)
    assert ranked(S.rank_scores(cut, 4)) == want


def test_approximate_recall(spark):
    base = random_vectors(40, seed=8)
    matrix = np.repeat(base, 5, axis=0) + 0.15 * random_vectors(200, seed=9)
    queries, chunks = frames(spark, matrix, 50)
    exact = S.vector_topk(queries, chunks, 4, True)
    approx = S.vector_topk_approx(queries, chunks, 4, dim=16, exclude_self=True)
    assert S.recall_at_k(exact, approx).first()["recall"] >= 0.95


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n // 20, dim)).repeat(20, axis=0) + .4 * rng.normal(size=(n // 20 * 20, dim))


def test_trained_index(spark, tmp_path):
    """Recall and the share of exactly scored pairs over vectors with clusters, a third of them copies of one."""
    matrix = clustered(3000, 32, 5)
    matrix[::3] = matrix[0]
    queries, chunks = frames(spark, matrix, 3000)
    queries = queries.where(F.col("qid") % 30 == 1)
    book = VI.fit(chunks, 32)
    VI.write_index(chunks, book, str(tmp_path))
    index, read = VI.read_index(spark, str(tmp_path))
    assert read.probes == book.probes < len(book.centres) and index.count() == 3000
    exact = S.vector_topk(queries, chunks, 10, True)
    scores = VI.index_scores(queries, index, read, 10, True)
    assert S.recall_at_k(exact, S.rank_scores(scores.where("qid IS NOT NULL"), 10)).first()["recall"] >= 0.9
    assert scores.where("qid IS NULL").agg(F.sum("vector_score")).first()[0] < 0.3 * 3000 * queries.count()
    blocks = S.rank_scores(VI.index_scores(queries, index, read, 10, True, max_queries=10), 10)
    assert S.recall_at_k(exact, blocks).first()["recall"] >= 0.9
    found = VI.index_topk(queries, index, read, 10, True)
    # A query may get fewer than k where the cells it probes hold fewer.
    assert found.count() == found.dropDuplicates(["qid", "chunk_id"]).count() > 9.5 * queries.count()
    plan = VI._probe_scores(index, read, queries.limit(1).select("qid", "emb").toArrow(), 10, True, None, ("bigint", "bigint"))
    read = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*shelf", read) and re.search(r"PushedFilters: \[[^]]*cell", read)


def test_trained_index_of_few_and_odd_vectors(spark, tmp_path):
    rows = [(1, [1., 0.]), (2, None), (3, [0., 0.]), (4, [1.]), (5, [0., 1.]), (6, [1., 0.])]
    chunks = spark.createDataFrame(rows, VECTORS)
    queries = chunks.select(F.col("chunk_id").alias("qid"), "emb")
    assert VI.fit(chunks, 3) is None
    book = VI.fit(chunks, 2)
    VI.write_index(chunks, book, str(tmp_path))
    index, _ = VI.read_index(spark, str(tmp_path))
    assert sorted(r["chunk_id"] for r in index.collect()) == [1, 5, 6]
    got = ranked(VI.index_topk(queries, index, book, 5, exclude_self=True))
    assert got[1][0] == 6 and got[6][0] == 1 and set(got) <= {1, 5, 6}


def test_threshold_falls_back_to_the_best(spark):
    chunks = spark.createDataFrame([(1, [1., 0.]), (2, [.9, .1]), (3, [0., 1.])], VECTORS)
    queries = spark.createDataFrame([(1, [1., 0.]), (2, [-1., -.2])], "qid long, emb array<float>")
    assert ranked(S.threshold_search(queries, chunks)) == {1: [1, 2], 2: [3]}


@pytest.fixture(scope="module")
def corpus(spark):
    documents = spark.createDataFrame(
        [(1, "completed", "public", 1), (2, "completed", "private", 7), (3, "processing", "public", 1), (4, "completed", "public", 1)],
        "doc_id long, status string, access string, owner_id long").withColumn("filename", F.concat(F.lit("f"), "doc_id"))
    chunks = spark.createDataFrame(
        [(10, 1, "the warehouse address", [1., 0.], False), (11, 1, "warehouse rules", [1., 0.], False),
         (20, 2, "private warehouse", [1., 0.], False), (30, 3, "pending", [1., 0.], False), (40, 4, "boilerplate", [1., 0.], True)],
        "chunk_id long, doc_id long, content string, emb array<float>, is_boilerplate boolean").withColumn("page", F.lit(1))
    return documents, chunks


def test_hybrid_respects_visibility_and_order(spark, corpus):
    documents, chunks = corpus
    queries = spark.createDataFrame([(1, "warehouse address", [1., 0.]), (2, "", [1., 0.]), (3, "the", None)],
                                    "qid long, text string, emb array<float>")
    hits = R.hybrid_search(queries, chunks, documents, user_id=99)
    assert ranked(hits) == {1: [10, 11], 2: [10, 11]}
    scores = {(r["qid"], r["chunk_id"]): r["text_score"] for r in hits.collect()}
    assert scores[1, 10] > 0 and scores[1, 11] == 0 and scores[2, 10] == 0
    assert ranked(R.hybrid_search(queries, chunks, documents, user_id=7))[1] == [10, 11, 20]
    assert ranked(R.hybrid_search(queries, chunks, documents, filter_boilerplate=False))[2] == [10, 11, 20, 40]


def test_many_users_at_once(spark, corpus):
    documents, chunks = corpus
    queries = spark.createDataFrame([(1, [1., 0.], 7), (2, [1., 0.], 1), (3, [1., 0.], None)], "qid long, emb array<float>, user_id long")
    assert ranked(R.owner_topk(queries, chunks, documents, 9)) == {1: [10, 11, 20, 40], 2: [10, 11, 40], 3: [10, 11, 40]}


def test_stop_word_query_matches_nothing(spark):
    chunks = spark.createDataFrame([(1, "the and cat")], "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "the"), (2, "CAT cat"), (3, "?")], "qid long, text string")
    hits = R.text_match(queries, R.term_table(chunks, ["the", "and"]))
    assert [(r["qid"], r["chunk_id"]) for r in hits.collect()] == [(2, 1)]


def test_cover_density_three_terms(spark):
    """Against enumeration of minimal covers."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("abcxyz"), 30))) for i in range(40)]
    table = R.term_table(spark.createDataFrame(rows, "chunk_id long, content string"))
    queries = spark.createDataFrame([(1, "a b c")], "qid long, text string")
    got = {r["chunk_id"]: r["cover_score"] for r in R.cover_density(queries, table).collect()}
    want = {}
    for i, text in rows:
        words = text.split()
        spans = [(s, e) for s in range(30) for e in range(s, 30) if {"a", "b", "c"} <= set(words[s:e + 1])]
        minimal = [(s, e) for s, e in spans if not any((s, e) != (a, b) and s <= a and b <= e for a, b in spans)]
        if minimal:
            total = sum(min(1, 16 / (e - s + 1)) for s, e in minimal)
            want[i] = total / (1 + total)
    assert got == pytest.approx(want)


def test_trigram_join_is_exact(spark):
    rng = np.random.default_rng(4)
    names = ["".join(rng.choice(list("abc "), 9)) for _ in range(60)]
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names[:25])], "id long, text string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, text string")
    def grams(t):
        return {("  " + w + " ")[i:i + 3] for w in t.split() for i in range(len(w) + 1)}
    want = {(i, j) for i, a in enumerate(names[:25]) for j, b in enumerate(names)
            if grams(a) and grams(b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > .3}
    got = {(r["left_id"], r["right_id"]) for r in fuzzy.trigram_join(left, right).collect()}
    assert got == want and want


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, "alpha beta", "none", .9), (1, 2, "alpha beta", "alpha", .7), (1, 3, "alpha beta", "beta alpha", .5)],
                                 "qid long, rank int, query_text string, content string, combined_score double")
    plain = R.rerank(hits, top_k=2).orderBy("rank").collect()
    assert [(r["original_rank"], r["relevance"]) for r in plain] == [(1, .9), (2, .7)]
    scored = R.rerank(hits, lexical_scorer).orderBy("rank").collect()
    assert [(r["original_rank"], r["relevance"]) for r in scored] == [(3, 1.0), (2, .5)]


def test_context_stops_at_the_budget(spark):
    hits = spark.createDataFrame([(1, i, str(i), None, 1, "x" * 30) for i in (1, 2, 3)],
                                 "qid long, rank int, citation_id string, filename string, page int, content string")
    row = R.pack_context(hits, budget=100).first()
    assert row["used"] == 2 and row["context"].startswith("[1] (Unknown, p.1)\nxxx") and row["context"].count("---") == 1


def test_context_prefers_the_original_name(spark):
    rows = [(1, 1, "1", "a.txt", "Original.txt", 1, "x"), (1, 2, "2", "b.txt", "", 1, "y"), (1, 3, "3", "", None, 1, "z")]
    hits = spark.createDataFrame(rows, "qid long, rank int, citation_id string, filename string, original_filename string, "
                                       "page int, content string")
    context = R.pack_context(hits).first()["context"]
    assert [line for line in context.split("\n") if line.startswith("[")] == [
        "[1] (Original.txt, p.1)", "[2] (b.txt, p.1)", "[3] (Unknown, p.1)"]


def test_text_hits_keep_their_cosine(spark):
    docs = spark.createDataFrame([(i, "completed", "public", 1) for i in range(4)], "doc_id long, status string, access string, owner_id long")
    chunks = spark.createDataFrame(
        [(0, 0, "other", [1., 0.]), (1, 1, "other", [1., .1]), (2, 2, "wanted word", [.6, .8]), (3, 3, "wanted word", [0., 0.])],
        "chunk_id long, doc_id long, content string, emb array<double>")
    queries = spark.createDataFrame([(9, "wanted word", [1., 0.])], "qid long, text string, emb array<double>")
    got = {r["chunk_id"]: round(r["vector_score"], 6) for r in
           R.hybrid_search(queries, chunks, docs, limit=1, min_score=0.0, vector_weight=.1, text_weight=.9,
                           fusion="full_outer").collect()}
    assert got == {2: .6}
    got = {r["chunk_id"]: round(r["vector_score"], 6) for r in
           R.hybrid_search(queries, chunks, docs, limit=4, min_score=0.0, fusion="full_outer").collect()}
    assert got[2] == .6 and got[3] == 0.0


def test_a_frequent_term_matches_by_the_rarest(spark):
    chunks = spark.createDataFrame([(i, "often " + ("rare" if i % 7 == 0 else "else") + " often") for i in range(50)],
                                   "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "often rare"), (2, "rare unknown"), (3, ""), (4, "Often")], "qid long, text string")
    got = {}
    for r in R.text_match(queries, R.term_counts(chunks, queries)).collect():
        got.setdefault(r["qid"], set()).add(r["chunk_id"])
    assert got == {1: set(range(0, 50, 7)), 4: set(range(50))}


def test_hook_with_too_few_vectors_moves_none(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, text string").coalesce(1)
    def hook(values):
        return [[float(ord(v[0]))] for v in values if v != "bad"]
    got = {r["id"]: (list(r["emb"]), r["embed_failed"]) for r in embed(texts, "text", hook, 1).collect()}
    assert got == {1: ([97.0], False), 2: ([0.0], True), 3: ([99.0], False)}


def test_empty_corpus_reason(spark):
    queries = spark.createDataFrame([(1,)], "qid long")
    none = spark.createDataFrame([], "qid long, doc_id long")
    assert R.empty_reason(queries, none, none).first()["reason"] == "NO_DOCUMENTS"
    assert R.empty_reason(queries, none, queries).first()["reason"] == "NOT_FOUND"


def test_unreadable_verdicts_fail(spark):
    answers = spark.createDataFrame(
        [(1, "q", "draft", '{"verified": true, "confidence": 0.9}'), (2, "q", "draft", "garbage"),
         (3, "q", "draft", 'x {"verified": true, "confidence": 0.5, "removedClaims": ["c"], "correctedResponse": "fixed"}')],
        "answer_id int, query string, response string, verdict string")
    got = [(r["verified"], r["final_response"], r["removed"]) for r in R.audit_records(answers).orderBy("answer_id").collect()]
    assert got == [(True, "draft", 0), (False, "draft", 0), (False, "fixed", 1)]


def test_cache_edges(spark):
    at = F.lit("2026-01-02 00:00:00").cast("timestamp")
    cache = spark.createDataFrame([(1, "h1", [1., 0.], "2026-01-02 00:00:00"), (2, "h2", [1., 0.], "2026-01-03 00:00:00")],
                                  "id long, hash string, emb array<float>, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    queries = spark.createDataFrame([(1, "h1", [1., .01]), (2, "h2", [0., 1.]), (3, "h3", [0., 1.]), (4, "h4", None)],
                                    "qid long, hash string, emb array<float>")
    got = {r["qid"]: (r["hit_kind"], r["cache_id"]) for r in K.resolve_cache(queries, cache, at).collect()}
    assert got == {1: ("semantic", 2), 2: ("exact", 2), 3: ("miss", None), 4: ("miss", None)}
    kept, removed = K.purge(cache, at)
    assert kept.count() == 2 and removed.first()["removed"] == 0
    assert K.cache_stats(cache.where("false").withColumns({"hit_count": F.lit(1), "confidence": F.lit(.5)})).first()[:] == (0, 0, 0.0)


def test_terms_are_counted_without_moving_texts(spark):
    """No exchange below the counts, and the counts of a plain loop."""
    from quillspark.operators.mining import mine_ngrams
    texts = {1: "One two, two; THREE two ü", 2: "", 3: None, 4: "x " * 50 + "y"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    for df in (R.term_counts(chunks), R.term_table(chunks), mine_ngrams(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")))):
        assert "Exchange" not in plan(df)
    got = {(r["chunk_id"], r["term"]): (r["length"], r["tf"], r["positions"]) for r in R.term_table(chunks).collect()}
    assert got == {(1, "one"): (6, 1, [1]), (1, "two"): (6, 3, [2, 3, 5]), (1, "three"): (6, 1, [4]), (1, "ü"): (6, 1, [6]),
                   (4, "x"): (51, 50, list(range(1, 51))), (4, "y"): (51, 1, [51])}
    assert {(r["chunk_id"], r["term"]): r["tf"] for r in R.term_counts(chunks).collect()} == {k: v[1] for k, v in got.items()}
    asked = spark.createDataFrame([(1, "two x")], "qid long, text string")
    assert {r["term"] for r in R.term_counts(chunks, asked).collect()} == {"two", "x"}
