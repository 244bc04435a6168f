"""Sparse scores of long anchors: their patterns are written with one key, not with each."""

from quillspark.functions import geometry as G
from quillspark.operators import pattern_search as P, templates as T


def test_long_anchors(spark, monkeypatch):
    written = []
    store = P.materialize

    def kept(df):
        written.append(store(df))
        return written[-1]
    monkeypatch.setattr(P, "materialize", kept)
    line = " ".join(f"word{i}" for i in range(30))
    pages = spark.createDataFrame([(1, 1, f"{line} tail", "v", "t"), (1, 2, f"{line} end", "v", "t"), (2, 1, "other words", "v", "t")],
                                  "doc_id long, page int, normalized_text string, visual_hash string, token_hash string")
    pages = pages.selectExpr("*", f"cast(array() as array<struct<norm:string,box:{G.BOX}>>) as blocks")
    anchors = spark.createDataFrame([(7, 1, line, None, None, 1.0), (7, 2, "not there", None, None, 1.0), (8, 1, "Other WORDS", None, None, None)],
                                    f"profile_id long, anchor_no int, text string, page int, region {G.BOX}, weight double")
    profiles = spark.createDataFrame([(7, 1, None), (8, 2, None)], "profile_id long, ord int, match_threshold double")
    none = pages.where("false").selectExpr("doc_id as profile_id", "page", "visual_hash", "token_hash")
    scores = T.sparse_scores(pages, anchors, profiles, none)
    assert sorted((r["doc_id"], r["profile_id"], r["score"]) for r in scores.collect()) == [(1, 7, 0.5), (2, 8, 1.0)]
    assert sum(df.count() for df in written if "key" in df.columns and "norm" in df.columns) <= 3
