"""Pattern search against plain containment, and profile detection with a large registry."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import pattern_search as P, templates as T

RNG = random.Random(11)
LETTERS = "abcde1"


def words(n, length=6):
    return " ".join("".join(RNG.choice(LETTERS) for _ in range(RNG.randint(1, length))) for _ in range(n))


@pytest.mark.parametrize("max_patterns", [1000, 0])
def test_patterns_are_found_as_substrings(spark, max_patterns):
    texts = [(i, 1 + i % 2, words(RNG.randint(0, 40))) for i in range(60)] + [(60, 1, None), (61, 1, "a"), (62, 1, "abcd " * 2000)]
    patterns = {words(n, 3) for n in (1, 1, 2, 2, 3, 4, 5) for _ in range(30)} | {"a", "e1", "absent words here"}
    for _, _, text in texts[:60]:
        if text and len(text) > 5:
            at = RNG.randrange(len(text) - 4)
            patterns.add(text[at:at + RNG.randint(4, 30)].strip())
    patterns.discard("")
    df = spark.createDataFrame(texts, "doc_id long, page int, body string").repartition(4)
    given = spark.createDataFrame([(p,) for p in [*patterns, *patterns, None, ""]], "norm string")
    got = P.find_patterns(df, ["doc_id", "page"], "body", given, max_patterns).collect()
    want = {(d, p, n) for d, p, t in texts if t for n in patterns if n in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert P.find_patterns(df, ["doc_id"], "body", given.limit(0)).count() == 0
    assert P.find_patterns(df.limit(0), ["doc_id"], "body", given, max_patterns).count() == 0


ANCHORS = "profile_id string, anchor_no int, text string, page int, region struct<x:double,y:double,width:double,height:double>, weight double"
EVIDENCE = ("doc_id long, page int, normalized_text string, visual_hash string, token_hash string, "
            "blocks array<struct<norm:string,box:struct<x:double,y:double,width:double,height:double>>>")


def test_a_registry_of_100_000_anchors(spark):
    """No limit, and no more comparisons than candidates: each page names three of 50 000 profiles."""
    anchors = spark.range(100_000).select(
        F.concat(F.lit("p"), (F.col("id") % 50_000)).alias("profile_id"), F.floor(F.col("id") / 50_000).cast("int").alias("anchor_no"),
        F.concat(F.lit("Form number k"), "id", F.lit(" of the office")).alias("text"), F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("region"), F.lit(1.0).alias("weight"))
    rows = [(d, 1, " ".join(f"form number k{i} of the office" for i in (7 * d, 7 * d + 50_000, 99_999 - d)), "v", "t", []) for d in range(40)]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    hits = {tuple(r) for r in T.anchor_hits(evidence, anchors).select("doc_id", "profile_id", "anchor_no").collect()}
    assert hits == {(d, f"p{i % 50_000}", i // 50_000) for d in range(40) for i in (7 * d, 7 * d + 50_000, 99_999 - d)}
    profiles = spark.range(50_000).select(F.concat(F.lit("p"), "id").alias("profile_id"), F.col("id").cast("int").alias("ord"),
                                          F.lit(0.5).alias("match_threshold"))
    prints = spark.createDataFrame([], "profile_id string, page int, visual_hash string, token_hash string")
    best = {r["doc_id"]: (r["profile_id"], r["score"]) for r in T.detect_profiles(evidence, anchors, profiles, prints).collect()}
    assert best == {d: (f"p{7 * d}", 1.0) for d in range(40)}


def test_detection_equals_the_best_of_the_grid(spark):
    """Sparse scores and one fallback row give what all documents x profiles give."""
    box = (0.0, 0.0, 1.0, 0.5)
    evidence = spark.createDataFrame(
        [(1, 1, "alpha form seven", "v1", "t1", [("alpha form seven", box)]), (1, 2, "nothing", "v2", "t2", []),
         (2, 1, "beta notice", "v9", "t1", []), (3, 1, "plain", "v8", "t8", [])], EVIDENCE)
    anchors = spark.createDataFrame(
        [("a", 1, "Alpha form", 1, box, 2.0), ("a", 2, "missing", None, None, None), ("b", 1, "beta", None, None, 1.0),
         ("c", 1, "alpha form seven", 1, (0.0, 0.9, 1.0, 0.1), 1.0)], ANCHORS)
    profiles = spark.createDataFrame([("a", 0, 0.3), ("b", 1, None), ("c", 2, 0.0), ("d", 3, 0.9)],
                                     "profile_id string, ord int, match_threshold double")
    prints = spark.createDataFrame([("a", 1, "v1", "t0"), ("a", 2, "x", "t2"), ("b", 1, "x", "t1"), ("d", 5, "v", "t")],
                                   "profile_id string, page int, visual_hash string, token_hash string")
    grid = T.profile_scores(evidence, anchors, profiles, prints)
    scores = {(r["doc_id"], r["profile_id"]): round(r["score"], 6) for r in grid.collect()}
    assert len(scores) == 12 and scores[1, "a"] == round(.6 * 2 / 3 + .4 * 1.5 / 2, 6) and scores[2, "b"] == .8 and scores[1, "c"] == 0
    for options in ({}, {"default": "c"}, {"override": "d"}, {"override": "none"}):
        want = sorted(map(tuple, T.best_profile(grid, **options).collect()))
        assert sorted(map(tuple, T.detect_profiles(evidence, anchors, profiles, prints, **options).collect())) == want
