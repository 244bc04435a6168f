"""Texts and lines are normalised once, whatever the number of patterns and conditions on them."""

from pyspark.sql import functions as F

from quillspark.operators import blocks as B, templates as T


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_not_normalised_for_each_pattern(spark):
    chunks = spark.createDataFrame([(1, "Übung: page 7 of 9", "p"), (2, None, "p"), (3, "nothing", "p"), (4, "page 7 of 9", "q")],
                                   "doc_id long, content string, profile_id string")
    patterns = spark.createDataFrame([("p", "Page 7"), ("p", ""), ("p", "OF 9"), ("p", None)], "profile_id string, pattern string")
    found = T.classify_boilerplate(chunks, patterns)
    inside = [line.split("exists(", 1)[1] for line in optimized(found).splitlines() if "exists(" in line]
    assert inside and not any("translate(" in x for x in inside)
    assert {r["doc_id"]: r["is_boilerplate"] for r in found.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_a_line_is_normalised_once(spark):
    docs = spark.createDataFrame([(1, "Page  one\n\n  12345678 \nshort\nPAGE one"), (2, None), (3, " \n "), (4, "tail\npáge one\r\n" + "x" * 141)],
                                 "doc_id long, text string")
    blocks = B.page_blocks(docs.withColumn("page", F.lit(1)))
    assert [(r["doc_id"], r["pos"], r["text"]) for r in blocks.orderBy("doc_id", "pos").collect()] == [
        (1, 0, "Page  one"), (1, 1, "12345678"), (1, 2, "short"), (1, 3, "PAGE one"), (4, 0, "tail"), (4, 1, "páge one"), (4, 2, "x" * 141)]
    mined = T.mine_profile(blocks)
    assert optimized(mined).count("translate(") == 1
    assert [(r["pattern"], r["count"], r["text"]) for r in mined.collect()] == [("page one", 3, "Page one")]
