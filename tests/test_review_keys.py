"""Keys of approved concepts, and the n-grams that review starts from."""

from pyspark.sql import functions as F

from quillspark.functions.text import upper_single
from quillspark.operators import mining as N


def test_capitals_are_single_characters(spark):
    words = ["gelich\u00df", "gelichss", "\ufb01x", "\u1f80", "\u00e4\u010d", None]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(upper_single("w")).collect()
    assert [r[0] for r in got] == ["GELICH\u1e9e", "GELICHSS", "\ufb01X", "\u1f88", "\u00c4\u010c", None]


def test_ngrams_in_order_of_first_use(spark):
    text = "The gate. The gate, the GATE of it; a " + "x" * 31 + " the"
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc_id string, text string")
    got = N.mine_ngrams(docs).orderBy("ord").collect()
    # "of", "it", "a" and the long word are no words, so the last "gate" and "the" are neighbours.
    assert [(r["doc_id"], r["term_normalized"], r["occurrences"], r["ord"]["at"]) for r in got] == [
        ("a", "the", 4, 0), ("a", "the gate", 3, 1), ("a", "gate", 3, 2), ("a", "gate the", 3, 3)]
    assert [r["term_normalized"] for r in N.mine_ngrams(docs, cap=2).orderBy("ord").collect()] == ["the", "the gate"]
