"""Fixed examples for the scalar functions."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import geometry as G, hooks, parsing as P, terms as M, text as X
from quillspark.operators import ingest as I
from quillspark.functions.registry import register_functions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,tokens", [("Hello world this is a test", 9), ("", 0), ("word1   word2    word3", 5)])
def test_estimate_tokens(spark, text, tokens):
    assert value(spark, X.estimate_tokens(F.lit(text))) == tokens


def test_normalisers(spark):
    assert value(spark, X.normalize_match(F.lit("Příliš žluťoučký kůň"))) == "prilis zlutoucky kun"
    assert value(spark, X.normalize_match(F.lit("é X"))) == "e x"
    assert value(spark, X.normalize_term(F.lit("release gate?"))) == "release gate "
    assert value(spark, X.normalize_term(F.lit("ﬁne Ａ"))) == "fine a"
    assert value(spark, X.normalize_term(F.lit(" Ａ² b"))) == "a2 b"


def test_query_hash(spark):
    assert value(spark, X.query_hash(F.lit("Kde  je sklad?"))) == \
        "70fafe87e4c5db646226a53823eed29ab26b1df30445fc5063e36d7ff065ed60"
    assert value(spark, X.query_hash(F.lit("Kde  je sklad?"), "rag-v2")) == \
        "5b0e7c3bf8487bc1d9730a8c62549b62d6aa88f9f2ba5cf01b323a69110431ac"


def test_file_hash(spark):
    assert value(spark, I.file_hash(F.encode(F.lit("abc"), "UTF-8"))) == \
        "35d95694d3f160215db293c7899daa5907837838fb4b8119ed713e32446c1266"
    long = "x" * 500
    want = hashlib.sha256(base64.b64encode(long.encode())).hexdigest()
    assert value(spark, I.file_hash(F.encode(F.lit(long), "UTF-8"))) == want


def test_candidate_terms(spark):
    terms = value(spark, X.candidate_terms(F.lit("Je to GREEN status pro release gate?")))
    assert len(terms) == len(set(terms)) == 18
    assert {"green", "green status", "release gate", "pro release gate"} <= set(terms)
    assert value(spark, X.candidate_terms(F.lit(" ?"))) == []


def test_headers(spark):
    assert value(spark, X.detect_header(F.lit("### Deep  header "))).asDict() == {"level": 3, "text": "Deep  header"}
    assert value(spark, X.detect_header(F.lit("1. Kapitola první:"))).asDict() == {"level": 2, "text": "1. Kapitola první:"}
    for line in ["plain text, with comma", "A" * 80, "", "#no blank"]:
        assert value(spark, X.detect_header(F.lit(line))) is None


def test_filenames(spark):
    stored = "dir\\u1_01234567-89ab-cdef-0123-456789abcdef_smlouva č.pdf"
    assert value(spark, X.display_filename(F.lit(stored))) == "smlouva č.pdf"
    assert value(spark, X.sanitize_filename(F.lit("Smlouva č. 1.pdf"))) == "Smlouva_c._1.pdf"


def test_trigrams(spark):
    assert value(spark, M.trigram_similarity(F.lit("bosbag"), F.lit("bossbag"))) == pytest.approx(6 / 9)
    assert value(spark, M.trigram_similarity(F.lit("?!"), F.lit("a"))) == 0.0


def test_match_all_needs_every_term(spark):
    chunk = F.array(*[F.lit(w) for w in ("a", "b")])
    assert value(spark, M.match_all(chunk, F.array(F.lit("a"), F.lit("b"))))
    assert not value(spark, M.match_all(chunk, F.array(F.lit("a"), F.lit("c"))))
    assert not value(spark, M.match_all(chunk, F.array().cast("array<string>")))


def test_coarse_sets(spark):
    def boxes(*rows):
        return F.array(*[G.box(*r) for r in rows])
    assert value(spark, G.is_coarse(boxes((.1, .1, .85, .5))))
    assert not value(spark, G.is_coarse(boxes((.1, .2, .25, .05))))
    assert value(spark, G.is_coarse(boxes(*[(.05, .1 + .2 * i, .9, .12) for i in range(5)])))


def test_merge_row_boxes(spark):
    merged = value(spark, G.merge_row_boxes(F.array(G.box(.205, .201, .12, .03), G.box(.10, .20, .10, .03),
                                                    G.box(.1, .5, .1, .03))))
    assert len(merged) == 2
    assert merged[0]["x"] == pytest.approx(.1) and merged[0]["width"] == pytest.approx(.225)


def test_sanitize_box(spark):
    assert value(spark, G.sanitize(G.box(float("nan"), 0, 1, 1))) is None
    assert value(spark, G.sanitize(G.box(1.5, 0, 1, 1))) is None
    assert tuple(value(spark, G.sanitize(G.box(-1, .5, 2, 2)))) == (0, .5, 1, .5)


def test_citation_context(spark):
    text = "Prvni veta. Dulezite tvrzeni o skladu [1]. Dalsi veta."
    found = value(spark, P.citation_context(F.lit(text), F.lit("[1]")))
    assert "Dulezite tvrzeni o skladu" in found and "Prvni" not in found
    assert value(spark, P.citation_context(F.lit("no marker"), F.lit("[1]"))) == "no marker"
    assert value(spark, P.footer_context(F.lit(text), F.lit("[1]"), F.lit("  high  light "))) == "high light"


def test_json_and_errors(spark):
    parsed = value(spark, P.extract_json_object(F.lit('x {"a": 1} y'), "a int"))
    assert parsed["a"] == 1
    assert value(spark, P.extract_json_object(F.lit("nothing"), "a int")) is None
    for message, code in [("Error: status code 503", "CHAT_UPSTREAM_TRANSIENT"), ("ETIMEDOUT", "CHAT_UPSTREAM_TRANSIENT"),
                          ("Connection terminated", "CHAT_DB_TRANSIENT"), ("constraint 429x", "CHAT_UNEXPECTED")]:
        assert value(spark, P.classify_error(F.lit(message)))["code"] == code
    assert value(spark, P.ocr_warning(F.lit("ocr_timeout"))) == "ocr_rescue_timeout"
    assert value(spark, P.ocr_warning(F.lit("boom"))) == "ocr_rescue_error"


def test_failed_embeddings_are_zero(spark):
    def flaky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("model")
        return [[1.0, 2.0] for _ in texts]
    rows = hooks.embed(spark.createDataFrame([("good",), ("bad",), (None,)], "t string"), "t", flaky, 2).collect()
    assert [(list(r["emb"]), r["embed_failed"]) for r in rows] == [([1, 2], False), ([0, 0], True), ([1, 2], False)]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT estimate_tokens('a b  c') AS n, query_hash(' Kde  je sklad? ') AS h, "
                    "match_terms('Ab, c') AS t").first()
    assert row["n"] == 5 and row["h"].startswith("70fafe87") and row["t"] == ["ab", "c"]
    parts = spark.sql("SELECT p.part FROM split_long_text(repeat('word ', 1000), 1200, 0.15) p").collect()
    assert [len(p["part"].split()) for p in parts] == [600, 520]


def test_reembed_replaces_every_vector(spark):
    chunks = spark.createDataFrame([(1, "a", [9., 9.]), (2, "b", None)], "chunk_id int, content string, emb array<float>")
    rows = hooks.reembed(chunks, lambda texts: [[1.0, 0.0] for _ in texts], 2).collect()
    assert [(list(r["emb"]), r["length_ok"]) for r in rows] == [([1, 0], True)] * 2


def test_export_profile(spark):
    import json

    from quillspark.operators import templates as T
    anchors = spark.createDataFrame([(2, "Second", "second", 1, 1.0), (1, "First", "first", 3, 1.2)],
                                    "anchor_no int, text string, pattern string, page int, weight double")
    anchors = anchors.withColumn("region", G.box(0, 0, 1, .5))
    prints = spark.createDataFrame([(1, "v", "t")], "page int, visual_hash string, token_hash string")
    made = json.loads(T.export_profile(anchors, prints, "p", "P", 0.5).first()["value"])
    assert made["id"] == "p" and made["matchThreshold"] == 0.5 and made["boilerplatePatterns"] == ["first", "second"]
    assert [(a["text"], a["page"], a["region"]["height"]) for a in made["anchors"]] == [("First", 3, .5), ("Second", 1, .5)]
    assert made["sampledPages"] == [{"page": 1, "visualHash": "v", "tokenHash": "t"}]
