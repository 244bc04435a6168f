"""Chunking against an independent fold, and layout goldens."""

import math
import random

from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.operators import blocks as B, chunking as C, templates as T


def cost(text):
    return math.ceil(len(text.split()) * 1.5)


def expected_split(text, limit, overlap):
    """Same rules, written as one queue of pieces."""
    queue = []
    for line in text.split("\n"):
        if cost(line) <= limit:
            queue.append((line, "\n\n", False))
            continue
        fresh = True
        for sentence in C._SENTENCE.split(line):
            if cost(sentence) <= limit:
                queue.append((sentence, " ", fresh))
            else:
                queue += [(w, " ", i == 0) for i, w in enumerate(sentence.split())]
            fresh = False
    done, current, used = [], None, 0
    for piece, glue, cut in queue:
        if current is not None and (cut or used + cost(piece) > limit):
            done.append(current)
            if cut:
                current = None
            else:
                tail = current.split()[-math.floor(math.floor(limit * overlap) / 1.5):]
                current = " ".join(tail) + glue + piece
                used = cost(current)
                continue
        if current is None:
            current, used = piece, cost(piece)
        else:
            current, used = current + glue + piece, used + cost(piece)
    return done + ([current] if current else [])


def expected_chunks(pages, limit, minimum):
    """Stack fold over lines."""
    stack, segments, current, page_of = [], [], [], None
    for number, text in pages:
        for line in text.split("\n"):
            if not line.strip():
                continue
            hashes = len(line) - len(line.lstrip("#"))
            header = 1 <= hashes <= 6 and line[hashes:hashes + 1] == " "
            if header or number != page_of:
                if current:
                    segments.append((page_of, path, "\n".join(current)))
                current, page_of = [], number
            if header:
                while stack and stack[-1][0] >= hashes:
                    stack.pop()
                stack.append((hashes, line[hashes:].strip()))
            path = " > ".join("#" * k + " " + t for k, t in stack)
            current.append(line)
    if current:
        segments.append((page_of, path, "\n".join(current)))
    out = []
    for number, path, text in segments:
        parts = [text] if cost(text) <= limit else expected_split(text, limit, .15)
        out += [(number, path, p, cost(p)) for p in parts if cost(p) >= minimum]
    return [(i, *row) for i, row in enumerate(out)]


def random_page(rng):
    lines = []
    for _ in range(rng.randint(1, 8)):
        kind = rng.random()
        words = [rng.choice("alpha beta, gamma delta. epsilon! zeta".split()) + rng.choice(["", "", "x"]) for _ in
                 range(rng.choice([3, 10, 40, 150]))]
        lines.append("" if kind < .1 else "#" * rng.randint(1, 4) + f" head {rng.randint(0, 9)}" if kind < .35
                     else "low " + " ".join(words))
    return "\n".join(lines)


def test_chunks_match_the_fold(spark):
    rng = random.Random(5)
    docs = {d: [(p + 1, random_page(rng)) for p in range(rng.randint(1, 4))] for d in range(60)}
    docs[100] = [(1, "low " + " ".join(["word"] * 700) + ". end of it. " + " ".join(["x"] * 90))]
    pages = spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in ps], "doc_id long, page int, text string")
    got = {}
    for r in C.chunk_documents(pages, max_tokens=60, min_tokens=5).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["page"], r["parent_header"], r["content"], r["token_count"]))
    for d, ps in docs.items():
        assert sorted(got.get(d, [])) == expected_chunks(ps, 60, 5), d


def chunks_of(spark, text, **kw):
    pages = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    return C.chunk_documents(pages, **kw).orderBy("chunk_index").collect()


def test_goldens(spark):
    assert chunks_of(spark, "Hello world") == []
    one = chunks_of(spark, " ".join(["word"] * 40))
    assert [(c["page"], c["chunk_index"], c["token_count"]) for c in one] == [(1, 0, 60)]
    two = chunks_of(spark, " ".join(["word"] * 1000), min_tokens=10)
    assert [(len(c["content"].split()), c["token_count"]) for c in two] == [(600, 900), (520, 780)]
    assert [c["chunk_index"] for c in two] == [0, 1]


def test_no_overlap_carries_nothing():
    parts = C.split_text(" ".join(["word"] * 1000), 1200, 0)
    assert [len(p.split()) for p in parts] == [600, 400]


def test_dropped_segments_are_counted(spark):
    pages = spark.createDataFrame([(1, 1, "tiny\n# Head\n" + "word " * 60)], "doc_id long, page int, text string")
    row = C.chunk_drop_stats(pages).first()
    assert (row["kept"], row["dropped"]) == (1, 1)


def test_blocks_stay_on_their_page(spark):
    text = "Shared sentence about operating procedures"
    box = {1: (.1, .12, .8, .06), 2: (.1, .5, .8, .06)}
    blocks = spark.createDataFrame([(1, p, 0, text, *b) for p, b in box.items()],
                                   "doc_id long, page int, pos int, text string, x double, y double, w double, h double")
    blocks = blocks.select("doc_id", "page", "pos", "text", G.box(*[F.col(c) for c in "xywh"]).alias("box"))
    chunks = spark.createDataFrame([("a", 1, 1, text), ("b", 1, 9, text)],
                                   "chunk_id string, doc_id long, page int, content string")
    matches = B.match_blocks(chunks, blocks)
    got = {r["chunk_id"]: tuple(r["bbox"]) for r in B.chunk_boxes(chunks, matches).collect()}
    assert got["a"] == (.1, .12, .8, .06) and got["b"] == (0, 0, 0, 0)
    boxes = {r["chunk_id"]: r["boxes"] for r in B.highlight_boxes(chunks, matches).collect()}
    assert len(boxes["a"]) == 1 and boxes["b"] is None


def test_regions(spark):
    df = spark.range(1).select(F.lit("k").alias("key"), F.array(
        G.box(.1, .8, .2, .03), G.box(.1, .1, .3, .03), G.box(.1, .14, .3, .03)).alias("boxes"))
    rows = B.cluster_regions(df).orderBy("region_id").collect()
    assert [(r["region_id"], len(r["boxes"])) for r in rows] == [(1, 2), (2, 1)]


def test_narrowing_needs_two_spans(spark):
    blocks = spark.createDataFrame([(1, 1, i, t, .1, .1 + .04 * i) for i, t in enumerate(
        ["warehouse address rules", "warehouse opening hours", "unrelated footer"])],
        "doc_id long, page int, pos int, text string, x double, y double")
    blocks = blocks.select("doc_id", "page", "pos", "text", G.box(F.col("x"), F.col("y"), .6, .03).alias("box"))
    def run(context):
        c = spark.range(1).select(F.lit("c").alias("citation_id"), F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"),
                                  F.lit(context).alias("context"), F.array(G.box(.05, .05, .8, .3)).alias("boxes"))
        return B.narrow_context(c, blocks).collect()
    assert run("the warehouse address rules and warehouse opening hours")[0]["spans"] == 2
    assert run("footer") == []


def test_sample_sizes(spark):
    counts = [0, 1, 2, 3, 31, 50, 120, 500]
    df = spark.createDataFrame([(c,) for c in counts], "n int")
    got = {r["n"]: r["k"] for r in df.select("n", T.sample_size("n").alias("k")).collect()}
    assert [got[c] for c in counts] == [0, 1, 2, 3, 4, 5, 12, 12]


def test_fingerprints(spark):
    rows = [("Demo Agency", .05), ("Kontakt", .12), ("Operational policy details for normal procedures.", .28)]
    blocks = spark.createDataFrame([(1, 1, i, t, y) for i, (t, y) in enumerate(rows)],
                                   "doc_id long, page int, pos int, text string, y double")
    blocks = blocks.select("doc_id", "page", "pos", "text", G.box(.1, F.col("y"), .7, .06).alias("box"))
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0), (1, 3, 612.0, 792.0)], "doc_id long, page int, width double, height double")
    got = {r["page"]: r["visual_hash"] for r in T.layout_hash(pages, blocks).collect()}
    assert got == {1: "0b6a78df302a19d4dce8ba12", 3: "ed49990879a092da50e47adc"}
    text = F.lit(" ".join(t for t, _ in rows))
    assert spark.range(1).select(T.token_hash(text)).first()[0] == "6312906dedafdc54050704b5"


def test_boilerplate(spark):
    chunks = spark.createDataFrame([(1, "p", "Demo Agency kontakt +420 222"), (2, "p", "actual operating guidance"),
                                    (3, None, "kontakt"), (4, "p", "kontaktní osoba")],
                                   "chunk_id int, profile_id string, content string")
    patterns = spark.createDataFrame([("p", "kontakt"), ("p", "+420")], "profile_id string, pattern string")
    def flags(**kw):
        return [r["is_boilerplate"] for r in T.classify_boilerplate(chunks, patterns, **kw).orderBy("chunk_id").collect()]
    assert flags() == [True, False, False, True]
    assert flags(token_bounded=True) == [True, False, False, False]


def test_boilerplate_of_many_patterns(spark):
    patterns = spark.range(20_000).select(F.concat(F.lit("p"), F.col("id") % 40).alias("profile_id"),
                                          F.concat(F.lit("line number "), F.col("id"), F.lit(" end")).alias("pattern"))
    chunks = spark.createDataFrame([(1, "p3", "A line number 19963 end."), (2, "p4", "line number 19963 end"), (3, "none", "x"),
                                    (4, None, "line number 19963 end")], "chunk_id int, profile_id string, content string")
    got = T.classify_boilerplate(chunks, patterns).orderBy("chunk_id").collect()
    assert [r["is_boilerplate"] for r in got] == [True, False, False, False]


def test_unknown_override_keeps_the_document(spark):
    scores = spark.createDataFrame([(1, "a", 0, .5, .9), (2, "a", 0, .5, .2)],
                                   "doc_id long, profile_id string, ord int, threshold double, score double")
    got = [tuple(r) for r in T.best_profile(scores, override="gone").orderBy("doc_id").collect()]
    assert got == [(d, None, False, None, ["profile_override_not_found"]) for d in (1, 2)]
    got = [tuple(r) for r in T.best_profile(scores, override="a").orderBy("doc_id").collect()]
    assert got == [(1, "a", True, .9, []), (2, None, False, .2, ["low_confidence"])]


def test_ocr_candidates(spark):
    docs = spark.createDataFrame([(1, "application/pdf"), (2, "application/pdf"), (3, "text/plain")], "doc_id long, mime string")
    pages = spark.createDataFrame([(d, p, "short" if p > 2 else "x" * 200) for d in (1, 2, 3) for p in range(1, 26)],
                                  "doc_id long, page int, text string")
    chunks = spark.createDataFrame([(1,)] * 2 + [(2,)] * 3, "doc_id long")
    got = sorted((r["doc_id"], r["page"]) for r in T.ocr_candidates(docs, pages, chunks).collect())
    assert got == [(1, p) for p in range(3, 23)]


def test_ocr_rescue(spark):
    pages = spark.createDataFrame([(1, 1, ""), (2, 1, ""), (3, 1, "word " * 60)], "doc_id long, page int, text string")
    ocr = spark.createDataFrame([(1, 1, "short scan"), (2, 1, "  "), (3, 1, "tail")], "doc_id long, page int, ocr_text string")
    chunks, summary = T.rescue_with_ocr(pages, ocr)
    assert [(r["doc_id"], r["content"]) for r in chunks.collect()] == [(1, "short scan")]
    got = {r["doc_id"]: (r["chunks_before"], r["chunks_after"], r["applied"], list(r["warnings"])) for r in summary.collect()}
    assert got == {1: (0, 1, True, ["ocr_rescue_short_text_fallback_chunk"]), 3: (1, 1, False, ["ocr_rescue_no_chunk_gain"])}
