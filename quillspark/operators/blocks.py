"""Text blocks with boxes: building them, and tying chunks to the blocks they came from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as G
from ..functions.text import collapse_spaces, normalize_match, tokenize_match, trim_unicode
from ..session import materialize

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
MAX_MATCHES, MAX_BOXES, MAX_MERGED = 64, 48, 24


def text_to_blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one block per non-blank line; rows are spread over the page by
    the total number of lines, blank ones included."""
    lines = F.split("text", "\n")
    kept = F.filter(F.transform(lines, trim_unicode), lambda s: s != "")
    height = F.lit(1.0) / F.col("_n")
    # Counted before the explode, so that the text does not go along with every line. The outer form: under the
    # other one Spark splits and trims each text again to leave out those without a line.
    return (docs.select("doc_id", F.size(lines).alias("_n"), kept.alias("_kept"))
            .select("doc_id", "_n", F.posexplode_outer("_kept").alias("pos", "text"))
            .where(F.col("pos").isNotNull())
            .select("doc_id", F.lit(1).alias("page"), "pos", "text",
                    G.box(0, F.col("pos") * height, 1, height).alias("box")))


def page_blocks(pages: DataFrame) -> DataFrame:
    """The same for pages(doc_id, page, text)."""
    keyed = pages.select(F.struct("doc_id", "page").alias("doc_id"), "text")
    return text_to_blocks(keyed).select("doc_id.doc_id", "doc_id.page", "pos", "text", "box")


def normalize_items(items: DataFrame) -> DataFrame:
    """Raw items(doc_id, page, pos, text, x, y, width, height, scale_x, scale_y, page_width,
    page_height) with the origin bottom left -> blocks with the origin top left."""
    font = F.sqrt(F.col("scale_x") ** 2 + F.col("scale_y") ** 2)
    width = F.coalesce(F.nullif(F.col("width"), F.lit(0.0)), F.length("text") * font * 0.6)
    height = F.coalesce(F.nullif(F.col("height"), F.lit(0.0)), font)
    x = G.clamp01(F.col("x") / F.col("page_width"))
    y = G.clamp01(1 - (F.col("y") + height) / F.col("page_height"))
    w = F.greatest(F.lit(0.0), F.least(1 - x, width / F.col("page_width")))
    h = F.greatest(F.lit(0.0), F.least(1 - y, height / F.col("page_height")))
    return (items.where(trim_unicode("text") != "")
            .select("doc_id", "page", "pos", "text", G.box(x, y, w, h).alias("box")))


def assemble_pages(blocks: DataFrame, separator: str = " ") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.when(trim_unicode("text") != "", F.struct("pos", "text"))))
    return (blocks.groupBy("doc_id", "page")
            .agg(F.array_join(F.transform(ordered, lambda r: r["text"]), separator).alias("full_text")))


def match_blocks(chunks: DataFrame, blocks: DataFrame, max_matches: int = MAX_MATCHES) -> DataFrame:
    """Blocks of the chunk's own page that its text came from, best first. Equi-join on
    (doc_id, page); one page holds a bounded number of blocks and chunks."""
    prepared = chunks.select(
        "chunk_id", "doc_id", "page", "content", normalize_match("content").alias("_norm"),
        F.array_distinct(tokenize_match("content")).alias("_tokens"))
    raw = trim_unicode("text")
    sides = blocks.where(raw != "").select(
        "doc_id", "page", "pos", F.col("text").alias("block_text"), "box", raw.alias("_raw"),
        normalize_match("text").alias("_bnorm"), tokenize_match("text").alias("_btokens"))
    joined = prepared.join(sides, ["doc_id", "page"])
    overlap = F.size(F.filter("_btokens", lambda t: F.array_contains(F.col("_tokens"), t)))
    scored = (joined
              .withColumn("_overlap", overlap)
              .withColumn("_ratio", F.coalesce(F.try_divide("_overlap", F.size("_btokens")), F.lit(0.0)))
              .withColumn("_exact", (F.length("_bnorm") >= 6) & F.contains("_norm", "_bnorm"))
              .withColumn("_has_raw", (F.length("_raw") >= 8) & F.contains("content", "_raw"))
              .withColumn("score", F.col("_exact").cast("int") * 3 + F.col("_has_raw").cast("int") * 2
                          + F.col("_overlap") + F.col("_ratio"))
              .withColumn("_strong", F.col("_exact") | F.col("_has_raw") | (F.col("_overlap") >= 2)
                          | (F.col("_ratio") >= 0.5))
              .where(F.col("_strong") | (F.col("_overlap") > 0)))
    any_strong = F.max("_strong").over(W.partitionBy("doc_id", "page", "chunk_id"))
    best = W.partitionBy("doc_id", "page", "chunk_id").orderBy(
        F.desc("score"), F.col("box.y"), F.col("box.x"), "pos")
    return (scored.withColumn("_any", any_strong)
            .where(F.col("_strong") | ~F.col("_any"))
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= max_matches)
            .select("chunk_id", "doc_id", "page", "pos", "block_text", "box", "score", "rank"))


def _envelope_agg() -> Column:
    left, top = F.min("box.x"), F.min("box.y")
    return G.box(left, top, F.max(G.right(F.col("box"))) - left, F.max(G.bottom(F.col("box"))) - top)


def chunk_boxes(chunks: DataFrame, matches: DataFrame) -> DataFrame:
    """Envelope of the matched boxes; a zero box for chunks without a match."""
    found = matches.groupBy("chunk_id").agg(_envelope_agg().alias("bbox"))
    return (chunks.select("chunk_id").join(found, "chunk_id", "left")
            .select("chunk_id", F.coalesce("bbox", G.box(0, 0, 0, 0)).alias("bbox")))


def highlight_boxes(chunks: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct matched boxes in reading order, merged per row. At most 64 matches per chunk
    arrive here, so the per-chunk array is bounded. Matches are read twice, so they are written once."""
    matches = materialize(matches.select("chunk_id", "box", "rank"))
    rounded = [F.format_number(F.col("_box")[n], 4) for n in ("x", "y", "width", "height")]
    usable = matches.withColumn("_box", G.sanitize("box")).where(F.col("_box").isNotNull())
    distinct = (usable.groupBy("chunk_id", F.concat_ws(":", *rounded).alias("_key"))
                .agg(F.min_by("_box", "rank").alias("_box")))
    merged = (distinct.groupBy("chunk_id").agg(F.collect_list("_box").alias("_all"))
              .select("chunk_id", F.slice(G.merge_row_boxes(F.slice(G.by_row("_all"), 1, MAX_BOXES)),
                                          1, MAX_MERGED).alias("boxes")))
    fallback = (chunk_boxes(chunks, matches)
                .select("chunk_id", G.sanitize("bbox").alias("_chunk_box")))
    return (fallback.join(merged, "chunk_id", "left")
            .select("chunk_id", F.coalesce("boxes", F.when(F.col("_chunk_box").isNotNull(), F.array("_chunk_box")))
                    .alias("boxes")))


def highlight_text(matches: DataFrame, pieces: int = 6, limit: int = 480) -> DataFrame:
    texts = matches.withColumn("_text", collapse_spaces("block_text")).where(F.col("_text") != "")
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col("box.y").alias("y"), F.col("box.x").alias("x"), "rank", "_text")))
    joined = F.array_join(F.transform(F.slice(ordered, 1, pieces), lambda r: r["_text"]), " ")
    return (texts.groupBy("chunk_id").agg(F.substring(F.trim(joined), 1, limit).alias("highlight_text")))


def attach_layout(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks with bbox, boxes and highlight_text."""
    matches = match_blocks(chunks, blocks)
    return (chunks.join(chunk_boxes(chunks, matches), "chunk_id", "left")
            .join(highlight_boxes(chunks, matches), "chunk_id", "left")
            .join(highlight_text(matches), "chunk_id", "left"))


def cluster_regions(boxes: DataFrame, v_gap: float = 0.045, h_gap: float = 0.08) -> DataFrame:
    """boxes(key, boxes array<box>) -> one row per region. The fold over one citation's boxes
    (a few dozen) depends on the order, so it runs on Arrow batches of many citations."""
    schema = f"key {boxes.schema['key'].dataType.simpleString()}, region_id int, boxes array<{G.BOX}>, envelope {G.BOX}"

    def run(batches):
        for pdf in batches:
            out = []
            for key, group in zip(pdf["key"], pdf["boxes"]):
                regions: list[list] = []
                for b in sorted(([] if group is None else list(group)), key=lambda r: (r["y"], r["x"])):
                    x0, y0, x1, y1 = b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]
                    home = next((r for r in regions
                                 if y0 <= r[3] + v_gap and r[1] <= y1 + v_gap
                                 and x0 <= r[2] + h_gap and r[0] <= x1 + h_gap), None)
                    if home is None:
                        regions.append([x0, y0, x1, y1, [b]])
                    else:
                        home[:4] = [min(home[0], x0), min(home[1], y0), max(home[2], x1), max(home[3], y1)]
                        home[4].append(b)
                regions.sort(key=lambda r: (r[1], r[0]))
                for number, (x0, y0, x1, y1, members) in enumerate(regions, 1):
                    out.append((key, number, [dict(m) for m in members],
                                {"x": x0, "y": y0, "width": x1 - x0, "height": y1 - y0}))
            yield pd.DataFrame(out, columns=["key", "region_id", "boxes", "envelope"])
    return boxes.select("key", "boxes").mapInPandas(run, schema)


def narrow_context(citations: DataFrame, blocks: DataFrame, margin: float = 0.015, keep: float = 0.75,
                   max_spans: int = 8, max_boxes: int = 6, min_area: float = 0.0008,
                   min_spans: int = 2) -> DataFrame:
    """citations(citation_id, doc_id, page, context, boxes) -> the few blocks inside the best
    region whose words occur in the context, merged per row. Citations that fail the spatial
    gate give no row (the caller keeps the original boxes)."""
    regions = (cluster_regions(citations.select(F.col("citation_id").alias("key"), "boxes"))
               .select(F.col("key").alias("citation_id"), "region_id", "envelope"))
    words = F.array_distinct(tokenize_match("context"))
    sides = (blocks.select("doc_id", "page", "pos", "box", tokenize_match("text").alias("_tokens"))
             .where((F.size("_tokens") > 0) & (F.col("box.width") > 0) & (F.col("box.height") > 0)))
    overlap = F.size(F.filter("_tokens", lambda t: F.array_contains(F.col("_words"), t)))
    cover = F.try_divide(G.intersection_area("box", "envelope"), F.greatest(G.area("box"), F.lit(1e-6)))
    scored = (citations.select("citation_id", "doc_id", "page", words.alias("_words"))
              .join(regions, "citation_id")
              .join(sides, ["doc_id", "page"])
              .where(G.intersection_area("box", G.expand("envelope", margin)) > 0)
              .withColumn("_overlap", overlap).where(F.col("_overlap") > 0)
              .withColumn("_score", F.lit(0.75) * F.col("_overlap") / F.size("_tokens") + F.lit(0.25) * cover))
    by_region = W.partitionBy("citation_id", "region_id")
    ranked = (scored.withColumn("_rn", F.row_number().over(by_region.orderBy(F.desc("_score"), "pos")))
              .withColumn("_region_score", F.sum(F.when(F.col("_rn") <= 3, F.col("_score"))).over(by_region))
              .withColumn("_top", F.max("_score").over(by_region)))
    best = W.partitionBy("citation_id").orderBy(F.desc("_region_score"), "region_id")
    chosen = (ranked.withColumn("_region_rank", F.dense_rank().over(best))
              .where((F.col("_region_rank") == 1) & (F.col("_score") >= F.col("_top") * keep)
                     & (F.col("_rn") <= max_spans)))
    merged = (chosen.groupBy("citation_id")
              .agg(F.count("*").alias("spans"), F.collect_list("box").alias("_boxes"))
              .withColumn("boxes", F.slice(G.merge_row_boxes("_boxes"), 1, max_boxes)))
    return (merged.where((G.total_area("boxes") >= min_area) & (F.col("spans") >= min_spans))
            .select("citation_id", "spans", "boxes"))


def preview(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Readable text per document, or a coded reason why there is none."""
    piece = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", piece.alias("text"))))
    texts = (chunks.groupBy("doc_id")
             .agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n-------------------\n\n")
                  .alias("content")))
    return (documents.join(texts, "doc_id", "left")
            .select("doc_id", "content",
                    F.when(F.col("content").isNotNull(), F.lit(None).cast("string"))
                    .when(F.col("status") == "failed", "DOCUMENT_PREVIEW_EMPTY")
                    .otherwise("DOCUMENT_PREVIEW_NOT_FOUND").alias("code")))
