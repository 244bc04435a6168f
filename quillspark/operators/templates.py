"""Template detection: page fingerprints, profile scoring, boilerplate flags, profile mining
and OCR-candidate selection.

Chunks meet the patterns of their own profile by a join. To find a page's profile, its text meets only the
anchors filed under a key it holds (pattern_search), whatever the number of profiles, and only the
profiles that a document has evidence for get a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as G
from ..functions.text import bind, collapse_spaces, normalize_match, tokenize_match, trim_unicode
from .pattern_search import find_patterns
from .chunking import MAX_TOKENS, MIN_TOKENS, OVERLAP, document_lines, segments, split_long
from ..functions.text import estimate_tokens

MAX_REGISTRY = 10_000  # rows of a profile's export
MIN_PAGES, MAX_PAGES, PAGE_SHARE = 3, 12, 0.10
TEXT_LAYER_MIN, DEFAULT_THRESHOLD = 50, 0.72
ANCHOR_OVERLAP, CHUNK_OVERLAP = 0.15, 0.2
OCR_CHUNK_LIMIT, OCR_TEXT_LIMIT, OCR_PAGE_CAP = 2, 120, 20


def with_registry(df: DataFrame, name: str, registry: DataFrame, entry: Column,
                  limit: int = MAX_REGISTRY) -> DataFrame:
    """Adds all rows of a bounded configuration table as one array column."""
    whole = registry.limit(limit + 1).agg(F.collect_list(entry).alias("a"))
    checked = whole.select(F.when(F.size("a") > limit, F.raise_error(F.lit(f"registry exceeds {limit} rows")))
                           .otherwise(F.col("a")))
    return df.withColumn(name, checked.scalar())


def sample_size(page_count: Column | str) -> Column:
    n = F.col(page_count) if isinstance(page_count, str) else page_count
    wanted = F.least(F.lit(MAX_PAGES), F.greatest(F.lit(MIN_PAGES), F.ceil(n * F.lit(PAGE_SHARE))))
    return F.greatest(F.lit(0), F.least(n, wanted)).cast("int")


def sampled_pages(pages: DataFrame) -> DataFrame:
    """The first pages of each document, 3 to 12 depending on its length."""
    count = F.count("*").over(W.partitionBy("doc_id"))
    return (pages.withColumn("_pages", count).where(F.col("page") <= sample_size("_pages"))
            .drop("_pages"))


def _fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def layout_hash(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages(doc_id, page, width, height) and their blocks -> a hash of where text sits."""
    def percent(name: str) -> Column:
        return F.floor(F.col("box")[name] * 100 + 0.5).cast("string")
    packed = F.concat(F.concat_ws(",", *[percent(n) for n in ("x", "y", "width", "height")]), F.lit(":"),
                      F.substring(normalize_match("text"), 1, 32))
    per_page = blocks.groupBy("doc_id", "page").agg(
        F.sort_array(F.collect_list(F.when(trim_unicode("text") != "", packed))).alias("_packed"))
    empty = F.concat(F.lit("empty:"), F.floor(F.col("width") + 0.5).cast("string"), F.lit("x"),
                     F.floor(F.col("height") + 0.5).cast("string"), F.lit("|page:"), F.col("page").cast("string"))
    return (pages.select("doc_id", "page", "width", "height").join(per_page, ["doc_id", "page"], "left")
            .select("doc_id", "page",
                    _fingerprint(F.when(F.col("_packed").isNull(), empty)
                                 .otherwise(F.array_join("_packed", "|"))).alias("visual_hash")))


def token_hash(text: Column | str) -> Column:
    return _fingerprint(F.array_join(F.slice(tokenize_match(text), 1, 160), "|"))


def page_evidence(pages: DataFrame, blocks: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """Per sampled page: merged text, flags, fingerprints, and the page's own blocks.
    ocr(doc_id, page, ocr_text) is used only on pages whose text layer is short."""
    sampled = sampled_pages(pages)
    blocks = blocks.join(sampled.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    kept = trim_unicode("text")
    ordered = F.array_sort(F.collect_list(F.when(kept != "", F.struct("pos", kept.alias("text"), "box"))))
    layer = (blocks.groupBy("doc_id", "page")
             .agg(F.sum(F.length(kept)).alias("_chars"), ordered.alias("_blocks")))
    base = (sampled.join(layer, ["doc_id", "page"], "left")
            .join(layout_hash(sampled, blocks), ["doc_id", "page"]))
    if ocr is None:
        base = base.withColumn("_ocr", F.lit(""))
    else:
        base = (base.join(ocr.select("doc_id", "page", trim_unicode("ocr_text").alias("_found")),
                          ["doc_id", "page"], "left")
                .withColumn("_ocr", F.when(F.coalesce("_chars", F.lit(0)) < TEXT_LAYER_MIN,
                                           F.coalesce("_found", F.lit(""))).otherwise("")))
    layer_text = F.coalesce(F.array_join(F.transform("_blocks", lambda b: b["text"]), " "), F.lit(""))
    merged = F.trim(F.concat_ws(" ", F.nullif("_layer", F.lit("")), F.nullif("_ocr", F.lit(""))))
    return (base.withColumn("_layer", layer_text).withColumn("text", merged)
            .select("doc_id", "page", "text", normalize_match("text").alias("normalized_text"),
                    (F.length("_layer") >= TEXT_LAYER_MIN).alias("has_text_layer"),
                    (F.col("_ocr") != "").alias("has_ocr_text"), "visual_hash",
                    token_hash("text").alias("token_hash"),
                    F.transform(F.coalesce("_blocks", F.array().cast(f"array<struct<pos:int,text:string,box:{G.BOX}>>")),
                                lambda b: F.struct(normalize_match(b["text"]).alias("norm"), b["box"].alias("box")))
                    .alias("blocks")))


def detection_mode(evidence: DataFrame) -> DataFrame:
    text, ocr = F.bool_or("has_text_layer"), F.bool_or("has_ocr_text")
    return (evidence.groupBy("doc_id").agg(text.alias("_t"), ocr.alias("_o"))
            .select("doc_id", F.when(F.col("_t") & F.col("_o"), "hybrid").when(F.col("_o"), "ocr")
                    .when(F.col("_t"), "text").otherwise("none").alias("mode")))


def _anchor_entry() -> Column:
    return F.struct("profile_id", "anchor_no", normalize_match("text").alias("norm"), "page", "region",
                    F.coalesce("weight", F.lit(1.0)).alias("weight"))


def anchor_hits(evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors found on the sampled pages: (doc_id, profile_id, anchor_no, weight), for registries of any size."""
    entries = anchors.select("profile_id", "anchor_no", normalize_match("text").alias("norm"), F.col("page").alias("_page"), "region",
                             F.coalesce("weight", F.lit(1.0)).alias("weight"))
    found = find_patterns(evidence, ["doc_id", "page"], "normalized_text", entries)
    met = found.join(entries, "norm").where(F.col("_page").isNull() | (F.col("_page") == F.col("page")))
    # Only anchors with a region need the page's blocks.
    somewhere = met.where(F.col("region").isNull()).select("doc_id", "profile_id", "anchor_no", "weight")
    placed = met.where(F.col("region").isNotNull()).join(evidence.select("doc_id", "page", "blocks"), ["doc_id", "page"])
    inside = (F.size("blocks") == 0) | F.exists("blocks", lambda b: F.contains(b["norm"], F.col("norm"))
                                                & (G.overlap_ratio(b["box"], F.col("region")) >= ANCHOR_OVERLAP))
    placed = placed.where(inside).select("doc_id", "profile_id", "anchor_no", "weight")
    return somewhere.unionByName(placed).groupBy("doc_id", "profile_id", "anchor_no").agg(F.max("weight").alias("weight"))


def _profile_entries(anchors: DataFrame, profiles: DataFrame) -> DataFrame:
    totals = anchors.groupBy("profile_id").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("total"))
    return profiles.join(totals, "profile_id", "left").select(
        "profile_id", "ord", F.coalesce("match_threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce("total", F.lit(0.0)).alias("total"))


def sparse_scores(evidence: DataFrame, anchors: DataFrame, profiles: DataFrame, sampled: DataFrame) -> DataFrame:
    """(doc_id, profile_id, ord, threshold, score) of the profiles a document has any evidence for: 0.6 anchors +
    0.4 page fingerprints. All other profiles score 0."""
    hits = anchor_hits(evidence, anchors).groupBy("doc_id", "profile_id").agg(F.sum("weight").alias("hit"))
    pages = evidence.select("doc_id", "page", "visual_hash", "token_hash")
    # A print counts once by its better match: 1 by layout, else a half by words.
    prints = sampled.select("profile_id", "page", F.col("visual_hash").alias("_v"), F.col("token_hash").alias("_t"))
    same = (pages.join(prints, (pages["page"] == prints["page"]) & (F.col("visual_hash") == F.col("_v")))
            .select("doc_id", "profile_id", F.lit(1.0).alias("seen"))
            .unionByName(pages.join(prints, (pages["page"] == prints["page"]) & (F.col("token_hash") == F.col("_t"))
                                    & ~F.col("visual_hash").eqNullSafe(F.col("_v")))
                         .select("doc_id", "profile_id", F.lit(0.5).alias("seen"))))
    seen = same.groupBy("doc_id", "profile_id").agg(F.sum("seen").alias("seen"))
    pairs = hits.join(seen, ["doc_id", "profile_id"], "full")
    # How many of the profile's prints stand on pages the document has.
    numbers = sampled.groupBy("profile_id", "page").agg(F.count("*").alias("_n"))
    rows = (pairs.select("doc_id", "profile_id").join(numbers, "profile_id").join(pages.select("doc_id", "page"), ["doc_id", "page"])
            .groupBy("doc_id", "profile_id").agg(F.sum("_n").alias("rows")))
    zero = F.lit(0.0)
    summed = (pairs.join(rows, ["doc_id", "profile_id"], "left").join(_profile_entries(anchors, profiles), "profile_id")
              .withColumns({"hit": F.coalesce("hit", zero), "seen": F.coalesce("seen", zero), "rows": F.coalesce("rows", F.lit(0))}))
    anchor_score, visual_score = F.coalesce(F.try_divide("hit", "total"), zero), F.coalesce(F.try_divide("seen", "rows"), zero)
    score = (F.when((F.col("rows") == 0) & (F.col("total") == 0), 0.0)
             .when(F.col("rows") == 0, anchor_score).when(F.col("total") == 0, visual_score)
             .otherwise(anchor_score * 0.6 + visual_score * 0.4))
    return summed.select("doc_id", "profile_id", "ord", "threshold", score.alias("score"))


def profile_scores(evidence: DataFrame, anchors: DataFrame, profiles: DataFrame,
                   sampled: DataFrame) -> DataFrame:
    """sparse_scores with the zeros of all other profiles: documents x profiles rows, for small registries and for
    looking at; best profiles come from detect_profiles, which needs no such grid."""
    found = sparse_scores(evidence, anchors, profiles, sampled)
    names = _profile_entries(anchors, profiles).drop("total")
    grid = evidence.select("doc_id").distinct().crossJoin(names)
    return (grid.join(found.select("doc_id", "profile_id", "score"), ["doc_id", "profile_id"], "left")
            .select("doc_id", "profile_id", "ord", "threshold", F.coalesce("score", F.lit(0.0)).alias("score")))


def detect_profiles(evidence: DataFrame, anchors: DataFrame, profiles: DataFrame, sampled: DataFrame,
                    override: str | None = None, default: str | None = None) -> DataFrame:
    """best_profile over the scores of all profiles, from the sparse ones and one more row a document: the profile
    that comes first among equals, with score 0."""
    found = sparse_scores(evidence, anchors, profiles, sampled)
    wanted = F.when(F.col("profile_id") == F.lit(override if override else default), 0).otherwise(1)
    first = (_profile_entries(anchors, profiles).orderBy(wanted, "ord").limit(1)
             .select("profile_id", "ord", "threshold", F.lit(0.0).alias("score")))
    floor = evidence.select("doc_id").distinct().crossJoin(F.broadcast(first))  # one row
    highest = (found.unionByName(floor).groupBy("doc_id", "profile_id", "ord", "threshold").agg(F.max("score").alias("score")))
    return best_profile(highest, override, default)


def best_profile(scores: DataFrame, override: str | None = None, default: str | None = None) -> DataFrame:
    """The first profile with the highest score; the default profile is tried first. With an override that
    no profile has, a document keeps its row, without a profile and with a warning."""
    candidates = scores.where(F.col("profile_id") == override) if override else scores
    first = F.when(F.col("profile_id") == F.lit(default), 0).otherwise(1) if default else F.lit(1)
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), first, "ord")
    best = candidates.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1)
    matched = F.col("score") >= F.col("threshold")
    if override:
        best = scores.select("doc_id").distinct().join(best, "doc_id", "left")
    return best.select("doc_id", F.when(matched, F.col("profile_id")).alias("profile_id"),
                       F.coalesce(matched, F.lit(False)).alias("matched"),
                       F.round("score", 4).alias("score"),
                       F.when(F.col("score").isNull(), F.array(F.lit("profile_override_not_found")))
                       .when(~matched, F.array(F.lit("low_confidence")))
                       .otherwise(F.array().cast("array<string>")).alias("warnings"))


def classify_boilerplate(chunks: DataFrame, patterns: DataFrame, anchors: DataFrame | None = None,
                         token_bounded: bool = False) -> DataFrame:
    """Adds is_boilerplate to chunks(.., profile_id, content, page, bbox). A pattern counts as a
    raw substring of the normalised text; token_bounded=True asks for whole words. A chunk meets
    only the patterns and anchors of its own profile, whatever the size of the registry."""
    pad = " " if token_bounded else ""

    def padded(c: Column) -> Column:
        return F.concat(F.lit(pad), c, F.lit(pad)) if pad else c

    def of_profile(df: DataFrame, name: str, registry: DataFrame, entry: Column) -> DataFrame:
        lists = registry.where(F.col("profile_id").isNotNull()).groupBy("profile_id").agg(F.collect_list(entry).alias(name))
        return df.join(lists, "profile_id", "left")

    out = of_profile(chunks, "_patterns", patterns, F.struct(normalize_match("pattern").alias("norm")))
    if anchors is not None:
        out = of_profile(out, "_anchors", anchors, _anchor_entry())

    def flag(text: Column) -> Column:
        found = F.exists("_patterns", lambda p: (p["norm"] != "") & F.contains(text, padded(p["norm"])))
        if anchors is None:
            return found
        return F.coalesce(found, F.lit(False)) | F.exists("_anchors", lambda a: (
            (a["norm"] != "") & F.contains(text, padded(a["norm"]))
            & (a["page"].isNull() | (a["page"] == F.col("page")))
            & (a["region"].isNull() | (G.overlap_ratio("bbox", a["region"]) >= CHUNK_OVERLAP))))

    # Bound: as a column of its own the text would be normalised again for each pattern, inside exists.
    found = bind(padded(normalize_match("content")), flag)
    return out.select(*chunks.columns, F.coalesce(found, F.lit(False)).alias("is_boilerplate"))


def mine_profile(blocks: DataFrame, top: int = 12, keys: tuple[str, ...] = ()) -> DataFrame:
    """Most repeated blocks as anchors, for the whole corpus or per key. Counting is a partial
    aggregate, so a line copied into a third of the corpus costs one row per task."""
    # Made by a generator, under which no filter is pushed: each line is normalised once, not again for each condition.
    both = F.transform(F.array(collapse_spaces("text")), lambda t: F.struct(
        t.alias("_text"), F.when(F.length(t).between(6, 140), normalize_match(t)).alias("_norm")))
    rows = (blocks.select("*", F.explode_outer(both).alias("_line")).select("*", "_line._text", "_line._norm").drop("_line")
            .where((F.length("_norm") >= 6) & ~F.col("_norm").rlike("^[0-9]+$")))
    place = F.struct("doc_id", "page", "pos")
    grouped = rows.groupBy(*keys, "_norm").agg(
        F.count("*").alias("count"), F.min(place).alias("_at"),
        F.min_by(F.struct(F.col("_text").alias("text"), "page", "box"), place).alias("_first"))
    score = F.col("count") * 2 + F.least(F.length("_first.text") / 50.0, F.lit(1.0))
    best = [F.desc("score"), F.col("_at")]
    scored = grouped.withColumn("score", score)
    if keys:
        picked = scored.withColumn("anchor_no", F.row_number().over(W.partitionBy(*keys).orderBy(*best)))
        picked = picked.where(F.col("anchor_no") <= top)
    else:
        picked = scored.orderBy(*best).limit(top)
        picked = picked.withColumn("anchor_no", F.row_number().over(W.orderBy(*best)))
    return picked.select(
        *keys, "anchor_no", F.col("_first.text").alias("text"), F.col("_norm").alias("pattern"),
        F.col("_first.page").alias("page"), F.col("_first.box").alias("region"), "count", "score",
        F.least(F.lit(1.5), F.lit(0.8) + F.col("count") * 0.2).alias("weight"))


def export_profile(anchors: DataFrame, sampled: DataFrame, profile_id: str, name: str,
                   threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One JSON document from at most a dozen mined anchors and page fingerprints."""
    base = anchors.sparkSession.range(1)
    base = with_registry(base, "_anchors", anchors, F.struct("anchor_no", "text", "page", "region", "weight", "pattern"))
    base = with_registry(base, "_prints", sampled, F.struct("page", F.col("visual_hash").alias("visualHash"),
                                                           F.col("token_hash").alias("tokenHash")))
    body = F.struct(
        F.lit(profile_id).alias("id"), F.lit(1).alias("version"), F.lit(name).alias("name"),
        F.lit(threshold).alias("matchThreshold"),
        F.transform(F.array_sort("_anchors"), lambda a: F.struct(a["text"].alias("text"), a["page"].alias("page"),
                                                             a["region"].alias("region"),
                                                             a["weight"].alias("weight"))).alias("anchors"),
        F.transform(F.array_sort("_anchors"), lambda p: p["pattern"]).alias("boilerplatePatterns"),
        F.array_sort("_prints").alias("sampledPages"))
    return base.select(F.to_json(body).alias("value"))


def ocr_candidates(documents: DataFrame, pages: DataFrame, chunks: DataFrame,
                   cap: int = OCR_PAGE_CAP) -> DataFrame:
    """Short-text pages of PDF documents that gave at most two chunks; first `cap` per document.
    pages(doc_id, page, text)."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("_chunks"))
    needy = (documents.where(F.col("mime") == "application/pdf").select("doc_id").join(counts, "doc_id", "left")
             .where(F.coalesce("_chunks", F.lit(0)) <= OCR_CHUNK_LIMIT).select("doc_id"))
    short = pages.where(F.length(trim_unicode("text")) < OCR_TEXT_LIMIT).select("doc_id", "page")
    order = W.partitionBy("doc_id").orderBy("page")
    return (short.join(needy, "doc_id", "left_semi")
            .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cap).drop("_rn"))


def rescue_with_ocr(pages: DataFrame, ocr_pages: DataFrame, max_tokens: int = MAX_TOKENS,
                    overlap: float = OVERLAP, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Re-chunks pages with OCR text appended. Returns the rescued chunks of the documents that
    gained by it, and (doc_id, chunks_before, chunks_after, applied, warnings)."""
    found = (ocr_pages.select("doc_id", "page", trim_unicode("ocr_text").alias("_ocr")).where(F.col("_ocr") != ""))
    affected = pages.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    merged = (affected.join(found, ["doc_id", "page"], "left")
              .withColumn("text", trim_unicode(F.concat_ws("\n", F.nullif("text", F.lit("")), "_ocr"))))

    def sized(source: DataFrame) -> DataFrame:
        parts = split_long(segments(document_lines(source)), max_tokens, overlap)
        return parts.withColumn("token_count", estimate_tokens("text"))
    per_doc = W.partitionBy("doc_id")
    regular = F.count_if(F.col("token_count") >= min_tokens).over(per_doc)
    kept = (sized(merged).withColumn("_regular", regular)
            .where((F.col("token_count") >= min_tokens) | ((F.col("_regular") == 0) & (F.col("token_count") >= 1)))
            .withColumn("chunk_index", F.row_number().over(per_doc.orderBy("seg_no", "part_no")) - 1))
    before = (sized(affected).where(F.col("token_count") >= min_tokens)
              .groupBy("doc_id").agg(F.count("*").alias("chunks_before")))
    after = kept.groupBy("doc_id").agg(F.count("*").alias("chunks_after"),
                                       F.max(F.col("_regular") == 0).alias("_fallback"))
    joined = (found.select("doc_id").distinct().join(before, "doc_id", "left").join(after, "doc_id", "left")
              .select("doc_id", F.coalesce("chunks_before", F.lit(0)).alias("chunks_before"),
                      F.coalesce("chunks_after", F.lit(0)).alias("chunks_after"),
                      F.coalesce("_fallback", F.lit(False)).alias("_fallback"))
              .withColumn("applied", F.col("chunks_after") > F.col("chunks_before")))
    warnings = F.filter(F.array(F.when(F.col("_fallback"), "ocr_rescue_short_text_fallback_chunk"),
                                F.when(~F.col("applied"), "ocr_rescue_no_chunk_gain")), lambda w: w.isNotNull())
    summary = joined.select("doc_id", "chunks_before", "chunks_after", "applied", warnings.alias("warnings"))
    chunks = (kept.join(summary.where("applied").select("doc_id"), "doc_id", "left_semi")
              .select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "page",
                      F.col("header_path").alias("parent_header"), F.col("text").alias("content"), "token_count",
                      F.sha2("text", 256).alias("content_hash")))
    return chunks, summary


def ingest_rates(documents: DataFrame, key: str = "ocr_engine") -> DataFrame:
    """Usage, fallback and success rates per engine, and the template match rate."""
    def rate(c: str) -> Column:
        return F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return documents.groupBy(key).agg(
        F.count("*").alias("documents"), rate("ocr_fallback").alias("fallback_rate"),
        rate("ocr_applied").alias("success_rate"), rate("template_matched").alias("template_match_rate"))
