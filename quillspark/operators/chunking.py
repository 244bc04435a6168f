"""Header-aware chunking: pages -> lines -> segments -> chunks.

Lines of one document are ordered by (page, position). All windows and the segment
aggregate cluster on doc_id, so the whole chain costs one exchange; one document is
bounded by the admission limit (50 MiB), whatever the corpus size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import detect_header, estimate_tokens, trim_unicode

MAX_TOKENS, OVERLAP, MIN_TOKENS = 1200, 0.15, 50
TOKENS_PER_WORD = 1.5
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def document_lines(pages: DataFrame) -> DataFrame:
    """Non-blank lines of pages(doc_id, page, text), numbered within their document.
    The page ordinal of a non-blank line is the page it came from, so no offsets are kept."""
    lines = (pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .where(trim_unicode("line") != ""))
    order = W.partitionBy("doc_id").orderBy("page", "pos")
    return lines.select("doc_id", F.row_number().over(order).alias("line_no"), "page", "line")


def header_paths(lines: DataFrame) -> DataFrame:
    """Adds level and header_path. A header of level k is live as long as no header of a
    level <= k came later, which needs only the last position per level."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("header", detect_header("line"))
    last = [F.last(F.when(F.col("header.level") == k, F.struct("line_no", F.col("header.text").alias("text"))),
                   ignorenulls=True).over(upto).alias(f"_h{k}") for k in range(1, 7)]
    tracked = marked.select("*", *last)
    parts = []
    for k in range(1, 7):
        alive = F.col(f"_h{k}").isNotNull()
        for upper in range(1, k):
            alive = alive & F.coalesce(F.col(f"_h{k}.line_no") > F.col(f"_h{upper}.line_no"), F.lit(True))
        parts.append(F.when(alive, F.concat(F.lit("#" * k + " "), F.col(f"_h{k}.text"))))
    return tracked.select("doc_id", "line_no", "page", "line", F.col("header.level").alias("level"),
                          F.concat_ws(" > ", *parts).alias("header_path"))


def segments(lines: DataFrame) -> DataFrame:
    """One row per run of lines without a header or page change in between."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    starts = (F.col("level").isNotNull()
              | F.coalesce(F.col("page") != F.lag("page").over(order), F.lit(True)))
    numbered = header_paths(lines).withColumn("_start", starts.cast("int")).withColumn(
        "seg_no", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return (numbered.groupBy("doc_id", "seg_no")
            .agg(F.min("page").alias("page"), F.max("header_path").alias("header_path"),
                 trim_unicode(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")).alias("text")))


def _tokens(words: int) -> int:
    return math.ceil(words * TOKENS_PER_WORD)


class _Packer:
    """Greedy packing of pieces with a word overlap carried into the next part."""

    def __init__(self, max_tokens: int, carry: int) -> None:
        self.max_tokens, self.carry = max_tokens, carry
        self.parts: list[str] = []
        self.text, self.tokens = "", 0

    def flush(self) -> None:
        if self.text.strip():
            self.parts.append(self.text.strip())

    def reset(self) -> None:
        self.text, self.tokens = "", 0

    def add(self, piece: str, cost: int, glue: str) -> None:
        if self.tokens + cost > self.max_tokens and self.text.strip():
            self.flush()
            kept = _SPACE.split(self.text)[-self.carry:] if self.carry else []
            self.text = " ".join(kept) + glue + piece if kept else piece
            self.tokens = _tokens(len(self.text.split()))
        else:
            self.text = self.text + glue + piece if self.text else piece
            self.tokens += cost


def split_text(text: str, max_tokens: int, overlap: float) -> list[str]:
    """Lines first; a line over the limit by sentences; a sentence over the limit by words."""
    packer = _Packer(max_tokens, int(math.floor(max_tokens * overlap) / TOKENS_PER_WORD))
    for line in text.split("\n"):
        if not line.strip():
            continue
        cost = _tokens(len(line.split()))
        if cost <= max_tokens:
            packer.add(line, cost, "\n\n")
            continue
        packer.flush()
        packer.reset()
        for sentence in _SENTENCE.split(line):
            cost = _tokens(len(sentence.split()))
            if cost <= max_tokens:
                packer.add(sentence, cost, " ")
                continue
            packer.flush()
            packer.reset()
            for word in _SPACE.split(sentence):
                packer.add(word, _tokens(len(word.split())), " ")
    packer.flush()
    return packer.parts


def _splitter(max_tokens: int, overlap: float):
    # Only a few texts at a time are Python objects, and their parts are packed at once.
    @F.arrow_udf(ArrayType(StringType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for texts in batches:
            parts = [pa.array([None if t is None else split_text(t, max_tokens, overlap) for t in texts.slice(at, 64).to_pylist()], kind)
                     for at in range(0, len(texts), 64)]
            yield pa.concat_arrays([pa.array([], kind), *parts])
    return split


def split_long(segs: DataFrame, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """Segments over max_tokens become several parts. Short ones cross the Arrow boundary as NULL."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    long_text: Column = F.when(estimate_tokens("text") > max_tokens, F.col("text"))
    parts = F.coalesce(_splitter(max_tokens, overlap)(long_text), F.array("text"))
    return (segs.withColumn("_parts", parts)
            .select("doc_id", "seg_no", "page", "header_path", F.posexplode("_parts").alias("part_no", "text")))


def emit_chunks(parts: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Drops parts under min_tokens; chunk_index counts what is left."""
    order = W.partitionBy("doc_id").orderBy("seg_no", "part_no")
    return (parts.withColumn("token_count", estimate_tokens("text"))
            .where(F.col("token_count") >= min_tokens)
            .withColumn("chunk_index", F.row_number().over(order) - 1)
            .select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "page",
                    F.col("header_path").alias("parent_header"), F.col("text").alias("content"),
                    "token_count", F.sha2("text", 256).alias("content_hash")))


def chunk_documents(pages: DataFrame, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP,
                    min_tokens: int = MIN_TOKENS) -> DataFrame:
    segs = segments(document_lines(pages))
    return emit_chunks(split_long(segs, max_tokens, overlap), min_tokens)


def chunk_drop_stats(pages: DataFrame, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP,
                     min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Parts kept and silently dropped for being under min_tokens, per document."""
    parts = split_long(segments(document_lines(pages)), max_tokens, overlap)
    short = estimate_tokens("text") < min_tokens
    return parts.groupBy("doc_id").agg(F.count_if(~short).alias("kept"), F.count_if(short).alias("dropped"))
