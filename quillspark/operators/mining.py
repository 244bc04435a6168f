"""Terminology candidates mined from documents(doc_id, text)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_term, trim_unicode

# Phrasings that introduce a term (one per pattern), case-insensitive.
TERM_PATTERNS = [
    r'(?iu)(?:říkáme tomu|interně tomu říkáme)\s+["“]?([^"\n”]{2,80})["”]?',
    r"(?i)(?:aka|a\.k\.a\.|=)\s+([A-Za-z0-9_\- :]{2,80})",
]
PATTERN_CONFIDENCE, CONTEXT_LIMIT = 0.65, 500
MIN_COUNT, CAP, MIN_WORD, MAX_WORD = 3, 100, 3, 30
#: Texts counted at once.
_TEXTS = 256


def mine_patterns(docs: DataFrame) -> DataFrame:
    """The first match of each pattern on each line."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n"))
                        .alias("_line_no", "_line"))
    found = F.array(*[F.struct(F.lit(n).alias("n"), trim_unicode(F.regexp_extract("_line", p, 1)).alias("term"))
                      for n, p in enumerate(TERM_PATTERNS)])
    hits = (lines.where(F.col("_line").rlike(TERM_PATTERNS[0]) | F.col("_line").rlike(TERM_PATTERNS[1]))
            .select("doc_id", "_line_no", "_line", F.explode(found).alias("m")).where(F.col("m.term") != "")
            .withColumn("term_normalized", normalize_term("m.term")).where(F.col("term_normalized") != ""))
    return hits.select(
        "doc_id", F.col("m.term").alias("term_original"), "term_normalized",
        F.substring(trim_unicode("_line"), 1, CONTEXT_LIMIT).alias("context"),
        F.lit(PATTERN_CONFIDENCE).alias("confidence"), F.lit(1).cast("bigint").alias("occurrences"),
        F.struct(F.lit(0).alias("kind"), F.col("_line_no").alias("at"), F.col("m.n").alias("sub")).alias("ord"))


def _first_grams(text: str, min_count: int, cap: int) -> list[tuple[int, str, int]]:
    """(place of first use, term, uses) of the words and word pairs used at least min_count times, the first `cap`."""
    words = [w for w in text.split(" ") if MIN_WORD <= len(w) <= MAX_WORD]
    found = []
    for pair, grams in enumerate((words, list(zip(words, words[1:])))):
        often = [(g, n) for g, n in Counter(grams).items() if n >= min_count]
        if often:
            first = dict(zip(reversed(grams), range(len(grams) - 1, -1, -1)))
            found += [(2 * first[g] + pair, " ".join(g) if pair else g, n) for g, n in often]
    return sorted(found)[:cap]


def mine_ngrams(docs: DataFrame, min_count: int = MIN_COUNT, cap: int = CAP) -> DataFrame:
    """Words and word pairs used at least min_count times in a document; the first `cap` of them
    in order of first use; a row is a document. All is counted inside the row, so nothing is exchanged."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                grams = [(i, *g) for i, text in enumerate(part.column(1).to_pylist()) if text
                         for g in _first_grams(text, min_count, cap)]
                rows, places, terms, uses = zip(*grams) if grams else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(places, pa.int32()), pa.array(terms, pa.string()),
                     pa.array(uses, pa.int64())], names=["doc_id", "at", "term", "n"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", normalize_term("text").alias("text"))
            .mapInArrow(count, f"doc_id {id_type}, at int, term string, n bigint")
            .select("doc_id", F.col("term").alias("term_original"), F.col("term").alias("term_normalized"),
                    F.lit("").alias("context"),
                    F.least(F.lit(0.6), F.lit(0.2) + F.col("n") * F.lit(0.05)).alias("confidence"),
                    F.col("n").alias("occurrences"),
                    F.struct(F.lit(1).alias("kind"), F.col("at"), F.lit(0).alias("sub")).alias("ord")))


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """One row per (document, term): best confidence, first non-empty context, first spelling."""
    first_context = F.min_by("context", F.when(F.col("context") != "", F.col("ord")))
    return (candidates.groupBy("doc_id", "term_normalized")
            .agg(F.min_by("term_original", "ord").alias("term_original"),
                 F.max("confidence").alias("confidence"),
                 F.coalesce(first_context, F.lit("")).alias("context"),
                 F.sum("occurrences").alias("occurrences"), F.min("ord").alias("ord")))


def mine_candidates(docs: DataFrame) -> DataFrame:
    return dedupe_candidates(mine_patterns(docs).unionByName(mine_ngrams(docs)))


def upsert_candidates(existing: DataFrame, new: DataFrame, as_of: Column, source_type: str = "document") -> DataFrame:
    """New snapshot of term candidates keyed by (term, document), NULL documents included. A repeat
    raises frequency (ingests, not occurrences) by one and sets confidence to max(new, 0.3)."""
    n = new.select("doc_id", "term_normalized", "term_original", "context", "confidence", "occurrences").alias("n")
    e = existing.alias("e")
    same = (F.col("e.term_normalized") == F.col("n.term_normalized")) & F.col("e.document_id").eqNullSafe(F.col("n.doc_id"))
    both = F.col("e.id").isNotNull() & F.col("n.term_normalized").isNotNull()
    contexts = F.when(F.col("n.context") != "", F.array("n.context")).otherwise(F.array().cast("array<string>"))
    new_id = F.sha2(F.concat_ws("|", F.col("n.term_normalized"), F.coalesce(F.col("n.doc_id").cast("string"), F.lit(""))), 256)
    return e.join(n, same, "full").select(
        F.coalesce("e.id", new_id).alias("id"),
        F.coalesce("e.term_original", "n.term_original").alias("term_original"),
        F.coalesce("e.term_normalized", "n.term_normalized").alias("term_normalized"),
        F.when(F.col("e.id").isNotNull(), F.col("e.document_id")).otherwise(F.col("n.doc_id")).alias("document_id"),
        F.coalesce("e.contexts", contexts).alias("contexts"),
        F.when(both, F.coalesce("e.frequency", F.lit(0)) + 1).otherwise(F.coalesce("e.frequency", F.lit(1)))
        .cast("int").alias("frequency"),
        F.coalesce("n.occurrences", "e.occurrences").alias("occurrences"),
        F.coalesce("e.source_type", F.lit(source_type)).alias("source_type"),
        F.when(both, F.greatest("n.confidence", F.lit(0.3))).otherwise(F.coalesce("e.confidence", "n.confidence"))
        .alias("confidence"),
        F.coalesce("e.status", F.lit("pending")).alias("status"),
        F.coalesce("e.detected_at", as_of).alias("detected_at"),
        F.when(F.col("n.term_normalized").isNotNull(), as_of).otherwise(F.col("e.updated_at")).alias("updated_at"))


EMPTY_CANDIDATES = ("id string, term_original string, term_normalized string, document_id {id}, contexts array<string>, "
                    "frequency int, occurrences bigint, source_type string, confidence double, status string, "
                    "detected_at timestamp, updated_at timestamp")
