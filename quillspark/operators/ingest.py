"""Document admission, dedupe, status, statistics, backfill and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import estimate_tokens, trim_unicode
from ..functions import geometry as G

MAX_FILE_SIZE = 50 * 1024 * 1024
ALLOWED_TYPES = ("application/pdf", "text/plain")
EMPTY_TEXT_ERROR = "No indexable text extracted from document (OCR produced no usable text)."
ACCESS_LEVELS = ("public", "private", "team")
OCR_ENGINES = ("gemini", "tesseract")
OPTIONS = ("accessLevel string, skipEmbedding boolean, templateProfileId string, emptyChunkOcrEnabled boolean, "
           "emptyChunkOcrEngine string, folderName string, _bad string")


def admit(files: DataFrame, max_bytes: int = MAX_FILE_SIZE, types: tuple[str, ...] = ALLOWED_TYPES) -> DataFrame:
    """Adds reject_code, NULL for admitted files(name, mime, size)."""
    return files.withColumn("reject_code", F.when(F.col("size") > max_bytes, "INGEST_FILE_TOO_LARGE")
                            .when(~F.coalesce(F.col("mime").isin(*types), F.lit(False)), "INGEST_UNSUPPORTED_TYPE"))


def split_admitted(files: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    checked = admit(files, **limits)
    return checked.where(F.col("reject_code").isNull()), checked.where(F.col("reject_code").isNotNull())


def coerce_options(rows: DataFrame, json_col: str) -> DataFrame:
    """Typed ingest options; a row that does not validate falls back to the defaults whole."""
    o = F.from_json(F.col(json_col), OPTIONS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    access, engine = F.col("_o.accessLevel"), F.col("_o.emptyChunkOcrEngine")
    profile, folder = trim_unicode("_o.templateProfileId"), trim_unicode("_o.folderName")
    valid = (F.col("_o").isNotNull() & F.col("_o._bad").isNull()
             & F.coalesce(access.isin(*ACCESS_LEVELS), F.lit(True))
             & F.coalesce(engine.isin(*OCR_ENGINES), F.lit(True))
             & F.coalesce(F.length(profile).between(1, 128), F.lit(True)))
    return (rows.withColumn("_o", o).withColumn("_valid", F.coalesce(valid, F.lit(False)))
            .select(*rows.columns,
                    F.when(F.col("_valid"), F.coalesce(access, F.lit("private"))).otherwise("private").alias("access"),
                    F.coalesce(F.col("_valid") & F.col("_o.skipEmbedding"), F.lit(False)).alias("skip_embedding"),
                    F.when(F.col("_valid"), profile).alias("profile_id"),
                    F.when(F.col("_valid"), F.col("_o.emptyChunkOcrEnabled")).alias("ocr_enabled"),
                    F.when(F.col("_valid"), F.coalesce(engine, F.lit("gemini"))).otherwise("gemini").alias("ocr_engine"),
                    F.when(F.col("_valid") & F.length(folder).between(1, 128), folder).alias("folder")))


def file_hash(content: Column | str) -> Column:
    """SHA-256 of the base64 text of the bytes, without the line breaks base64() puts in."""
    return F.sha2(F.replace(F.base64(content), F.lit("\r\n")), 256)


def dedupe_documents(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """new(doc_id, user_id, file_hash) -> doc_id, canonical_doc_id, is_duplicate. An existing document
    of the same user and hash wins, else the smallest new id. The minimum is a partial aggregate;
    AQE splits the join if one hash is hot."""
    keys = ["user_id", "file_hash"]
    first = new.groupBy(*keys).agg(F.min("doc_id").alias("_new"))
    if existing is None:
        known = first.withColumn("canonical_doc_id", F.col("_new"))
    else:
        old = existing.groupBy(*keys).agg(F.min("doc_id").alias("_old"))
        known = first.join(old, keys, "left").withColumn("canonical_doc_id", F.coalesce("_old", "_new"))
    return (new.join(known.select(*keys, "canonical_doc_id"), keys)
            .select("doc_id", "user_id", "canonical_doc_id",
                    (F.col("doc_id") != F.col("canonical_doc_id")).alias("is_duplicate")))


def finalize_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """completed with at least one indexable chunk, else failed with a reason."""
    usable = (chunks.where(~F.coalesce("is_boilerplate", F.lit(False))).groupBy("doc_id")
              .agg(F.count("*").alias("_usable")))
    done = F.coalesce("_usable", F.lit(0)) > 0
    return (documents.drop("status", "error").join(usable, "doc_id", "left")
            .withColumn("status", F.when(done, "completed").otherwise("failed"))
            .withColumn("error", F.when(~done, EMPTY_TEXT_ERROR)).drop("_usable"))


def ingest_stats(documents: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages, blocks, chunks, tokens and indexable/boilerplate counts per document."""
    b = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("blocks"))
    c = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"),
        F.count_if(F.coalesce("is_boilerplate", F.lit(False))).alias("boilerplate"))
    zero = F.lit(0)
    return (documents.select("doc_id").join(b, "doc_id", "left").join(c, "doc_id", "left")
            .select("doc_id", *[F.coalesce(n, zero).cast("bigint").alias(n) for n in ("pages", "blocks", "chunks", "tokens")],
                    F.coalesce(F.col("chunks") - F.col("boilerplate"), zero).cast("bigint").alias("indexable"),
                    F.coalesce("boilerplate", zero).cast("bigint").alias("boilerplate")))


def backfill_documents(documents: DataFrame) -> DataFrame:
    return documents.withColumn("original_filename", F.coalesce("original_filename", "filename"))


def backfill_chunks(chunks: DataFrame) -> DataFrame:
    """Missing highlight boxes become the chunk's own box, or an empty list."""
    own = F.when(F.col("bbox").isNull(), F.array().cast(f"array<{G.BOX}>")).otherwise(F.array("bbox"))
    return chunks.withColumn("boxes", F.coalesce("boxes", own))


def schema_preflight(spark, tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """table, column, ok. Reads schemas only."""
    rows = [(t, c, t in tables and c in tables[t].columns) for t, cols in sorted(required.items()) for c in cols]
    return spark.createDataFrame(rows, "table string, column string, ok boolean")


def token_totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.sum(estimate_tokens("content")).alias("tokens"))
