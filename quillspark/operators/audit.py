"""Corpus health and request analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as G
from ..functions.parsing import classify_error
from ..functions.vectors import is_zero


def embedding_health(chunks: DataFrame) -> DataFrame:
    null, zero = F.col("emb").isNull(), F.coalesce(is_zero("emb"), F.lit(False))
    return chunks.agg(F.count("*").alias("total"), F.count_if(~null & ~zero).alias("valid"),
                      F.count_if(zero).alias("zero"), F.count_if(null).alias("null"))


def dimension_audit(chunks: DataFrame, dim: int) -> DataFrame:
    size = F.when(F.col("emb").isNotNull(), F.size("emb"))
    return (chunks.groupBy(size.alias("dimension")).agg(F.count("*").alias("chunks"))
            .withColumn("verdict", F.when(F.col("dimension").isNull(), "missing")
                        .when(F.col("dimension") == dim, "ok").otherwise("wrong")))


def keyword_coverage(documents: DataFrame, chunks: DataFrame, words: list[str], sample: int = 100) -> DataFrame:
    """Chunks per document, how many contain any of the words, and the first such chunk."""
    text = F.lower("content")
    hit = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w))
    short = F.concat(F.regexp_replace(F.substring("content", 1, sample), "\n", " "), F.lit("..."))
    per_doc = (chunks.select("doc_id", "chunk_index", hit.alias("_hit"), short.alias("_short"))
               .groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("_hit").alias("matching"),
                                      F.min_by("_short", F.when(F.col("_hit"), F.col("chunk_index"))).alias("sample")))
    return (documents.select("doc_id").join(per_doc, "doc_id", "left")
            .select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"),
                    F.coalesce("matching", F.lit(0)).alias("matching"), "sample"))


def box_audit(chunks: DataFrame) -> DataFrame:
    """chunks(chunk_id, bbox, boxes) with either one present."""
    boxes = F.coalesce("boxes", F.array().cast(f"array<{G.BOX}>"))
    return (chunks.where(F.col("bbox").isNotNull() | F.col("boxes").isNotNull()).withColumn("_b", boxes)
            .select("chunk_id", F.size("_b").alias("boxes"), G.total_area("_b").alias("total_area"),
                    G.envelope("_b").alias("envelope"), G.is_coarse_audit("bbox", "_b").alias("coarse")))


def corpus_digest(documents: DataFrame, chunks: DataFrame, length: int = 50) -> DataFrame:
    per_doc = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"),
        F.min_by(F.substring("content", 1, length), "chunk_index").alias("first_chunk"))
    return (documents.select("doc_id", "filename", "status").join(per_doc, "doc_id", "left")
            .select("doc_id", "filename", "status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
                    F.col("chunk_count").isNotNull().alias("has_chunks"), "first_chunk"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float, bucket_width: float = 1.0) -> DataFrame:
    """Exact nearest-rank percentile per key. Bucket totals tell which bucket holds the rank; only
    that bucket's values are sorted, equal values counted first, so no key is sorted whole."""
    bucket = F.floor(F.col(value) / bucket_width)
    sizes = df.groupBy(*keys, bucket.alias("_b")).agg(F.count("*").alias("_size"))
    upto = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    need = F.greatest(F.ceil(F.lit(p) * F.sum("_size").over(W.partitionBy(*keys))), F.lit(1))
    target = (sizes.withColumn("_cum", F.sum("_size").over(upto)).withColumn("_need", need)
              .where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_size") < F.col("_need")))
              .select(*keys, "_b", (F.col("_need") - F.col("_cum") + F.col("_size")).alias("_k")))
    inside = (df.select(*keys, value, bucket.alias("_b")).join(target, [*keys, "_b"])
              .groupBy(*keys, "_k", value).agg(F.count("*").alias("_n")))
    order = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (inside.withColumn("_cum", F.sum("_n").over(order)).where(F.col("_cum") >= F.col("_k"))
            .groupBy(*keys).agg(F.min(value).alias("percentile")))


def latency_summary(requests: DataFrame, keys: list[str], p: float = 0.95, max_error_rate: float = 0.01,
                    max_degraded_rate: float = 0.1, max_latency: float = 8000.0,
                    bucket_width: float = 1.0) -> DataFrame:
    """requests(keys, success, degraded, duration): rates, percentile and verdict per key."""
    totals = requests.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if("success").alias("success"),
        F.count_if(F.col("success") & F.col("degraded")).alias("degraded"))
    n = F.col("requests")
    errors = 1 - F.col("success") / n
    joined = totals.join(nearest_rank(requests, keys, "duration", p, bucket_width), keys)
    passed = ((errors <= max_error_rate) & (F.col("degraded") / n <= max_degraded_rate)
              & (F.col("percentile") <= max_latency))
    return joined.select(*keys, "requests", "success", "degraded", F.round(F.col("success") / n, 4).alias("success_rate"),
                         F.round(F.col("degraded") / n, 4).alias("degraded_rate"),
                         F.round(errors, 4).alias("error_rate"), "percentile", passed.alias("passed"))


#: Size of a latency sketch, and the rank error that it keeps, within a share of all requests, with 99 % certainty.
SKETCH_SIZE, SKETCH_ERROR = 800, 0.01


def hourly_sketches(requests: DataFrame, keys: list[str], ts: str, value: str = "duration", size: int = SKETCH_SIZE) -> DataFrame:
    """keys, hour, n and a quantile sketch of a few kilobytes for each hour: what is kept of a request log, next to which
    any range of hours can be summed up without it. Null values and times count nowhere."""
    rows = requests.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    return rows.groupBy(*keys, F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_percentile(sketches: DataFrame, keys: list[str], p: float = 0.95) -> DataFrame:
    """keys, hours, requests, percentile and the merged sketch over the given hours, by way of days, so that no task
    takes all hours of a key. The rank of the percentile is p within SKETCH_ERROR; latency_summary is exact."""
    days = sketches.groupBy(*keys, F.date_trunc("day", F.col("hour")).alias("_day")).agg(
        F.count("*").alias("hours"), F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    whole = days.groupBy(*keys).agg(F.sum("hours").alias("hours"), F.sum("n").alias("requests"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.withColumn("percentile", F.kll_sketch_get_quantile_double("sketch", F.lit(p)))


def status_histogram(requests: DataFrame, status: str = "status") -> DataFrame:
    return requests.groupBy(status).agg(F.count("*").alias("requests"))


def error_breakdown(requests: DataFrame, message: str = "message") -> DataFrame:
    return (requests.withColumn("_c", classify_error(message))
            .groupBy(F.col("_c.code").alias("code"), F.col("_c.stage").alias("stage"),
                     F.col("_c.retryable").alias("retryable")).agg(F.count("*").alias("errors")))


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("documents"))


def stuck_documents(documents: DataFrame, stuck: str = "processing") -> DataFrame:
    return (documents.where(F.col("status") == stuck).select("doc_id", "status", "created_at")
            .orderBy(F.desc("created_at"), "doc_id"))
