"""Semantic answer cache: exact hash or near vector, with expiry. as_of is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .similarity import vector_topk

SIMILARITY_FLOOR, MIN_CONFIDENCE, TTL_SECONDS = 0.95, 0.85, 24 * 3600


def _fresh(cache: DataFrame, as_of: Column) -> DataFrame:
    """An entry that expires exactly at as_of is already gone."""
    return cache.where(F.col("expires_at") > as_of)


def lookup_exact(queries: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """queries(qid, hash): the entry of the same hash (unique in the cache)."""
    entries = _fresh(cache, as_of).select("hash", F.col("id").alias("cache_id"))
    return queries.select("qid", "hash").join(entries, "hash").select("qid", "cache_id")


def lookup_semantic(queries: DataFrame, cache: DataFrame, as_of: Column,
                    floor: float = SIMILARITY_FLOOR, strict: bool = False) -> DataFrame:
    """queries(qid, hash, emb): the nearest fresh entry if similar enough. Equal queries share a
    hash and are searched once, and so are equal vectors; of entries with equal vectors the smallest id counts.
    Both sides are written once, as the search reads them several times. strict asks for more than the floor, as
    the SQL function does."""
    queries = materialize(queries.select("qid", "hash", "emb"))
    once = materialize(queries.groupBy("hash").agg(F.min_by("emb", "qid").alias("emb")))
    asked = materialize(once.where(F.col("emb").isNotNull()).groupBy("emb").agg(F.min("hash").alias("qid")))
    entries = materialize(_fresh(cache, as_of).groupBy("emb").agg(F.min("id").alias("chunk_id")))
    found = materialize(vector_topk(asked, entries, 1, floor=floor, strict=strict).select("qid", "chunk_id", "vector_score"))
    best = (once.join(asked, "emb").join(found, "qid")
            .select("hash", F.col("chunk_id").alias("cache_id"), F.col("vector_score").alias("similarity")))
    return queries.select("qid", "hash").join(best, "hash").select("qid", "cache_id", "similarity")


def resolve_cache(queries: DataFrame, cache: DataFrame, as_of: Column,
                  floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """qid, hit_kind (exact, semantic, miss), cache_id, similarity. Only queries without an exact
    hit reach the vector search. Queries and cache are written once."""
    queries = materialize(queries.select("qid", "hash", "emb"))
    cache = materialize(cache.select("id", "hash", "emb", "expires_at"))
    exact = lookup_exact(queries, cache, as_of)
    rest = queries.join(exact.select("qid"), "qid", "left_anti")
    near = lookup_semantic(rest, cache, as_of, floor)
    found = (exact.select("qid", F.lit("exact").alias("hit_kind"), "cache_id", F.lit(1.0).alias("similarity"))
             .unionByName(near.select("qid", F.lit("semantic").alias("hit_kind"), "cache_id", "similarity")))
    return (queries.select("qid").join(found, "qid", "left")
            .select("qid", F.coalesce("hit_kind", F.lit("miss")).alias("hit_kind"), "cache_id", "similarity"))


def upsert_cache(cache: DataFrame, entries: DataFrame, as_of: Column, min_confidence: float = MIN_CONFIDENCE,
                 ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """New snapshot. entries(hash, text, emb, answer, confidence, verified, seq): verified and
    confident answers replace answer, vector and expiry of their hash; hit count, creation time
    and query text of an existing entry stay. The latest of several entries (seq) wins."""
    good = entries.where(F.col("verified") & (F.col("confidence") >= min_confidence))
    latest = good.groupBy("hash").agg(F.max_by(F.struct("text", "emb", "answer", "confidence"), "seq").alias("n"),
                                      F.min_by("text", "seq").alias("first_text"))
    o, fresh = cache.alias("o"), F.col("n").isNotNull()
    expires = F.timestamp_add("SECOND", F.lit(ttl_seconds), as_of)

    def pick(new: Column, old: str) -> Column:
        return F.when(fresh, new).otherwise(F.col(old))
    return (o.join(latest, "hash", "full")
            .select(F.coalesce("o.id", F.sha2(F.col("hash"), 256)).alias("id"), "hash",
                    F.coalesce("o.text", "first_text").alias("text"),
                    pick(F.col("n.emb"), "o.emb").alias("emb"), pick(F.col("n.answer"), "o.answer").alias("answer"),
                    pick(F.col("n.confidence"), "o.confidence").alias("confidence"),
                    F.coalesce("o.hit_count", F.lit(0)).alias("hit_count"),
                    F.coalesce("o.created_at", as_of).alias("created_at"),
                    pick(expires, "o.expires_at").alias("expires_at")))


def add_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """hits(cache_id): one increment per row, counted before the join."""
    counts = hits.where(F.col("cache_id").isNotNull()).groupBy(F.col("cache_id").alias("id")).agg(
        F.count("*").alias("_n"))
    return (cache.join(counts, "id", "left")
            .withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).drop("_n")
            .select(*cache.columns))


def purge(cache: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, number removed). An entry that expires exactly at as_of stays."""
    expired = F.col("expires_at") < as_of
    return cache.where(~expired), cache.agg(F.count_if(expired).alias("removed"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"),
                     F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
