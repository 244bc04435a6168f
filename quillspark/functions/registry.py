"""SQL names for the row-local functions, for callers that write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import split_text


@udtf(returnType="part_no int, part string")
class SplitLongText:
    def eval(self, text: str, max_tokens: int, overlap: float):
        if text is not None:
            yield from enumerate(split_text(text, max_tokens, float(overlap)))


SQL_FUNCTIONS = {
    "estimate_tokens": "(s STRING) RETURNS INT RETURN CAST(ceil(size(array_remove(split(s, '(?U)\\\\s+'), '')) * 1.5) AS INT)",
    "query_hash": "(s STRING) RETURNS STRING RETURN "
                  "sha2(regexp_replace(regexp_replace(lower(s), '(?U)^\\\\s+|\\\\s+$', ''), '(?U)\\\\s+', ' '), 256)",
    "match_terms": "(s STRING) RETURNS ARRAY<STRING> RETURN array_remove(split(lower(s), '[^\\\\p{L}\\\\p{N}]+'), '')",
}


def register_functions(spark: SparkSession) -> None:
    """estimate_tokens, query_hash and match_terms stay JVM-side; split_long_text is a table function."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("split_long_text", SplitLongText)


# Expressions of the table functions below: terms, trigrams and cosine similarity as in functions.terms and vectors.
_TERMS = "array_remove(split(lower({0}), '[^\\\\p{{L}}\\\\p{{N}}]+'), '')"
_GRAMS = (f"array_distinct(flatten(transform({_TERMS}, w -> transform(sequence(1, length(w) + 1), "
          "i -> substring(concat('  ', w, ' '), i, 3)))))")
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"
_COSINE = (f"CASE WHEN size({{0}}) = size({{1}}) THEN try_divide({_DOT}, "
           "sqrt(aggregate({0}, 0D, (s, v) -> s + double(v) * double(v))) * sqrt(aggregate({1}, 0D, (s, v) -> s + double(v) * double(v)))) END")


def register_search_functions(spark: SparkSession, chunks: DataFrame, cache: DataFrame) -> None:
    """hybrid_search and find_cached_response as SQL table functions, each for one query. They scan the given tables, with
    a top k of bounded size; for tables of queries use hybrid_search_weighted and lookup_semantic.

    chunks(chunk_id, doc_id, content, emb, access, ..), cache(id, answer, emb, expires_at)."""
    chunks.createOrReplaceTempView("quill_search_chunks")
    cache.createOrReplaceTempView("quill_answer_cache")
    terms, wanted = _TERMS.format("c.content"), f"array_distinct({_TERMS.format('query_text')})"
    raw = (f"CASE WHEN size({wanted}) > 0 AND size(array_except({wanted}, {terms})) = 0 THEN aggregate(transform({wanted}, "
           f"w -> ln(1 + size(filter({terms}, x -> x = w)))), 0D, (s, v) -> s + v) / (1 + ln(size({terms}))) ELSE 0D END")
    mine, theirs = _GRAMS.format("c.content"), _GRAMS.format("query_text")
    alike = f"coalesce(try_divide(double(size(array_intersect({mine}, {theirs}))), size(array_union({mine}, {theirs}))), 0D)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION hybrid_search(
        query_embedding ARRAY<DOUBLE>, query_text STRING, match_threshold DOUBLE DEFAULT 0.85, access_level STRING DEFAULT 'public')
      RETURNS TABLE (chunk_id BIGINT, doc_id BIGINT, content STRING, similarity DOUBLE, fts_rank DOUBLE, trgm_score DOUBLE, score DOUBLE)
      RETURN SELECT chunk_id, doc_id, content, similarity, raw / (1 + raw), trgm_score,
                    similarity * 0.6 + raw / (1 + raw) * 0.25 + trgm_score * 0.15 AS score
             FROM (SELECT c.chunk_id, c.doc_id, c.content, coalesce({_COSINE.format('c.emb', 'query_embedding')}, 0D) AS similarity,
                          {raw} AS raw, {alike} AS trgm_score FROM quill_search_chunks c WHERE c.access = access_level)
             WHERE similarity > match_threshold OR trgm_score > 0.3""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION find_cached_response(
        query_embedding ARRAY<DOUBLE>, as_of TIMESTAMP, similarity_threshold DOUBLE DEFAULT 0.95)
      RETURNS TABLE (id STRING, answer STRING, similarity DOUBLE)
      RETURN SELECT id, answer, similarity FROM (SELECT id, answer, {_COSINE.format('emb', 'query_embedding')} AS similarity
                                                 FROM quill_answer_cache WHERE expires_at > as_of)
             WHERE similarity > similarity_threshold ORDER BY similarity DESC, id LIMIT 1""")
