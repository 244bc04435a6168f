"""End-to-end plans: retrieval of contexts for a table of queries, and ingest of a document batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hooks import ScoreHook
from ..operators import blocks as B, chunking as C, ingest as I, retrieval as R


def retrieve(queries: DataFrame, chunks: DataFrame, documents: DataFrame, top_k: int = 5, limit: int = 20,
             min_score: float = 0.3, scorer: ScoreHook | None = None, budget: int = R.CONTEXT_BUDGET,
             **search) -> DataFrame:
    """queries(qid, text, emb) -> qid, context, used. Content and file names join back only for the
    few hits left after the top k."""
    hits = R.hybrid_search(queries, chunks, documents, limit=limit, min_score=min_score, **search)
    names = [c for c in ("filename", "original_filename") if c in documents.columns]
    wide = (hits.join(chunks.select("chunk_id", "content", "page"), "chunk_id")
            .join(documents.select("doc_id", *names), "doc_id")
            .join(queries.select("qid", F.col("text").alias("query_text")), "qid"))
    return R.pack_context(R.number_citations(R.rerank(wide, scorer, top_k)), budget)


def ingest(documents: DataFrame, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents(doc_id, user_id, text): duplicates set aside, the rest chunked and given a status."""
    hashed = documents.withColumn("file_hash", I.file_hash(F.encode("text", "UTF-8")))
    links = I.dedupe_documents(hashed.select("doc_id", "user_id", "file_hash"), existing)
    fresh = hashed.join(links.where(~F.col("is_duplicate")).select("doc_id"), "doc_id", "left_semi")
    pages = fresh.select("doc_id", F.lit(1).alias("page"), "text")
    chunks = C.chunk_documents(pages).withColumn("is_boilerplate", F.lit(False))
    return {"links": links, "chunks": chunks, "blocks": B.page_blocks(pages),
            "documents": I.finalize_documents(fresh.select("doc_id", "user_id", "file_hash"), chunks)}
