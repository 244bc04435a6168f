"""Model hooks. The library never calls a model itself: a caller passes a function, and the
defaults below are deterministic stand-ins that need no network.

* embedding: list of texts -> list of vectors (None for a failed item), run on Arrow batches
* scoring:   (query Column, content Column) -> score Column; wrap a model in a pandas_udf
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .terms import distinct_terms
from .text import estimate_api_tokens

EmbedHook = Callable[[list[str]], list[list[float] | None]]
ScoreHook = Callable[[Column, Column], Column]
EMBED_BATCH = 16


def hashing_embedder(dim: int = 64) -> EmbedHook:
    """Signed feature hashing of the lower-cased words, scaled to length one."""
    def embed(texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            vector = [0.0] * dim
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                vector[(code >> 1) % dim] += 1.0 if code & 1 else -1.0
            length = sum(v * v for v in vector) ** 0.5
            out.append([v / length for v in vector] if length else vector)
        return out
    return embed


def lexical_scorer(query: Column, content: Column) -> Column:
    """Share of the query's terms that occur in the content."""
    terms = distinct_terms(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(terms, distinct_terms(content))), F.size(terms)),
                      F.lit(0.0))


def _safe(hook: EmbedHook, texts: list[str], dim: int) -> Iterator[tuple[list[float], bool]]:
    """A vector for each text. Of a hook that raises or returns another number of vectors, every text is
    asked for alone, so that no vector moves to another text."""
    try:
        vectors = list(hook(texts))
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    except Exception:  # noqa: BLE001 - one bad text must not lose its batch
        vectors = []
        for text in texts:
            try:
                (vector,) = hook([text])
                vectors.append(vector)
            except Exception:  # noqa: BLE001
                vectors.append(None)
    for vector in vectors:
        failed = vector is None or len(vector) != dim
        yield ([0.0] * dim if failed else list(vector)), failed


def embed(df: DataFrame, text_col: str, hook: EmbedHook, dim: int, batch: int = EMBED_BATCH) -> DataFrame:
    """Adds emb, embed_failed and est_tokens. A failed item gets a zero vector, which every
    search leaves out. Only the text column crosses into Python."""
    kind = pa.struct([("emb", pa.list_(pa.float32())), ("failed", pa.bool_())])

    # Only the texts of one call of the hook are Python objects at a time, and their vectors are packed at once.
    @F.arrow_udf("emb array<float>, failed boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([], kind)]
            for at in range(0, len(texts), batch):
                values = ["" if t is None else t for t in texts.slice(at, batch).to_pylist()]
                parts.append(pa.array([{"emb": v, "failed": f} for v, f in _safe(hook, values, dim)], kind))
            yield pa.concat_arrays(parts)
    out = df.withColumn("_e", run(F.col(text_col)))
    return out.select(*df.columns, F.col("_e.emb").alias("emb"), F.col("_e.failed").alias("embed_failed"),
                      estimate_api_tokens(text_col).alias("est_tokens"))


def embed_stats(embedded: DataFrame, batch: int = EMBED_BATCH) -> DataFrame:
    """Item, failure, call and token totals of an embedding job."""
    return embedded.agg(F.count("*").alias("items"), F.count_if("embed_failed").alias("failed"),
                        F.ceil(F.count("*") / F.lit(float(batch))).alias("calls"),
                        F.coalesce(F.sum("est_tokens"), F.lit(0)).alias("est_tokens"))


def reembed(chunks: DataFrame, hook: EmbedHook, dim: int) -> DataFrame:
    """Repair job: every vector anew, whatever was stored, with a length-mismatch flag."""
    fresh = embed(chunks.drop("emb", "embed_failed", "est_tokens"), "content", hook, dim)
    return fresh.withColumn("length_ok", F.size("emb") == dim)
