"""Substring deduplication by content-defined chunking: a gear rolling hash over the last bytes cuts
every text where its value is small, so an insertion moves only the cuts next to it. Chunks are
compared by digest across documents, and runs of repeated chunks are the repeated passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillspark.llm.rolling import BASE, LEAD, Block, blocks, mix
from quillspark.session import materialize

#: Bytes of the rolling window, mean distance of cuts beyond the least one, least distance.
REACH, MEAN, LEAST = 16, 24, 8
#: Least length of a reported passage in characters, about twenty words.
PASSAGE = 120
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * BASE) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the REACH bytes that end at each byte: the sum of GEAR[b] shifted by its distance.
    Spans double, so the number of passes is the logarithm of REACH."""
    value, span = GEAR[data], 1
    while span < REACH:
        further = value.copy()
        further[span:] += value[:-span] << np.uint32(span) if len(value) > span else 0
        value, span = further, span * 2
    return value


def chunks_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all chunks (bytes) and the index of their text. Chunks cover every text; cuts
    fall between characters and never depend on another text."""
    size = len(block.data)
    spread = np.repeat(np.arange(block.n), np.diff(block.offsets))
    within = np.arange(size) - block.offsets[spread] if size else np.zeros(0, np.int64)
    cut = (gear(block.data) < np.uint32((1 << 32) // MEAN)) & (within >= REACH - 1)
    if size:
        cut[:-1] &= LEAD[block.data[1:]]
    at = np.flatnonzero(cut) + 1
    at = at[np.diff(at, prepend=-LEAST) >= LEAST]
    edges = np.unique(np.concatenate([block.offsets, at]))
    starts, ends = edges[:-1], edges[1:]
    return starts, ends, np.searchsorted(block.offsets, starts, "right") - 1


def chunks(docs: DataFrame) -> DataFrame:
    """All chunks of docs(doc_id, text): doc_id, text_hash, digest, start and length in characters. Rows
    without an id or text have none."""
    schema = StructType([docs.schema["doc_id"], StructField("text_hash", LongType()), StructField("digest", LongType()),
                         StructField("start", IntegerType()), StructField("length", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                starts, ends, owner = chunks_of(block)
                lead = np.zeros(len(block.data) + 1, np.int64)
                np.cumsum(LEAD[block.data], out=lead[1:])
                digest = block.prefix().hash(starts, ends).view(np.int64)
                row = pa.array(owner + block.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(digest),
                     pa.array((lead[starts] - lead[block.offsets[owner]]).astype(np.int32)),
                     pa.array((lead[ends] - lead[starts]).astype(np.int32))], names=schema.names)

    named = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return named.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """Passages of at least `least` characters made of chunks that occur in two documents or more: doc_id,
    text_hash (xxhash64 of the text, as an id may have several), start and end (characters, end exclusive), n_chars, n_chunks, first_doc_id (the smallest id that
    holds a chunk of it) and removed_chars, the characters of chunks that a smaller id holds too.

    The smallest id of a chunk keeps it. Repeats within one document alone are no concern of this
    operator. Repeated rows count once; texts that share an id are one document but have passages
    of their own. Null ids or texts have none; other columns are ignored."""
    every = chunks(docs)
    shared = (every.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
              .where(F.col("low") != F.col("high")).select("digest", "low"))
    # Written first, so that the join does not follow the aggregate in one stage: Spark can then split
    # the rows of a frequent chunk, or broadcast a small table.
    found = every.join(materialize(shared), "digest").select("doc_id", "text_hash", "start", "length", "low").distinct()
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    fresh = (F.lag(F.col("start") + F.col("length")).over(order).isNull()
             | (F.lag(F.col("start") + F.col("length")).over(order) < F.col("start"))).cast("int")
    runs = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    passages = runs.groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"),
        F.count("*").alias("n_chunks"), F.min("low").alias("first_doc_id"),
        F.sum(F.when(F.col("low") < F.col("doc_id"), F.col("length")).otherwise(0)).alias("removed_chars"))
    return (passages.where(F.col("end") - F.col("start") >= least)
            .select("doc_id", "text_hash", "start", "end", (F.col("end") - F.col("start")).alias("n_chars"), "n_chunks",
                    "first_doc_id", "removed_chars"))


def remove_passages(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """doc_id and text without the passages of which a smaller id holds every chunk. Passages are cut from the text
    they were found in, not from others of the same id; repeated rows are all cut, null ids and texts
    come back as they are, other columns are left out whatever their names."""
    gone = repeated_passages(docs, least).where(F.col("removed_chars") == F.col("n_chars"))
    gone = gone.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_gone"))
    joined = docs.select("doc_id", "text").join(gone, (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left")
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))
    kept = F.aggregate("_gone", zero, lambda a, s: F.struct(
        F.greatest(a["pos"], s["end"]).alias("pos"),
        F.concat(a["parts"], F.array(F.substring("text", a["pos"] + 1, F.greatest(s["start"] - a["pos"], F.lit(0))))).alias("parts")),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring("text", a["pos"] + 1, F.lit(2 ** 31 - 1))))
    return joined.select("doc_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
