"""What the operators of this folder share: tables, splits, bounded broadcasts, block-wise scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quillspark.llm.rolling import Block, blocks
from quillspark.session import materialize

#: Rows of ids that may be broadcast: at 16 bytes a row, 32 MB. Beyond it Spark joins by shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo modulus; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in ids(doc_id), null included, all columns kept."""
    gone = small(ids.select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def label_sample(labels: DataFrame, label: str, trainable: Column, limit: int) -> DataFrame:
    """At most limit labelled ids, picked by a hash of the id: (doc_id, label)."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & trainable)
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def map_blocks(df: DataFrame, keep: list[str], fields: list[StructField],
               make: Callable[[], Callable[[Block], list]], text: str = "text") -> DataFrame:
    """keep plus the new fields, a row for each row. make runs once a task and returns a function
    that turns a block of texts into one array for each field."""
    schema = StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, score = to_arrow_schema(schema), make()
        for batch in batches:
            parts = [score(block) for block in blocks(batch.column(len(keep)))]
            if parts:
                new = [pa.concat_arrays([pa.array(part[i], type=arrow.field(len(keep) + i).type) for part in parts])
                       for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *new], names=arrow.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys (null equals null), from batches sorted by key. Holds one
    batch and the unfinished run before it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[len(keys) - 1]
        same = pc.fill_null(pc.equal(keys, last), False) if last.is_valid else pc.is_null(keys)
        start = len(keys) - int(pc.sum(same).as_py())
        if start or (held and held[-1].column(key)[0] != keys[0]):
            ready = pa.Table.from_batches([*held, batch.slice(0, start)])
            if ready.num_rows:
                yield ready
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: pa.ChunkedArray) -> list[tuple[int, int]]:
    """First and end index of each run of equal keys."""
    values = keys.to_pylist()
    edges = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
    return list(zip(edges[:-1], edges[1:]))


def places(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Adds each row's number within its key, from 0, by `order`, without a task that holds a whole key: a
    range sort cuts keys anywhere (equal rows too, by a number of their own), and what lies in earlier
    partitions is added. Written once to the checkpoint folder."""
    salt = F.xxhash64(F.monotonically_increasing_id())
    keyed = df.withColumn("_salt", salt)
    by = [F.col(key).asc_nulls_first(), *order, F.col("_salt")]
    cut = materialize(keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
                      .withColumn("_at", F.monotonically_increasing_id()))
    cut = cut.withColumn("_part", F.shiftright("_at", 33))
    spans = cut.groupBy(key, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    # One row for each partition that a key reaches into.
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    spans = small(spans.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_low",
                               F.coalesce(before, F.lit(0)).alias("_before")))
    joined = cut.join(spans, cut[key].eqNullSafe(spans["_key"]) & (cut["_part"] == spans["_p"]))
    return (joined.withColumn(name, F.col("_at") - F.col("_low") + F.col("_before"))
            .drop("_at", "_part", "_key", "_p", "_low", "_before"))


def long_keys(df: DataFrame, key: str, size: Column, rows: int, total: int) -> DataFrame:
    """The keys with more than `rows` rows or a total size above `total`, as _long; written, so that
    both ways that depend on it agree. At most one for each `rows` rows or `total` of size."""
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    return materialize(sums.where((F.col("n") > rows) | (F.col("s") > total)).select(F.col(key).alias("_long")))
