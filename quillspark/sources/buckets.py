"""Keyed tables that grow batch by batch: rows are hashed into buckets, a batch rewrites the buckets it touches
and then a manifest, which says for each bucket which version of it counts.

A batch reads and writes no other bucket, so its cost follows the batch, not the history. The manifest is
written last: until then readers see the version before, and a batch that is run again writes the same
folders. A version's number is given by the caller (a stream's batch id).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass
class BucketedTable:
    """root: shared folder; keys: columns whose hash names the bucket (nulls count); schema: DDL of the rows."""

    root: str
    keys: list[str]
    schema: str
    buckets: int = 256

    def bucket(self, keys: list[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def _manifest(self, spark: SparkSession, version: int) -> dict[int, int]:
        """Bucket -> version, at most one row a bucket."""
        if version < 0:
            return {}
        rows = spark.read.schema("bucket int, written long").parquet(f"{self.root}/manifest/version={version}")
        return {r["bucket"]: r["written"] for r in rows.collect()}

    def _read(self, spark: SparkSession, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/data/{written}/bucket={b}" for b, written in sorted(manifest.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def latest(self, spark: SparkSession) -> int:
        return spark.read.parquet(f"{self.root}/manifest").agg(F.max("version")).first()[0]

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All rows, as of a version or of the last one."""
        return self._read(spark, self._manifest(spark, self.latest(spark) if version is None else version))

    def touched(self, batch: DataFrame, version: int, keys: list[str] | None = None) -> DataFrame:
        """The rows of the version before that lie in the batch's buckets. keys: what the batch calls the keys."""
        mine = {r[0] for r in batch.select(self.bucket(keys)).distinct().collect()}  # at most `buckets`
        before = self._manifest(batch.sparkSession, version - 1)
        return self._read(batch.sparkSession, {b: v for b, v in before.items() if b in mine})

    def merge(self, batch: DataFrame, version: int, combine: Callable[[DataFrame, DataFrame], DataFrame],
              keys: list[str] | None = None) -> None:
        """Writes combine(old rows of the touched buckets, batch) as those buckets. combine must keep rows in their
        bucket and hand on old rows that stay. A bucket that is left empty disappears."""
        spark = batch.sparkSession
        mine = {r[0] for r in batch.select(self.bucket(keys)).distinct().collect()}
        before = self._manifest(spark, version - 1)
        old = self._read(spark, {b: v for b, v in before.items() if b in mine})
        target = f"{self.root}/data/{version}"
        (combine(old, batch).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(target))
        kept = {r[0] for r in spark.read.schema(f"{self.schema}, bucket int").parquet(target).select("bucket").distinct().collect()}
        after = {**{b: v for b, v in before.items() if b not in mine}, **dict.fromkeys(kept, version)}
        (spark.createDataFrame(sorted(after.items()), "bucket int, written long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}"))
