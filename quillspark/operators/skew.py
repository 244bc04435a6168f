"""Ranks and running counts for keys that may hold a large share of all rows.

A window partitioned by such a key would put it into one task. Here rows are cut into
(key, bucket) partitions along the order column, and the rows before a bucket come from a
running sum over bucket totals, which is a far smaller table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def split_row_number(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rn",
                     total: str | None = None, descending: bool = False) -> DataFrame:
    """row_number over (keys ordered by `order`). bucket must be a monotone function of the
    leading order column (same direction as `descending` says)."""
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    direction = F.desc("_bucket") if descending else F.asc("_bucket")
    over = W.partitionBy(*keys).orderBy(direction)
    whole = W.partitionBy(*keys)
    offsets = sizes.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_size").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_total"))
    within = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    out = (cut.withColumn("_within", within).join(offsets, [*keys, "_bucket"])
           .withColumn(name, (F.col("_before") + F.col("_within")).cast("bigint")))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_before", "_total", "_within")
