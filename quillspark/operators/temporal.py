"""Joins of large tables by time: the last version at or before an event, and the intervals an event lies in.

Keys are cut along time, so a key with a third of all rows is spread over its time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Finest level of the interval join, and the number of levels: each is twice as wide as the one below.
FINEST_SECONDS, LEVELS = 3600, 32


def as_of_join(events: DataFrame, versions: DataFrame, key: str, ts: str, since: str, tie: str,
               payload: list[str], bucket_seconds: int = 24 * 3600) -> DataFrame:
    """events with the payload columns of the version of the same key that began last, at or before ts (`since` of the
    version; among equal times the largest `tie`); null without one. Every event stays once, also with a
    null key or time; versions without key or time are left out.

    Both sides are laid in one order per (key, time bucket), where a version goes on until the next; what a
    bucket begins with comes from a running last value over the buckets of the key, a far smaller table."""
    width = bucket_seconds * 1_000_000

    def at(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    found = F.struct(F.col(tie).alias("_tie"), *[F.col(c) for c in payload])
    shape = versions.select(found.alias("v")).schema["v"].dataType
    right = (versions.where(F.col(key).isNotNull() & F.col(since).isNotNull())
             .select(F.col(key).alias("_key"), at(since).alias("_t"), F.lit(0).alias("_side"), found.alias("_v")))
    left = events.select(F.col(key).alias("_key"), at(ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(shape).alias("_v"),
                         F.struct(*events.columns).alias("_e"))
    row_type = left.schema["_e"].dataType
    rows = left.unionByName(right.withColumn("_e", F.lit(None).cast(row_type))).withColumn("_b", F.floor(F.col("_t") / width))
    inside = W.partitionBy("_key", "_b").orderBy("_t", "_side", F.col("_v._tie")).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    ends = rows.groupBy("_key", "_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_t", F.col("_v._tie")))).alias("_last"))
    before = W.partitionBy("_key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("_key").alias("_k2"), F.col("_b").alias("_b2"), F.last("_last", ignorenulls=True).over(before).alias("_came"))
    out = seen.where("_side = 1").join(carried, (F.col("_key") == F.col("_k2")) & (F.col("_b") == F.col("_b2")), "left")
    best = F.coalesce("_in", "_came")
    known = F.col("_key").isNotNull() & F.col("_t").isNotNull()
    return out.select("_e.*", *[F.when(known, best[c]).alias(c) for c in payload])


def interval_join(events: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """events x intervals of the same key with start <= ts < end; a null end never comes. Columns of both sides but the
    intervals' key; rows without key or time meet nothing.

    An interval stands at the level whose width is at least its length, in at most two buckets there; an event looks into
    one bucket of each level in use. So a long interval costs no more rows than a short one."""
    micros = FINEST_SECONDS * 1_000_000
    low, high = F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col(end).cast("timestamp"))
    open_end = F.lit(2 ** 62)
    spans = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull()).withColumnRenamed(key, "_key").withColumns(
        {"_low": low, "_high": F.coalesce(high, open_end)}).where("_low < _high")
    length = F.col("_high") - F.col("_low")
    level = F.least(F.greatest(F.lit(0), F.ceil(F.log2(length / micros))), F.lit(LEVELS)).cast("int")
    spans = spans.withColumn("_level", level)

    def bucket(t: Column) -> Column:
        # The last level holds what is longer than all others, in one bucket.
        return F.when(F.col("_level") == LEVELS, 0).otherwise(F.floor(t / (F.lit(micros) * F.pow(F.lit(2.0), F.col("_level"))))).cast("long")

    used = sorted(r["_level"] for r in spans.select("_level").distinct().collect())  # at most LEVELS + 1
    placed = spans.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("_low")), bucket(F.col("_high") - 1)))))
    points = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    points = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in used]) if used else F.array().cast("array<int>")))
    points = points.withColumn("_bucket", bucket(F.col("_t")))
    met = points.join(placed, (points[key] == placed["_key"]) & (points["_level"] == placed["_level"]) & (points["_bucket"] == placed["_bucket"]))
    kept = [c for c in intervals.columns if c != key]
    return met.where((F.col("_low") <= F.col("_t")) & (F.col("_t") < F.col("_high"))).select(
        *[points[c] for c in events.columns], *[placed[c] for c in kept])
