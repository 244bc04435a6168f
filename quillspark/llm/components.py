"""Connected components by alternating large-star and small-star rounds, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.session import materialize

MAX_ROUNDS = 40


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of edges(a, b), of any ordered
    type. Loops and repeated edges do no harm, edges with a null end are left out; no edges, no rows.

    A round reads edges grouped by node only through a minimum, which is aggregated before the
    shuffle, and joins it back to the edges, where a hot node is split by AQE. Rounds grow with the
    logarithm of the longest path. Each round is written to the checkpoint folder."""
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialize(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(lowest, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        paired = large.join(least, "a")
        small = (paired.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = materialize(small)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
