"""As-of and interval joins against plain loops: hot keys, ties, nulls, open and empty intervals."""

import random

from pyspark.sql import functions as F

from quillspark.operators import temporal as T

RNG = random.Random(6)
DAY = 86_400


def test_as_of_join(spark):
    versions = [(RNG.choice([1, 1, 1, 2, 3, None]), RNG.randrange(0, 20 * DAY, 3600) if i % 9 else None, i) for i in range(120)]
    events = [(i, RNG.choice([1, 1, 2, 3, 4, None]), RNG.randrange(0, 25 * DAY, 3600) if i % 11 else None) for i in range(300)]
    right = spark.createDataFrame(versions, "k long, s long, v long").select("k", F.timestamp_seconds("s").alias("since"), "v")
    left = spark.createDataFrame(events, "id long, k long, s long").select("id", "k", F.timestamp_seconds("s").alias("ts"))
    got = {r["id"]: r["v"] for r in T.as_of_join(left, right, "k", "ts", "since", "v", ["v"], 2 * DAY).collect()}
    want = {}
    for i, k, t in events:
        fits = [(s, v) for vk, s, v in versions if vk is not None and vk == k and s is not None and t is not None and s <= t]
        want[i] = max(fits)[1] if fits else None
    assert got == want and any(v is None for v in got.values())
    assert T.as_of_join(left.limit(0), right, "k", "ts", "since", "v", ["v"]).count() == 0
    assert T.as_of_join(left, right.limit(0), "k", "ts", "since", "v", ["v"]).where("v IS NOT NULL").count() == 0


def test_interval_join(spark):
    spans = []
    for i in range(150):
        start = RNG.randrange(-3 * DAY, 20 * DAY)
        end = RNG.choice([None, start, start - 5, start + 1, start + RNG.randrange(1, 3600), start + RNG.randrange(1, 30 * DAY), start + 10 ** 11])
        spans.append((RNG.choice([1, 1, 1, 2, None]), start if i % 13 else None, end, i))
    events = [(i, RNG.choice([1, 1, 2, 3, None]), RNG.randrange(-3 * DAY, 25 * DAY) if i % 11 else None) for i in range(200)]
    events += [(1000 + i, 1, s) for i, (_, s, _, _) in enumerate(spans)] + [(2000 + i, 1, e) for i, (_, _, e, _) in enumerate(spans)]
    right = spark.createDataFrame(spans, "k long, a long, b long, v long").select(
        "k", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"), "v")
    left = spark.createDataFrame(events, "id long, k long, s long").select("id", "k", F.timestamp_seconds("s").alias("ts"))
    found = T.interval_join(left, right, "k", "ts", "a", "b")
    got = sorted((r["id"], r["v"]) for r in found.collect())
    want = sorted((i, v) for i, k, t in events for vk, a, b, v in spans
                  if k is not None and k == vk and t is not None and a is not None and a <= t and (b is None or t < b))
    assert got == want and found.columns == ["id", "k", "ts", "a", "b", "v"]
    assert T.interval_join(left, right.limit(0), "k", "ts", "a", "b").count() == 0
