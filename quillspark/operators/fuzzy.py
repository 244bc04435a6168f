"""Trigram similarity join.

For a similarity above t, two sets of sizes m and n must share at least t * (m + n) / (1 + t) members. Members
are put in one common order, those first that pair fewest strings of the two sides (none, if only one side has
them), and two sets that share enough must share one in the first m - need + 1 and n - need + 1 of this order.
This is exact, and keeps the commonest trigrams, which would pair everything with everything, out of the join.
Rows of short sets carry the whole set: a pair is scored where its first shared trigram meets, in products of
blocks, and nothing but results leaves there. Longer sets meet by key, once a pair. Equal strings are compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.terms import trigrams
from ..session import materialize
from .similarity import _spread

#: Trigrams of a set that its rows may carry into the join.
SHORT = 64
#: Pairs that a task of short sets scores, about, and the most such tasks.
PAIRS_A_TASK, MAX_TASKS = 10_000_000, 5000
#: Rows of a side of one trigram in one cell, and in one block of scores.
CELL, BLOCK = 20_000, 1024


def _sets(df: DataFrame) -> DataFrame:
    """key, text, grams of each distinct text; written, so that a text keeps its key."""
    texts = df.select("text").where(F.col("text").rlike(r"[\p{L}\p{N}]")).distinct()
    return materialize(texts.select(F.monotonically_increasing_id().alias("key"), "text", trigrams("text").alias("grams"))
                       .withColumn("size", F.size("grams")))


def _code(gram: Column) -> Column:
    """A trigram's three code points as one number."""
    at = [F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3)]
    return F.shiftleft(at[0], 42) + F.shiftleft(at[1], 21) + at[2]


def _need(total: Column, threshold: float) -> Column:
    """Least number of shared members of two sets with `total` members; lowered by a hair, as it only sorts out."""
    return F.ceil(total * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))


def _ordered(sets: DataFrame, pairing: DataFrame) -> DataFrame:
    """key, size and g: the set in the common order, as structs (cost, code). Members of one side only cost nothing."""
    grams = sets.select("key", "size", F.explode("grams").alias("gram")).withColumn("gram", _code(F.col("gram")))
    return (grams.join(pairing, "gram", "left").groupBy("key", "size")
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "gram"))).alias("g")))


def _prefixes(ordered: DataFrame, partner: int, threshold: float) -> DataFrame:
    """A row for each member that may be the first shared one: gram, place, key, size, and set, which is null for long
    sets. partner: the least size of the other side."""
    least = F.greatest(F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)), F.lit(partner))
    length = F.least(F.col("size"), F.col("size") - _need(F.col("size") + least, threshold) + 1).cast("int")
    ordered = ordered.where(length > 0)
    carried = F.when(F.col("size") <= SHORT, F.col("g.gram"))
    rows = ordered.select("key", "size", carried.alias("set"), F.posexplode(F.slice("g", F.lit(1), length)).alias("place", "_m"))
    return rows.where("_m.cost > 0").select(F.col("_m.gram").alias("gram"), "place", "key", "size", "set")


class _Rows:
    """Some rows of one side: keys, sizes, places and all members with the row and the place of each."""

    def __init__(self, table: pa.Table) -> None:
        self.keys, self.sizes, self.places = (table[c].to_numpy() for c in ("key", "size", "place"))
        sets = table["set"].combine_chunks()
        self.members = sets.flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(self.keys)), self.sizes)
        self.at = np.arange(len(self.members)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def marks(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x codes: 1 for each member, and 1 for each of those before the row's place."""
        column = np.minimum(np.searchsorted(codes, self.members), len(codes) - 1)
        known = codes[column] == self.members
        out = []
        for kept in (known, known & (self.at < self.places[self.row])):
            out.append(np.zeros((len(self.keys), len(codes)), np.float32))
            out[-1][self.row[kept], column[kept]] = 1
        return out[0], out[1]


def _score_short(threshold: float):
    """Scores all pairs of the rows of one trigram, a block at a time, by the product of their marks. The pair belongs to
    this trigram if the members before it have none in common."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(0, left.num_rows if right.num_rows else 0, BLOCK):
            x = _Rows(left.slice(i, BLOCK))
            codes = np.unique(x.members)
            every, before = x.marks(codes)
            for j in range(0, right.num_rows, BLOCK):
                y = _Rows(right.slice(j, BLOCK))
                every2, before2 = y.marks(codes)
                shared = (every @ every2.T).astype(np.float64)
                similarity = shared / (x.sizes[:, None] + y.sizes[None, :] - shared)
                m, n = np.nonzero((similarity > threshold) & (before @ before2.T == 0))
                found.append((x.keys[m], y.keys[n], similarity[m, n]))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.table({n: pa.array(c) for n, c in zip(("left_key", "right_key", "similarity"), columns)})
    return run


def _short_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of rows (_prefixes) of one trigram. Small tables may give many pairs, so tasks are dealt by pairs, not by
    bytes, and a trigram of many rows is cut into cells."""
    counts = [df.groupBy("gram").agg(F.count("*").alias(n)) for df, n in ((left, "_a"), (right, "_b"))]
    met = materialize(counts[0].join(counts[1], "gram").select("gram", F.ceil(F.col("_a") / CELL).cast("int").alias("_ln"),
                                                              F.ceil(F.col("_b") / CELL).cast("int").alias("_rn"),
                                                              (F.col("_a") * F.col("_b")).alias("_pairs")))
    pairs = met.agg(F.sum("_pairs")).first()[0] or 0
    tasks = min(MAX_TASKS, 1 + pairs // PAIRS_A_TASK)
    cells = met.drop("_pairs")
    keys = ["gram", "_l", "_r"]
    spread = [_spread(left.join(cells, "gram"), "_l", "key", F.col("_ln"), "_r", F.col("_rn")),
              _spread(right.join(cells, "gram"), "_r", "key", F.col("_rn"), "_l", F.col("_ln"))]
    sides = [df.select(*keys, "key", "size", "place", "set").repartition(tasks, *keys).groupBy(*keys) for df in spread]
    return sides[0].cogroup(sides[1]).applyInArrow(_score_short(threshold), "left_key bigint, right_key bigint, similarity double")


def _near(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """left_key, right_key, similarity (> threshold) of two tables of sets."""
    held = [s.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias(n)) for s, n in ((a, "_a"), (b, "_b"))]
    pairing = materialize(held[0].join(held[1], "gram").select(_code(F.col("gram")).alias("gram"), (F.col("_a") * F.col("_b")).alias("cost")))
    low = [s.agg(F.min("size")).first()[0] or 0 for s in (b, a)]
    heads = [materialize(_prefixes(_ordered(s, pairing), least, threshold)) for s, least in zip((a, b), low)]

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        need = _need(F.col("l.size") + F.col("r.size"), threshold)
        fits = ((F.col("l.size") >= F.col("r.size") * threshold) & (F.col("r.size") >= F.col("l.size") * threshold)
                & (F.col("l.place") <= F.col("l.size") - need) & (F.col("r.place") <= F.col("r.size") - need))
        return left.alias("l").join(right.alias("r"), (F.col("l.gram") == F.col("r.gram")) & fits)

    def scored(pairs: DataFrame) -> DataFrame:
        shared = F.size("_shared").cast("double")
        return (pairs.withColumn("similarity", shared / (F.col("_m") + F.col("_n") - F.size("_shared")))
                .where(F.col("similarity") > threshold).select("left_key", "right_key", "similarity"))
    short, long = F.col("size") <= SHORT, F.col("size") > SHORT
    out = _short_pairs(*(h.where(short) for h in heads), threshold)
    if not all(h.where(long).isEmpty() for h in heads):
        keys = [F.col("l.key").alias("left_key"), F.col("r.key").alias("right_key")]
        apart = met(heads[0].where(long), heads[1]).select(*keys).unionByName(
            met(heads[0].where(short), heads[1].where(long)).select(*keys)).distinct()
        full = (apart.join(a.select(F.col("key").alias("left_key"), F.col("grams").alias("_lg"), F.col("size").alias("_m")), "left_key")
                .join(b.select(F.col("key").alias("right_key"), F.col("grams").alias("_rg"), F.col("size").alias("_n")), "right_key")
                .withColumn("_shared", F.array_intersect("_lg", "_rg")))
        out = out.unionByName(scored(full))
    return out


def _both(left: DataFrame, right: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sets of both sides. Strings too long or too short for every string of the other side are dropped first."""
    a, b = _sets(left), _sets(right)
    a_range = a.agg(F.struct(F.min("size").alias("low"), F.max("size").alias("high"))).scalar()
    return a, b.withColumn("_r", a_range).where((F.col("size") <= F.col("_r.high") / threshold)
                                                & (F.col("size") >= F.col("_r.low") * threshold)).drop("_r")


def _named(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(F.col("key").alias(f"{side}_key"), F.col("text").alias(f"{side}_text"))


def trigram_text_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """left(text), right(text) -> left_text, right_text, similarity (> threshold), per distinct text."""
    a, b = _both(left, right, threshold)
    return (_near(a, b, threshold).join(_named(a, "left"), "left_key").join(_named(b, "right"), "right_key")
            .select("left_text", "right_text", "similarity"))


def trigram_join(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """left(id, text), right(id, text) -> left_id, right_id, similarity. Pairs travel by number, not by text."""
    a, b = _both(left, right, threshold)
    ids = [df.select(F.col("id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text")).join(_named(sets, side), f"{side}_text")
           .select(f"{side}_key", f"{side}_id") for df, sets, side in ((left, a, "left"), (right, b, "right"))]
    return (_near(a, b, threshold).join(ids[0], "left_key").join(ids[1], "right_key")
            .select("left_id", "right_id", "similarity"))
