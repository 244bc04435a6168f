"""Request limits over an event log. Users are cut along time, never handled as one unbounded group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize

#: Events of one key that a task takes in one piece, and events of one window length in it.
SEGMENT, BLOCK = 1 << 20, 1 << 16
_NONE = np.iinfo(np.int64).min


def rolling_count(events: DataFrame, key: str, ts: str, id_col: str, window_seconds: int, limit: int) -> DataFrame:
    """Requests of the key in [ts - window, ts] for every event, and whether it is over the limit.

    Each event also stands in the next time bucket as history and leaves a probe at ts - window;
    one running count then gives both ends of its interval. All steps cluster on (key, bucket)."""
    width = window_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    base = events.select(key, F.col(id_col).alias("_id"), at.alias("_t"), F.floor(at / width).cast("bigint").alias("_b"))
    def row(bucket, when, kind, own):
        return F.struct(bucket.alias("b"), when.alias("at"), F.lit(kind).alias("kind"), F.lit(own).alias("own"))
    rows = base.select(key, "_id", "_t", F.explode(F.array(
        row(F.col("_b"), F.col("_t") - width, 0, True),
        row(F.col("_b"), F.col("_t"), 1, True),
        row(F.col("_b") + 1, F.col("_t"), 1, False))).alias("r")).select(key, "_id", "_t", "r.*")
    running = F.sum("kind").over(W.partitionBy(key, "b").orderBy("at", "kind")
                                 .rangeBetween(W.unboundedPreceding, W.currentRow))
    counted = (rows.withColumn("_c", running).where("own").groupBy(key, "b", "_id", "_t")
               .agg((F.max(F.when(F.col("kind") == 1, F.col("_c"))) - F.max(F.when(F.col("kind") == 0, F.col("_c"))))
                    .alias("requests")))
    return counted.select(F.col("_id").alias(id_col), key, F.timestamp_micros("_t").alias(ts), "requests",
                          (F.col("requests") > limit).alias("over_limit"))


def _next_anchor(times: DataFrame, key: str, width: int) -> DataFrame:
    """times(key, t, b) -> key, t, nxt: the first event more than one window after t."""
    probe = F.col("t") + width
    rows = (times.select(key, "b", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("src"))
            .unionByName(times.select(key, F.floor(probe / width).cast("bigint").alias("b"), probe.alias("at"),
                                      F.lit(0).alias("kind"), F.col("t").alias("src"))))
    later = W.partitionBy(key, "b").orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumn("_near", F.min(F.when(F.col("kind") == 1, F.col("at"))).over(later))
    firsts = rows.groupBy(key, "b").agg(F.min(F.when(F.col("kind") == 1, F.col("at"))).alias("_first"))
    following = W.partitionBy(key).orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    beyond = firsts.select(key, "b", F.last("_first", ignorenulls=True).over(following).alias("_beyond"))
    return (inside.where(F.col("kind") == 0).join(beyond, [key, "b"])
            .select(key, F.col("src").alias("t"), F.coalesce("_near", "_beyond").alias("nxt")))


def _anchors(times: DataFrame, key: str, width: int) -> DataFrame:
    """Window starts per key: the first event, then each first event after the open window.
    Found by doubling jumps, log2(number of windows in the log) joins on (key, time)."""
    jumps = materialize(_next_anchor(times, key, width).where(F.col("nxt").isNotNull()))
    reached = times.groupBy(key).agg(F.min("t").alias("t"))
    span = times.agg((F.max("b") - F.min("b") + 1).alias("n")).first()["n"] or 1
    rounds = max(1, int(span).bit_length())
    for done in range(1, rounds + 1):
        both = F.filter(F.array("t", "nxt"), lambda t: t.isNotNull())
        reached = reached.join(jumps, [key, "t"], "left").select(key, F.explode(both).alias("t"))
        if done < rounds:
            onward = jumps.select(key, F.col("t").alias("nxt"), F.col("nxt").alias("_far"))
            jumps = materialize(jumps.join(onward, [key, "nxt"]).select(key, "t", F.col("_far").alias("nxt")))
    return reached


def _base(events: DataFrame, key: str, ts: str, id_col: str, width: int) -> DataFrame:
    """key, _id, t (microseconds), b (whole window lengths since the epoch)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.select(key, F.col(id_col).alias("_id"), at.alias("t"), F.floor(at / width).cast("bigint").alias("b"))


def _finish(counted: DataFrame, key: str, ts: str, id_col: str, limit: int) -> DataFrame:
    """counted(key, _id, t, requests, start) -> the result columns."""
    return counted.select(F.col("_id").alias(id_col), key, F.timestamp_micros("t").alias(ts), "requests",
                          F.timestamp_micros("start").alias("window_start"),
                          F.greatest(F.lit(0), F.lit(limit) - F.col("requests")).alias("remaining"),
                          (F.col("requests") <= limit).alias("allowed"))


def _by_doubling(base: DataFrame, key: str, width: int) -> DataFrame:
    """For keys with very many events in one window length: everything by sorts that can spill."""
    block = F.floor(F.col("t") / width).cast("bigint")
    times = base.select(key, "t", "b").distinct()
    anchors = _anchors(times, key, width).withColumn("b", block)

    # Two starts are more than a window apart, so a block holds at most one, and a request's
    # start lies in its own block or the one before.
    in_block = W.partitionBy(key, "b")
    placed = (base.withColumn("_pos", F.row_number().over(in_block.orderBy("t", "_id")))
              .withColumn("_size", F.count("*").over(in_block)))
    starts = (placed.groupBy(key, "b", "t").agg(F.min("_pos").alias("_pos"), F.max("_size").alias("_size"))
              .join(anchors, [key, "b", "t"]))
    own = starts.select(key, "b", F.col("t").alias("_own"), F.col("_pos").alias("_own_pos"))
    prior = starts.select(key, (F.col("b") + 1).alias("b"), F.col("t").alias("_prior"),
                          (F.col("_size") - F.col("_pos") + 1).alias("_carried"))
    joined = placed.join(own, [key, "b"], "left").join(prior, [key, "b"], "left")
    in_own = F.coalesce(F.col("_own") <= F.col("t"), F.lit(False))
    count = F.when(in_own, F.col("_pos") - F.col("_own_pos") + 1).otherwise(F.col("_pos") + F.col("_carried"))
    return joined.select(key, "_id", "t", count.cast("bigint").alias("requests"),
                         F.when(in_own, F.col("_own")).otherwise(F.col("_prior")).alias("start"))


def window_starts(times: np.ndarray, width: int, start: int = _NONE) -> np.ndarray:
    """The window starts among sorted times, after an earlier start if there is one: each is the first time more
    than width after the one before."""
    found = []
    at = 0 if start == _NONE else int(np.searchsorted(times, start + width, "right"))
    while at < len(times):
        found.append(times[at])
        at = int(np.searchsorted(times, times[at] + width, "right"))
    return np.array(found, np.int64)


def transition(times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What a segment of sorted times does to the start it comes in with: (highs, outs), where a start s with
    s + width < highs[i], for the first such i, leaves as outs[i]; _NONE: it is still the last one. Starts only matter
    by the first time after their window, and soon lead to the same windows, so few rows are left. Such
    functions compose."""
    first = np.unique(times[times <= times[0] + width])
    highs = np.append(first, np.iinfo(np.int64).max)
    heads = np.append(first, times[np.searchsorted(times, first[-1], "right")] if times[-1] > first[-1] else _NONE)
    moving = heads != _NONE
    outs = heads.copy()
    while moving.any():
        nxt = np.searchsorted(times, outs[moving] + width, "right")
        going = nxt < len(times)
        at = np.flatnonzero(moving)
        outs[at[going]] = times[nxt[going]]
        moving[at[~going]] = False
    last = np.append(outs[1:] != outs[:-1], True)
    return highs[last], outs[last]


def _apply(function: tuple[np.ndarray, np.ndarray], start: int, width: int) -> int:
    highs, outs = function
    out = int(outs[np.searchsorted(highs, start + width, "right") if start != _NONE else 0])
    return start if out == _NONE else out


_STEP = "seg long, kind int, _id {id}, t long, requests long, start long, highs binary, outs binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of equal (key, seg) of sorted batches; the key is column 0, seg column 1."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, seg = batch.column(0), batch.column(1)
        new = pc.or_(pc.not_equal(key.slice(1), key.slice(0, n - 1)), pc.not_equal(seg.slice(1), seg.slice(0, n - 1)))
        edges = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for low, high in zip(edges[:-1], edges[1:]):
            if held and (held[0].column(0)[0] != key[low] or held[0].column(1)[0] != seg[low]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _scan(rows: DataFrame, key: str, width: int) -> DataFrame:
    """rows(key, seg, _id, t, came): came is the start that a segment comes in with, null where it is not known yet.
    kind 0: an event with its count within the segment; 1: what a segment leaves behind, its last
    start (start) and that window's count (requests); 2: the transition of a segment of unknown start."""
    types = {c: rows.schema[c].dataType.simpleString() for c in (key, "_id")}
    schema = StructType.fromDDL(f"`{key}` {types[key]}, " + _STEP.format(id=types["_id"]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            n, times = table.num_rows, table["t"].to_numpy()
            came, seg = table["came"][0].as_py(), table["seg"][0].as_py()

            def rows_of(size: int, **given) -> pa.RecordBatch:
                own = table.slice(0, size)
                columns = {key: own[key].combine_chunks(), "seg": own["seg"].combine_chunks(), **given}
                return pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

            if came is None:
                highs, outs = transition(times, width)
                yield rows_of(1, kind=[2], highs=[highs.tobytes()], outs=[outs.tobytes()])
                continue
            starts = window_starts(times, width, came)
            all_starts = np.append(came, starts)
            own = np.searchsorted(starts, times, "right")
            firsts = np.append(0, np.searchsorted(times, starts))
            yield rows_of(n, kind=np.zeros(n, np.int32), _id=table["_id"].combine_chunks(), t=times,
                          requests=np.arange(n) - firsts[own] + 1, start=all_starts[own])
            yield rows_of(1, kind=[1], requests=[n - int(firsts[-1])], start=[int(all_starts[-1])])

    ordered = rows.repartition(key, "seg").sortWithinPartitions(key, "seg", "t", "_id")
    return ordered.select(key, "seg", "_id", "t", "came").mapInArrow(run, schema)


def _entries(steps: DataFrame, key: str, width: int) -> DataFrame:
    """The start that each later segment of a key comes in with, by composing transitions in order."""
    kind = steps.schema[key].dataType.simpleString()

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        state, came = table["start"][0].as_py(), []
        for high, out in zip(table["highs"][1:], table["outs"][1:]):
            came.append(state)
            state = _apply((np.frombuffer(high.as_py(), np.int64), np.frombuffer(out.as_py(), np.int64)), state, width)
        return pa.table({key: table[key][1:], "seg": table["seg"][1:], "came": pa.array(came, pa.int64())})

    known = steps.where("kind > 0").select(key, "seg", "start", "highs", "outs")
    return known.groupBy(key).applyInArrow(compose, f"`{key}` {kind}, seg long, came long")


def anchored_quota(events: DataFrame, key: str, ts: str, id_col: str, window_seconds: int = 24 * 3600,
                   limit: int = 50, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """The counter each request saw: a window opens at the first request after the previous one
    has run out (strictly later than its length) and counts denied requests too.

    A key's events in order of time are cut into segments of about `segment` rows. The first one is counted
    at once; what a later one does to the start it comes in with is a small function of that start, and
    the functions compose, so all segments are counted in a second pass, and a window that reaches over
    a cut gets its count from the segment before. A key with more than `block` events in one
    window length is counted by sorts that spill instead. Rows without a key or time are left out."""
    width = window_seconds * 1_000_000
    base = _base(events, key, ts, id_col, width).where(F.col(key).isNotNull() & F.col("t").isNotNull())
    sizes = materialize(base.groupBy(key, "b").count())  # a row for each key and window length
    per_key = sizes.groupBy(key).agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    most = per_key.agg(F.max("n"), F.max("most")).first()
    rows = base.withColumns({"seg": F.lit(0).cast("long"), "came": F.lit(_NONE)})
    if most[0] is None or (most[0] <= segment and most[1] <= block):
        counted = _scan(rows, key, width).where("kind = 0").select(key, "_id", "t", "requests", "start")
        return _finish(counted, key, ts, id_col, limit)
    dense = materialize(per_key.where(F.col("most") > block).select(key))
    before = F.sum("count").over(W.partitionBy(key).orderBy("b")) - F.col("count")
    cuts = materialize(sizes.join(dense, key, "left_anti").select(key, "b", F.floor(before / segment).cast("long").alias("seg")))
    came = F.when(F.col("seg") == 0, F.lit(_NONE))
    cut = base.join(cuts, [key, "b"]).select(key, "seg", "_id", "t", came.alias("came"))
    first = materialize(_scan(cut, key, width))
    entries = materialize(_entries(first, key, width))
    later = materialize(_scan(cut.where("seg > 0").drop("came").join(entries, [key, "seg"]), key, width))
    both = first.where("kind < 2").unionByName(later)
    # A window that reaches over a cut ends within the next segment's first window length.
    carried = both.where("kind = 1").select(key, (F.dense_rank().over(W.partitionBy(key).orderBy("seg"))).alias("_next"), "seg",
                                            F.col("requests").alias("_carried"), F.col("start").alias("_start"))
    order = both.where("kind = 1").select(key, "seg", (F.dense_rank().over(W.partitionBy(key).orderBy("seg")) - 1).alias("_next"))
    carried = order.join(carried.drop("seg"), [key, "_next"]).drop("_next")
    counted = (both.where("kind = 0").select(key, "seg", "_id", "t", "requests", "start").join(carried, [key, "seg"], "left")
               .withColumn("requests", F.col("requests") + F.when(F.col("start") == F.col("_start"), F.col("_carried")).otherwise(0))
               .select(key, "_id", "t", "requests", "start"))
    slow = _by_doubling(base.join(dense, key, "left_semi"), key, width)
    return _finish(counted.unionByName(slow), key, ts, id_col, limit)
