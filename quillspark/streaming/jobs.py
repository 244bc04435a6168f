"""Incremental versions of the batch operators as Structured Streaming jobs.

Sinks that keep tables write one folder per micro-batch (batch=<id>, overwritten on a retry) or buckets of a
version (sources.buckets), so replaying a batch leaves the same rows. Output and checkpoint folders are given by the caller and
must be shared storage on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import cache as K, mining as N, retrieval as R
from ..operators.ingest import file_hash
from ..plans.answer import ingest
from ..session import materialize
from ..sources.buckets import BucketedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def known_hashes(root: str, user_type: str, id_type: str) -> BucketedTable:
    """Which content a user has sent before: keys alone, so a batch never reads earlier texts."""
    return BucketedTable(f"{root}/known", ["user_id", "file_hash"], f"doc_id {id_type}, user_id {user_type}, file_hash string")


def stream_ingest(documents: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """documents(doc_id, user_id, text): writes root/documents and root/chunks. Duplicates of this
    or any earlier batch (same user and content) are set aside; to find them, a batch looks into the buckets
    of its own hashes in root/known."""
    kinds = {c: documents.schema[c].dataType.simpleString() for c in ("doc_id", "user_id")}
    known = known_hashes(root, kinds["user_id"], kinds["doc_id"])

    def run(batch: DataFrame, batch_id: int) -> None:
        hashes = batch.select("doc_id", "user_id", file_hash(F.encode("text", "UTF-8")).alias("file_hash"))
        out = ingest(batch, known.touched(hashes, batch_id))
        for name in ("documents", "chunks"):
            out[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        stored = batch.sparkSession.read.parquet(f"{root}/documents/batch={batch_id}").select("doc_id", "user_id", "file_hash")
        known.merge(stored, batch_id, lambda old, new: old.unionByName(new))
    return (documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def dedupe_stream(events: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First row per key; a key is remembered until the watermark passes its row by `delay`."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_rates(events: DataFrame, key: str, ts: str, width: str = "1 minute", slide: str | None = None,
                   delay: str = "10 minutes") -> DataFrame:
    """Requests per key and fixed or sliding window; rows later than `delay` are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (events.withWatermark(ts, delay).groupBy(window.alias("w"), key).agg(F.count("*").alias("requests"))
            .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests"))


class _Window(StatefulProcessor):
    """Per-key state (window start in micros, count). A timer drops it once the window has run out."""

    def __init__(self, width: int, closed: bool) -> None:
        self.width, self.closed = width, closed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "start bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        start, n = (held[0], held[1]) if held is not None else (None, 0)
        opened, starts, counts = start, [], []
        for t in batch["t"]:
            gone = start is None or (t - start > self.width if self.closed else t - start >= self.width)
            start, n = (int(t), 1) if gone else (start, n + 1)
            starts.append(start)
            counts.append(n)
        self.state.update((start, n))
        if start != opened:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((start + self.width) // 1000 + 1)
        yield pd.DataFrame({"id": batch["id"].to_numpy(), "key": batch["key"].to_numpy(), "t": batch["t"].to_numpy(),
                            "start": starts, "n": counts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Rows of a piece of buffered state, and of a piece of output.
PIECE = 4096


class _OrderedWindow(StatefulProcessor):
    """_Window for rows in any order, which wait until the watermark has passed the time bucket they fall in; buckets are
    released in order, each sorted by itself. Up to PIECE rows of a key wait as one value, read and written once
    a batch, with one timer. Beyond that they wait in pieces of at most PIECE by bucket: a row costs one write
    and one read of state, and memory is bounded by a key's rows of one bucket, however many wait."""

    def __init__(self, width: int, closed: bool, bucket: int, id_type: str) -> None:
        self.width, self.closed, self.bucket, self.id_type = width, closed, bucket, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, n bigint")
        self.few = handle.getValueState("few", f"t array<bigint>, id array<{self.id_type}>, many boolean")
        self.counts = handle.getMapState("buckets", "b bigint", "n int")
        self.pieces = handle.getMapState("pieces", "b bigint, i int", f"t array<bigint>, id array<{self.id_type}>")

    def _wake(self, t: int) -> None:
        """A timer for the end of a time's bucket."""
        self.handle.registerTimer((t // self.bucket + 1) * self.bucket // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.few.get() if self.few.exists() else ([], [], False)
        many, times, ids = held[2], list(held[0]), list(held[1])
        first = min(times, default=None)
        for part in rows:
            if not many and len(times) + len(part) <= PIECE:
                times += part["t"].tolist()
                ids += part["id"].tolist()
                continue
            if times:
                self._put(pd.DataFrame({"t": times, "id": ids}))
                times, ids = [], []
            many = True
            self._put(part)
        if times and (first is None or min(times) // self.bucket < first // self.bucket):
            self._wake(min(times))
        if not (many and held[2]):
            self.few.update((times, ids, many))
        return iter(())

    def _put(self, rows: pd.DataFrame) -> None:
        for b, same in rows.groupby(rows["t"] // self.bucket):
            b = int(b)
            held = self.counts.getValue((b,))
            n = held[0] if held else 0
            if not n:
                self._wake(b * self.bucket)
            for at in range(0, len(same), PIECE):
                piece = same.iloc[at:at + PIECE]
                self.pieces.updateValue((b, n), (piece["t"].tolist(), piece["id"].tolist()))
                n += 1
            self.counts.updateValue((b,), (n,))

    def _ready(self, passed: int) -> Iterator[list[tuple]]:
        """The sorted rows of each bucket that has passed, in order, taken out of the state."""
        held = self.few.get() if self.few.exists() else ([], [], False)
        if not held[2]:
            rows = sorted(zip(held[0], held[1]))
            done = [r for r in rows if (r[0] // self.bucket + 1) * self.bucket <= passed]
            self.waits = len(done) < len(rows)
            if done:
                rest = rows[len(done):]
                if rest:
                    self.few.update(([t for t, _ in rest], [i for _, i in rest], False))
                    self._wake(rest[0][0])
                else:
                    self.few.clear()
                yield done
            return
        waiting = sorted(b for (b,) in self.counts.keys())
        ready = [b for b in waiting if (b + 1) * self.bucket <= passed]
        self.waits = len(ready) < len(waiting)
        for b in ready:
            rows = []
            for i in range(self.counts.getValue((b,))[0]):
                piece = self.pieces.getValue((b, i))
                rows += zip(piece[0], piece[1])
                self.pieces.removeKey((b, i))
            self.counts.removeKey((b,))
            yield sorted(rows)
        if not self.waits:
            self.few.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.window.get() if self.window.exists() else None
        start, n = (held[0], held[1]) if held is not None else (None, 0)
        opened = start
        for rows in self._ready(passed):
            for at in range(0, len(rows), PIECE):
                starts, counts, part = [], [], rows[at:at + PIECE]
                for t, _ in part:
                    gone = start is None or (t - start > self.width if self.closed else t - start >= self.width)
                    start, n = (t, 1) if gone else (start, n + 1)
                    starts.append(start)
                    counts.append(n)
                yield pd.DataFrame({"id": [i for _, i in part], "key": [key[0]] * len(part), "t": [t for t, _ in part],
                                    "start": starts, "n": counts})
        if start is not None and start + self.width < passed and not self.waits:
            if held is not None:
                self.window.clear()  # the window has run out and nothing waits
        elif start is not None:
            self.window.update((start, n))
            if start != opened:
                self.handle.registerTimer((start + self.width) // 1000 + 1)

    def close(self) -> None:
        pass


def _windows(events: DataFrame, key: str, ts: str, id_col: str, seconds: int, closed: bool, delay: str,
             reorder: bool = False, bucket_seconds: int = 60) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.col(ts).cast("timestamp")
    rows = events.select(at.alias("ts"), F.col(id_col).alias("id"), F.col(key).alias("key"),
                         F.unix_micros(at).alias("t")).withWatermark("ts", delay)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "key")}
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=(_OrderedWindow(seconds * 1_000_000, closed, bucket_seconds * 1_000_000, kinds["id"]) if reorder
                           else _Window(seconds * 1_000_000, closed)),
        outputStructType=f"id {kinds['id']}, key {kinds['key']}, t bigint, start bigint, n bigint",
        outputMode="append", timeMode="EventTime")


def quota_stream(events: DataFrame, key: str, ts: str, id_col: str, window_seconds: int = 24 * 3600, limit: int = 50,
                 delay: str = "1 hour", reorder: bool = False, bucket_seconds: int = 60) -> DataFrame:
    """anchored_quota over a stream. As it is, rows are counted as they arrive, which must be in order of time per key;
    reorder takes rows up to `delay` late in any order and gives each when the watermark has passed it."""
    counted = _windows(events, key, ts, id_col, window_seconds, True, delay, reorder, bucket_seconds)
    return counted.select(F.col("id").alias(id_col), F.col("key").alias(key), F.timestamp_micros("t").alias(ts),
                          F.col("n").alias("requests"), F.timestamp_micros("start").alias("window_start"),
                          F.greatest(F.lit(0), F.lit(limit) - F.col("n")).alias("remaining"),
                          (F.col("n") <= limit).alias("allowed"))


def cache_stream(queries: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: int = 24 * 3600,
                 delay: str = "1 hour", reorder: bool = False, bucket_seconds: int = 60) -> DataFrame:
    """Whether an answer of the same hash was stored less than the time to live before; a miss stores
    one. At exactly the time to live the entry is gone. reorder: see quota_stream."""
    counted = _windows(queries, key, ts, id_col, ttl_seconds, False, delay, reorder, bucket_seconds)
    return counted.select(F.col("id").alias(id_col), F.col("key").alias(key),
                          F.when(F.col("n") == 1, "miss").otherwise("exact").alias("hit_kind"),
                          F.timestamp_micros("start").alias("stored_at"))


def candidate_table(root: str, id_type: str, buckets: int = 256) -> BucketedTable:
    return BucketedTable(root, ["term_normalized", "document_id"], N.EMPTY_CANDIDATES.format(id=id_type), buckets)


def stream_candidates(documents: DataFrame, root: str, checkpoint: str, as_of, buckets: int = 256,
                      mine: Callable[[DataFrame], DataFrame] = N.mine_candidates, **trigger) -> StreamingQuery:
    """documents(doc_id, text): keeps term candidates in the bucketed table candidate_table(root, ..), a version a
    batch; a batch rewrites the buckets of its own terms and documents. mine says which candidates."""
    candidates = candidate_table(root, documents.schema["doc_id"].dataType.simpleString(), buckets)

    def run(batch: DataFrame, batch_id: int) -> None:
        new = materialize(mine(batch))
        candidates.merge(new, batch_id, lambda old, rows: N.upsert_candidates(old, rows, as_of), ["term_normalized", "doc_id"])
    return (documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def cache_table(root: str, buckets: int = 256) -> BucketedTable:
    return BucketedTable(root, ["hash"], "id string, hash string, text string, emb array<float>, answer string, confidence double, "
                         "hit_count int, created_at timestamp, expires_at timestamp", buckets)


def stream_cache_entries(entries: DataFrame, root: str, checkpoint: str, as_of, buckets: int = 256, **trigger) -> StreamingQuery:
    """upsert_cache over a stream of entries(hash, text, emb, answer, confidence, verified, seq), kept in the bucketed
    table cache_table(root)."""
    cache = cache_table(root, buckets)

    def run(batch: DataFrame, batch_id: int) -> None:
        cache.merge(batch, batch_id, lambda old, rows: K.upsert_cache(old, rows, as_of))
    return (entries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_retrieval(queries: DataFrame, chunks: DataFrame, documents: DataFrame, root: str, checkpoint: str,
                     trigger: dict | None = None, **search) -> StreamingQuery:
    """Query stream (qid, text, emb) against a snapshot of chunks; hits are written per batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        R.hybrid_search(batch, chunks, documents, **search).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return (queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def write_stream(df: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (df.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())
