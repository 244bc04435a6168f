"""Best-fit packing with certified repacking. Documents become token pieces of at most one sequence.
Groups of pieces are packed best-fit decreasing; dual feasible functions give each group a lower bound on its
sequences, and a group that meets it is certified and keeps its sequences. The others put the documents of
their loose sequences together, deal them anew and pack them again. Bounds of groups may add up to more than
that of the whole table; while the total is above the latter, a last exchange opens the loose sequences
of certified groups too."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from quillspark.llm.tokens import ByteLevel
from quillspark.session import arrow_batches, materialize

CAPACITY, END = 2048, 0
#: Pieces of a group: what one task packs at a time.
GROUP = 8192
#: Sequences filled to this share take no part in an exchange.
TIGHT, ROUNDS = 0.995, 4


def encoder(path: str) -> ByteLevel:
    """The ids of the tokenizer file, for one task."""
    return ByteLevel(path)


#: Bytes of ids that a task gathers before it hands pieces on.
FLUSH = 1 << 21


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of docs(doc_id, text): piece (from 0), start, length, and ids, unsigned 32-bit
    little-endian, or else their crc32 as ids_crc32. A document is its ids and a closing END; only one of more than
    capacity ids is cut, so that every piece but the first is full. A null or empty text is END alone. Repeated rows
    give repeated pieces; other columns are ignored."""
    data_field = StructField("ids", BinaryType()) if with_ids else StructField("ids_crc32", LongType())
    schema = StructType([docs.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()),
                         StructField("length", LongType()), data_field])
    names = schema.names
    kind = pa.binary() if with_ids else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for at, text in enumerate(batch.column(1)):
                ids = np.append(encode.ids(text.as_py() or ""), END).astype("<u4")
                edge = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
                for k, (lo, hi) in enumerate([(0, edge), *((x, x + capacity) for x in range(edge, len(ids), capacity))]):
                    data = ids[lo:hi].tobytes()
                    rows.append((at, k, lo, hi - lo, data if with_ids else zlib.crc32(data)))
                held += ids.nbytes
                if held > FLUSH:
                    yield batch_of(batch, rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(batch, rows)

    def batch_of(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        row, piece, start, length, data = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(data, kind)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def lower_bound(counts: np.ndarray) -> int:
    """Fewest bins that any packing of counts[w] items of size w needs, by two families of dual
    feasible functions. The capacity is len(counts) - 1."""
    capacity = len(counts) - 1
    w = np.arange(capacity + 1)
    best = -(-int((w * counts).sum()) // capacity)
    for k in range(1, 33):
        scaled = np.where((k + 1) * w % capacity == 0, k * w, (k + 1) * w // capacity * capacity)
        best = max(best, -(-int((scaled * counts).sum()) // (k * capacity)))
    many, mass = np.cumsum(counts[::-1])[::-1], np.cumsum((w * counts)[::-1])[::-1]
    for e in np.flatnonzero(counts[:capacity // 2 + 1]):
        e = max(int(e), 1)
        large = many[capacity - e + 1]
        middle = mass[e] - mass[capacity - e + 1]
        best = max(best, int(large) + -(-int(middle) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every item, and the fill of every bin."""
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin has exactly r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            open_by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _pack_groups(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """One round: deal the pieces into groups by a hash of _number, which no two rows share, so that every
    group has about as many; pack each. Adds sequence_id, offset, fill, and certified: whether the group has as few
    sequences as its own lower bound."""
    drop = {"sequence_id", "offset", "fill", "certified", "_group"}
    base = pieces.drop(*[c for c in pieces.columns if c in drop])
    schema = StructType(base.schema.fields + [StructField(c, LongType()) for c in ("sequence_id", "offset", "fill")]
                        + [StructField("certified", BooleanType())])
    names = schema.names

    def run(table: pa.Table) -> pa.Table:
        lengths, group = table["length"].to_numpy(), table["_group"][0].as_py()
        bins, offsets, fill = best_fit(lengths, capacity)
        certified = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1))
        new = [(turn << 56) | (group << 20) | bins, offsets, fill[bins], np.full(len(lengths), certified)]
        return pa.Table.from_arrays([*(table[c] for c in names[:-4]), *(pa.array(x) for x in new)], names=names)

    group = F.pmod(F.xxhash64("_number", F.lit(turn)), F.lit(groups))
    return base.withColumn("_group", group).groupBy("_group").applyInArrow(run, schema)


def histogram(pieces: DataFrame, capacity: int) -> np.ndarray:
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    return counts


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to pieces(length, ...), each of length 1 to capacity; every
    sequence is filled from 0 without gaps. Full pieces are sequences of their own. Rounds end when
    the total meets the lower bound, when the last exchange (see above) is done, or after the given number. Rows
    are packed each by itself, repeated ones too; an empty table gives an empty one. Other columns are kept; those named
    sequence_id, offset, fill or certified are replaced. The pieces are
    numbered and written once to the checkpoint folder, so that a row keeps its number."""
    pieces = pieces.drop("sequence_id", "offset", "fill", "certified")
    with arrow_batches(pieces.sparkSession):
        pieces = materialize(pieces.withColumn("_number", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity)
    done = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    counts = histogram(rest, capacity)
    bound, n = lower_bound(counts), int(counts.sum())
    parts = [done]
    if n:
        now = materialize(_pack_groups(rest, -(-n // group), 0, capacity))
        total, aside = _sequences(now), []
        tight = F.col("fill") >= int(TIGHT * capacity)
        for turn in range(1, rounds):
            if total <= bound:
                break
            loose = now.where(~tight & ~F.col("certified"))
            last = turn == rounds - 1 or loose.isEmpty()
            if last:  # certified groups open too
                for part in [now.where(~tight & F.col("certified")), *aside]:
                    loose = loose.unionByName(part)
            size, before = loose.count(), _sequences(loose)
            if before <= 1:
                break
            again = materialize(_pack_groups(loose, -(-size // group), turn, capacity))
            after = _sequences(again)
            if after >= before:
                if last:
                    break
                continue
            parts.append(now.where(tight))
            if last:
                aside = []
            else:
                aside.append(now.where(~tight & F.col("certified")))
            now, total = again, total - before + after
            if last:
                break
        parts += [now, *aside]
        parts = [parts[0], *(p.drop("fill", "certified") for p in parts[1:])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("_number")


def _sequences(packed: DataFrame) -> int:
    """Every sequence has exactly one piece at offset 0."""
    return packed.where(F.col("offset") == 0).count()


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, the number of ids and the ids in order. packed
    must carry ids; a sequence has at most capacity pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ids"),
                    F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids")))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed pieces of docs with the checksum of their ids instead of the ids. The pieces are
    written once to the checkpoint folder, without ids."""
    pieces = token_pieces(docs, tokenizer_path, capacity, with_ids=False)
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
