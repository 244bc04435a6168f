"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

Both token sequences of a text cover the same bytes, and places where tokens of both end cut them into
groups. The tokens that end within a range of bytes are a fragment: an open prefix (up to its first common
end, a group that may have begun before), closed groups, and an open suffix; without a common end it is one
open piece. Joining two neighbours closes the group at their seam, and the joining is associative. Texts of
up to CHUNK bytes are one fragment of one task; longer ones become a fragment for each CHUNK bytes, in
tasks of their own, and a tree of joins puts them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillspark.llm.tokens import ByteLevel, Pieces
from quillspark.session import materialize

#: Bytes of a fragment of a long text, and how many fragments a join takes.
CHUNK, FAN = 1 << 16, 16
#: Pairs of ids that may be broadcast (at 12 to 16 bytes), and the share of all links, one in so many, from which a
#: pair counts as frequent beyond that.
MAX_PAIRS, FREQUENT = 2_000_000, 1000
#: Bytes of rows that a task gathers before it hands them on.
FLUSH = 1 << 21
_NONE = np.zeros(0, np.int64)


@dataclass
class Open:
    """Tokens of a group that is not closed on both sides: ids and end offsets of both sides."""

    a: np.ndarray = field(default_factory=lambda: _NONE)
    a_ends: np.ndarray = field(default_factory=lambda: _NONE)
    b: np.ndarray = field(default_factory=lambda: _NONE)
    b_ends: np.ndarray = field(default_factory=lambda: _NONE)

    def __add__(self, other: "Open") -> "Open":
        return Open(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("a", "a_ends", "b", "b_ends")))

    def cut(self, a: slice, b: slice) -> "Open":
        return Open(self.a[a], self.a_ends[a], self.b[b], self.b_ends[b])

    @property
    def empty(self) -> bool:
        return not len(self.a) and not len(self.b)


def ends_of(tokens: Open) -> tuple[np.ndarray, np.ndarray]:
    """All ends of both sides, and the common ones, in order."""
    both = np.concatenate([tokens.a_ends, tokens.b_ends])
    both.sort(kind="stable")  # a merge of two runs
    again = both[1:] == both[:-1]
    return both[np.concatenate([[True], ~again])] if len(both) else both, both[1:][again]


def links(tokens: Open, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that share bytes, of whole groups: each stretch between neighbouring ends of either
    side lies in one token of each, and a pair's common bytes are one stretch."""
    return tokens.a[np.searchsorted(tokens.a_ends, ends)], tokens.b[np.searchsorted(tokens.b_ends, ends)]


class Names:
    """Decimal ids followed by what stands after them: a comma, a bar or a semicolon. A pair of ids has the key
    a * size + b."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.key_type = "<u4" if size <= 1 << 16 else "<u8"
        strings = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(size)])
        self.letters = strings.view(np.uint8).reshape(len(strings), -1)
        self.used = self.letters > 0

    def groups(self, tokens: Open, common: np.ndarray) -> bytes:
        """`a1,a2|b1;...;` of whole groups that end at the common ends."""
        last_a, last_b = np.searchsorted(tokens.a_ends, common), np.searchsorted(tokens.b_ends, common)
        mark_a, mark_b = np.zeros(len(tokens.a), np.int64), np.zeros(len(tokens.b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(mark_a) - mark_a, np.cumsum(mark_b) - mark_b
        before_a = np.concatenate([[0], last_b + 1])[group_a]  # b tokens in earlier groups
        before_b = (last_a + 1)[group_b] if len(last_a) else group_b  # a tokens up to this group
        out = np.empty(len(tokens.a) + len(tokens.b), np.int64)
        out[np.arange(len(tokens.a)) + before_a] = tokens.a + self.size * mark_a
        out[np.arange(len(tokens.b)) + before_b] = tokens.b + 2 * self.size * mark_b
        return self.letters[out][self.used[out]].tobytes()


@lru_cache(1)
def names_of(size: int) -> Names:
    return Names(size)


@dataclass
class Fragment:
    prefix: Open
    suffix: Open
    cut: bool            # whether there is a common end
    n_groups: int = 0    # closed ones
    n_links: int = 0     # in closed groups
    groups: bytes = b""  # of closed groups
    pairs: tuple = ()    # keys and counts of the links in closed groups


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their numbers."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def whole(tokens: Open, names: Names) -> Fragment:
    """The fragment of tokens that begin and end with whole groups: nothing is open."""
    ends, common = ends_of(tokens)
    a, b = links(tokens, ends)
    return Fragment(Open(), Open(), True, len(common), len(a), names.groups(tokens, common), counted(a * names.size + b))


def fragment(tokens: Open, names: Names) -> Fragment:
    """The fragment of the tokens that end within some range of bytes."""
    _, common = ends_of(tokens)
    if not len(common):
        return Fragment(tokens, Open(), False)
    first, last = ((int(np.searchsorted(tokens.a_ends, e, "right")), int(np.searchsorted(tokens.b_ends, e, "right")))
                   for e in (common[0], common[-1]))
    inside = whole(tokens.cut(slice(first[0], last[0]), slice(first[1], last[1])), names)
    inside.prefix = tokens.cut(slice(0, first[0]), slice(0, first[1]))
    inside.suffix = tokens.cut(slice(last[0], None), slice(last[1], None))
    return inside


def join(parts: list[Fragment], names: Names) -> Fragment:
    """Neighbouring fragments in order as one. Joining is associative, so any tree of joins gives the same."""
    cuts = [i for i, p in enumerate(parts) if p.cut]
    if not cuts:
        return Fragment(sum((p.prefix for p in parts), Open()), Open(), False)
    lead = sum((p.prefix for p in parts[:cuts[0] + 1]), Open())
    closed, seam = [], Open()
    for p in parts[cuts[0]:]:
        if p.cut and closed:
            group = seam + p.prefix
            if not group.empty:
                closed.append(whole(group, names))
        elif not p.cut:
            seam = seam + p.prefix
        if p.cut:
            closed.append(p)
            seam = p.suffix
    keys = np.concatenate([p.pairs[0] for p in closed if len(p.pairs)] or [_NONE])
    counts = np.concatenate([p.pairs[1] for p in closed if len(p.pairs)] or [_NONE])
    return Fragment(lead, seam, True, sum(p.n_groups for p in closed), sum(p.n_links for p in closed),
                    b"".join(p.groups for p in closed), counted(keys, counts))


def finished(part: Fragment, names: Names) -> Fragment:
    """The fragment of a whole text: its prefix begins with the text and is a whole group; its suffix is empty."""
    if part.prefix.empty:
        return part
    return join([whole(part.prefix, names), replace(part, prefix=Open())], names)


class Encoder:
    """Both token sequences of a text, with their bytes."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.sides = ByteLevel(byte_path, plain=True), Pieces(piece_path)
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in self.sides]
        self.data = [np.frombuffer(b"".join(t.bytes), np.uint8) for t in self.sides]
        self.starts = [np.cumsum(n) - n for n in self.sizes]
        self.names = names_of(max(len(t.bytes) for t in self.sides))

    def tokens(self, text: str | None) -> Open | None:
        """None for texts without tokens: null, empty, or not given back by both."""
        if not text:
            return None
        want = np.frombuffer(b" " + text.encode(), np.uint8)
        out = []
        for side, given in enumerate((" " + text, text)):
            ids = self.sides[side].ids(given).astype(np.int64)
            sizes = self.sizes[side][ids]
            ends = np.cumsum(sizes)
            if ends[-1] != len(want):
                return None
            # Byte k of the text is the byte of its token that stands as far in.
            at = np.arange(len(want)) + np.repeat(self.starts[side][ids] - ends + sizes, sizes)
            if not np.array_equal(self.data[side][at], want):
                return None
            out += [ids, ends]
        return Open(*out)


def vocabulary(byte_path: str, piece_path: str) -> int:
    """Size of the larger vocabulary, by which pairs are keyed."""
    return Encoder(byte_path, piece_path).names.size


_SIDES = ("a", "a_ends", "b", "b_ends")
_DONE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, keys binary, counts binary"
_FRAGMENT = ("cut boolean, n_groups long, n_links long, groups binary, keys binary, counts binary, "
             + ", ".join(f"{side}_{k} binary" for side in ("prefix", "suffix") for k in _SIDES))


def _row(part: Fragment, names: Names) -> tuple:
    keys, counts = part.pairs if len(part.pairs) else (_NONE, _NONE)
    return (part.cut, part.n_groups, part.n_links, part.groups, keys.astype(names.key_type).tobytes(), counts.astype("<u4").tobytes(),
            *(getattr(side, k).astype("<u4").tobytes() for side in (part.prefix, part.suffix) for k in _SIDES))


def _read(row: tuple, names: Names) -> Fragment:
    cut, n_groups, n_links, groups, keys, *rest = row
    counts, *ends = (np.frombuffer(x, "<u4").astype(np.int64) for x in rest)
    return Fragment(Open(*ends[:4]), Open(*ends[4:]), cut, n_groups, n_links, groups,
                    (np.frombuffer(keys, names.key_type).astype(np.int64), counts))


def _done(n_a: int, n_b: int, part: Fragment, names: Names, keep: bool) -> tuple:
    keys, counts = part.pairs
    groups = part.groups[:-1]
    return (n_a, n_b, part.n_groups, part.n_links, hashlib.sha256(groups).hexdigest(), groups.decode() if keep else None,
            keys.astype(names.key_type).tobytes(), counts.astype("<u4").tobytes())


_EMPTY = (0, 0, 0, 0, "", "", b"", b"")


def alignments(docs: DataFrame, byte_path: str, piece_path: str, groups: bool = True, chunk: int = CHUNK,
               fan: int = FAN) -> DataFrame:
    """A row for each row of docs(doc_id, text): n_a and n_b (tokens), n_groups, n_links, groups_sha256, groups
    (`a1,a2|b1;a3|b2,b3`; null unless asked for), and the distinct linked pairs as keys and counts (little-endian; a
    pair's key is a * size + b, see Names). Written once to the checkpoint folder.

    Texts that are null, empty or not given back by both tokenizers have no tokens: zeros and ''. Repeated rows
    count each, ids play no part, other columns are ignored, an empty table gives no row. Only what a result
    row itself holds (the groups and pairs of one text) is ever in one task."""
    size = vocabulary(byte_path, piece_path)
    number = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {doc_id}, row long, {_DONE}, at long, size_a long, size_b long, "
                                + ", ".join(f"{k} binary" for k in _SIDES))
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(byte_path, piece_path)
        for batch in batches:
            out, held = [], 0
            for doc, text, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                tokens = encoder.tokens(text.as_py())
                if tokens is None:
                    out.append((doc, row, *_EMPTY, *[None] * 7))
                    continue
                n_a, n_b, end = len(tokens.a), len(tokens.b), int(tokens.a_ends[-1])
                if end <= chunk:
                    out.append((doc, row, *_done(n_a, n_b, whole(tokens, encoder.names), encoder.names, groups), *[None] * 7))
                    held += 5 * end
                else:  # tokens go to the range of bytes that they end in
                    edges = np.arange(0, end + chunk, chunk)
                    cuts = [np.searchsorted(x, edges, "right") for x in (tokens.a_ends, tokens.b_ends)]
                    for k in range(len(edges) - 1):
                        part = tokens.cut(*(slice(c[k], c[k + 1]) for c in cuts))
                        if not part.empty:
                            out.append((doc, row, *[None] * 8, k, n_a, n_b,
                                        *(getattr(part, s).astype("<u4").tobytes() for s in _SIDES)))
                    held += 8 * (n_a + n_b)
                if held > FLUSH:
                    yield batch_of(out, arrow)
                    out, held = [], 0
            if out:
                yield batch_of(out, arrow)

    written = materialize(number.mapInArrow(tokenise, schema))
    short = written.where("at IS NULL").select("doc_id", "row", *[f.name for f in StructType.fromDDL(_DONE)])
    top = written.agg(F.max("at")).first()[0]
    if top is None:
        return short

    part_schema = StructType.fromDDL(f"doc_id {doc_id}, row long, at long, size_a long, size_b long, {_FRAGMENT}")
    part_arrow = to_arrow_schema(part_schema)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = names_of(size)
        for batch in batches:
            for doc, row, at, size_a, size_b, *data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = Open(*(np.frombuffer(x, "<u4").astype(np.int64) for x in data))
                yield batch_of([(doc, row, at, size_a, size_b, *_row(fragment(tokens, names), names))], part_arrow)

    def joined(table: pa.Table) -> pa.Table:
        names = names_of(size)
        rows = list(zip(*(c.to_pylist() for c in table.sort_by("at").columns)))
        part = join([_read(r[5:], names) for r in rows], names)
        return pa.Table.from_batches([batch_of([(*rows[0][:2], rows[0][2] // fan, *rows[0][3:5], *_row(part, names))], part_arrow)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = names_of(size)
        for batch in batches:
            for doc, row, _, size_a, size_b, *data in zip(*(c.to_pylist() for c in batch.columns)):
                part = finished(_read(tuple(data), names), names)
                yield batch_of([(doc, row, *_done(size_a, size_b, part, names, groups))], short_arrow)

    short_arrow = to_arrow_schema(short.schema)
    tree = written.where("at IS NOT NULL").repartition("row", "at").select(
        "doc_id", "row", "at", "size_a", "size_b", *_SIDES).mapInArrow(fragments, part_schema)
    while top > 0:
        tree = tree.groupBy("row", F.floor(F.col("at") / fan)).applyInArrow(joined, part_schema)
        top //= fan
    return short.unionByName(materialize(tree.mapInArrow(finish, short.schema)))


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """How many links of all texts hold each pair: key, n, and best (whether no pair with the same b has more).
    Pairs are summed within tasks before they move; a b has at most size partners."""
    key_type = "<u4" if size <= 1 << 16 else "<u8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            keys += [np.frombuffer(x.as_py(), key_type).astype(np.int64) for x in batch.column(0)]
            counts += [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in batch.column(1)]
            held = sum(map(len, keys))
            if held > 1 << 21:
                total = counted(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [total[0]], [total[1]]
                if len(total[0]) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["key", "n"])
                    keys, counts = [], []
        if keys:
            total = counted(np.concatenate(keys), np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["key", "n"])

    sums = (aligned.select("keys", "counts").mapInArrow(run, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")))
    most = F.max("n").over(W.partitionBy(F.col("key") % size))
    return sums.select("key", "n", (F.col("n") == most).alias("best"))


def _lookup(aligned: DataFrame, pairs: pa.Table, size: int) -> DataFrame:
    """row, n_best and count_sum over the links of the given pairs."""
    key_type = "<u4" if size <= 1 << 16 else "<u8"
    keys, n, best = (pairs[c].to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(keys)
    shared = aligned.sparkSession.sparkContext.broadcast((keys[order], n[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            sums = []
            for keys, counts in zip(batch.column(1), batch.column(2)):
                keys = np.frombuffer(keys.as_py(), key_type).astype(np.int64)
                counts = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                at, counts = at[found], counts[found]
                sums.append((int(counts[best[at]].sum()), int((counts * n[at]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*sums))] if sums else [
                batch.column(0), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["row", "n_best", "count_sum"])

    return aligned.select("row", "keys", "counts").mapInArrow(run, "row long, n_best long, count_sum long")


def with_pair_counts(aligned: DataFrame, size: int, max_pairs: int = MAX_PAIRS, frequent: int = FREQUENT) -> DataFrame:
    """Adds to the rows of alignments n_best (links whose pair is its b's most counted, ties included) and count_sum
    (the counts of all links' pairs). The counts are broadcast if there are at most max_pairs; beyond it
    only the frequent pairs are (at most `frequent` by their definition), and all others meet by shuffle,
    none of them in more than one of `frequent` of all links."""
    key_type = "<u4" if size <= 1 << 16 else "<u8"
    pairs = materialize(pair_counts(aligned, size))
    n, total = pairs.agg(F.count("*"), F.sum("n")).first()
    if n <= max_pairs:
        sums = _lookup(aligned, pairs.toArrow(), size)
    else:
        often = pairs.where(F.col("n") * frequent >= total)
        few = often.toArrow()
        skip = few["key"].to_numpy()

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    keys = np.frombuffer(keys.as_py(), key_type).astype(np.int64)
                    rest = ~np.isin(keys, skip)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(rest.sum()), row)), pa.array(keys[rest]),
                         pa.array(np.frombuffer(counts.as_py(), "<u4").astype(np.int64)[rest])], names=["row", "key", "c"])

        met = aligned.select("row", "keys", "counts").mapInArrow(others, "row long, key long, c long").join(pairs, "key")
        met = met.select("row", F.when(F.col("best"), F.col("c")).otherwise(0).alias("n_best"),
                         (F.col("c") * F.col("n")).alias("count_sum"))
        sums = (met.unionByName(_lookup(aligned, few, size)).groupBy("row")
                .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return aligned.join(sums, "row")


def token_alignment(docs: DataFrame, byte_path: str, piece_path: str, chunk: int = CHUNK, fan: int = FAN,
                    max_pairs: int = MAX_PAIRS) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. See
    alignments for odd input."""
    aligned = alignments(docs, byte_path, piece_path, False, chunk, fan)
    return with_pair_counts(aligned, vocabulary(byte_path, piece_path), max_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
