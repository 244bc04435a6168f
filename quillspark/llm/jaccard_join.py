"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes its links form.

Shingles are ordered by how often the corpus has them, rare ones first. Two sets that are similar
enough share shingles at the head of that order; a prefix that is longer by k - 1 shingles must share
k of them. Every document picks its k by estimated cost, a pair needs the smaller of its two. Equal
sets are one node. As only classes are asked for, pairs that earlier links already connect are
not compared again: first every document meets one leading document of its lists, then what is
left over is compared in full, so that no link between two classes is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from quillspark.llm.common import map_blocks, small, without
from quillspark.llm.components import components
from quillspark.llm.rolling import LOWER, SPACE, Block, blocks, grams, mix
from quillspark.session import arrow_batches, materialize

SHINGLE, PERCENT = 3, 90
#: Size of the frequency sketch in bits, counters of a row of it, and the largest k.
SKETCH_BITS, SKETCH_ROW, MOST = 21, 1 << 13, 4
#: List entries of a set that its rows carry into the full comparison.
HEAD = 16
#: Cost of a comparison against that of a list entry, per shingle.
VERIFY = 0.25


def shingle_sets(block: Block, n: int) -> Iterator[np.ndarray]:
    """The set of each text, as sorted hashes. A text of fewer than n words is one shingle."""
    starts, ends, bounds = block.words(~SPACE)
    words = block.prefix(LOWER[block.data]).hash(starts, ends)
    values, first = grams(words, bounds, n)
    for i in range(block.n):
        w = bounds[i + 1] - bounds[i]
        if w >= n:
            yield np.unique(values[first[i]:first[i + 1]])
        elif w:
            head = words[bounds[i]:bounds[i] + 1]
            for k in range(1, w):
                head = mix(head * np.uint64(3) + words[bounds[i] + k:bounds[i] + k + 1])
            yield mix(head + np.uint64(w))
        else:
            yield values[:0]


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass: a row for each document with the size and digest of its set, and for each task rows of
    counters (part, task, counts): how many documents have a shingle of each hash bucket."""
    schema = StructType([docs.schema["doc_id"], StructField("n", LongType()), StructField("d1", LongType()),
                         StructField("d2", LongType()), StructField("part", IntegerType()), StructField("task", IntegerType()),
                         StructField("counts", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        seen = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = list(shingle_sets(block, n))
                every = np.concatenate(sets)
                seen += np.bincount(_bucket(every), minlength=len(seen)).astype(np.int32)
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                digests = []
                for salt in (1, 2):
                    sums = np.zeros(len(every) + 1, np.uint64)
                    np.cumsum(mix(every + np.uint64(salt)), out=sums[1:])
                    digests.append((sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
                empty = pa.nulls(block.n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), pa.array(np.diff(edges)), *(pa.array(d) for d in digests),
                     empty, empty, pa.nulls(block.n, pa.binary())], schema=arrow)
        if seen.any():
            rows = len(seen) // SKETCH_ROW
            data = [x.astype("<u2").tobytes() for x in np.minimum(seen, 65535).reshape(rows, SKETCH_ROW)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, arrow.field(0).type), *(pa.nulls(rows, pa.int64()) for _ in range(3)),
                 pa.array(range(rows), pa.int32()), pa.array([TaskContext.get().partitionId()] * rows, pa.int32()),
                 pa.array(data, pa.binary())], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def frequencies(surveyed: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, in two steps so that no group holds a row of every task.
    The result has a fixed size (2^SKETCH_BITS counters), whatever the corpus."""
    def add(dtype: str):
        def run(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), dtype).astype(np.int64) for x in table["counts"])
            return pa.table({"part": table["part"][:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})
        return run

    rows = surveyed.where(F.col("part").isNotNull()).select("part", F.pmod("task", F.lit(64)).alias("salt"), "counts")
    once = rows.groupBy("part", "salt").applyInArrow(add("<u2"), "part int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in once.groupBy("part").applyInArrow(add("<i8"), "part int, counts binary").toLocalIterator():
        out[r["part"] * SKETCH_ROW:(r["part"] + 1) * SKETCH_ROW] = np.frombuffer(r["counts"], "<i8")
    return out


def prefix(values: np.ndarray, counts: np.ndarray, floor: float, percent: int) -> tuple[np.ndarray, int]:
    """A document's shingles at the head of the common order (rare first, then by hash), and its k."""
    heavy = counts[_bucket(values)]
    order = np.lexsort((values, heavy))
    size = len(values)
    base = size - -(-percent * size // 100)  # a partner shares at least percent of the larger set
    others = np.cumsum(np.maximum(heavy[order] - floor, 0.0))
    best, k = None, 1
    for tried in range(1, min(MOST, size - base) + 1):
        postings = others[base + tried - 1]
        cost = postings * (1 + VERIFY * size / tried)
        if best is None or cost < best:
            best, k = cost, tried
    return values[order[:base + k]], k


def postings(docs: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """token, doc_id, size, place (in the order) and k for every prefix shingle."""
    schema = StructType([StructField("token", LongType()), docs.schema["doc_id"], StructField("size", IntegerType()),
                         StructField("place", IntegerType()), StructField("k", IntegerType())])
    mean = counts.mean()
    floor = float(mean + 3 * np.sqrt(mean) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                tokens, rows, sizes, places, ks = [], [], [], [], []
                for i, values in enumerate(shingle_sets(block, n)):
                    if len(values):
                        head, k = prefix(values, shared.value, floor, percent)
                        tokens.append(head)
                        rows.append(np.full(len(head), block.first + i))
                        sizes.append(np.full(len(head), len(values), np.int32))
                        places.append(np.arange(len(head), dtype=np.int32))
                        ks.append(np.full(len(head), k, np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows))),
                         *(pa.array(np.concatenate(x)) for x in (sizes, places, ks))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _share(size: Column, percent: int) -> Column:
    """Least number of shingles that a document shares with a partner."""
    return F.floor((percent * size + 99) / 100).cast("int")


def _least(both: Column, percent: int) -> Column:
    """Least intersection of two similar enough sets of so many shingles together."""
    return F.floor((percent * both + 99 + percent) / (100 + percent)).cast("int")


def _need(x: str, y: str, percent: int) -> Column:
    """Least intersection of two similar enough sets, by the prefixes of their columns."""
    return _least(F.col(f"{x}size") + F.col(f"{y}size"), percent)


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether the sizes, and the shingles that others can share at all, allow the similarity, and the
    shared shingle lies in the prefixes for these two sizes: of need shared ones, k are among the
    first size - need + k of both. free bounds the intersection for the set whose prefix ends first in
    the common order, which may be either: the other's prefix can hold shingles of its partner's suffix."""
    sizes, need = (F.col(f"{x}size"), F.col(f"{y}size")), _need(x, y, percent)
    inside = [F.col(f"{s}place") < F.col(f"{s}size") - need + F.least(f"{x}k", f"{y}k") for s in (x, y)]
    return ((100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & inside[0] & inside[1]
            & (F.greatest(f"{x}free", f"{y}free") >= need))


def with_partners(live: DataFrame, percent: int) -> DataFrame:
    """The rows of live(token, size, place, free, k, ..) that some row of their list may be similar to at that entry, by
    what _possible asks of the two. A list of two is judged as that pair; a row of a longer one by the
    smallest size that a partner in its list can have and the largest free of the list, so that no possible pair is lost."""
    lists = live.groupBy("token").agg(
        F.count("*").alias("_n"), F.sum("size").alias("_sum"), F.min("size").alias("_lo"), F.max("size").alias("_hi"),
        F.max("free").alias("_free"), F.max(F.col("place") - F.col("size")).alias("_late"), F.min("k").alias("_k"))
    need = _least(F.col("_sum"), percent)
    pair = (100 * F.col("_lo") >= percent * F.col("_hi")) & (F.col("_late") < F.col("_k") - need) & (F.col("_free") >= need)
    low = _least(F.col("size") + F.greatest("_lo", _share(F.col("size"), percent)), percent)
    row = (F.col("place") < F.col("size") - low + F.col("k")) & (F.col("_free") >= low)
    return live.join(lists, "token").where(F.when(F.col("_n") == 2, pair).otherwise((F.col("_n") > 2) & row)).select(*live.columns)


def _fits_heads(percent: int) -> Column:
    """Whether a pair of rows of one list is worth a pair: m, the smaller k, of its shared entries lie early enough
    in both sets, and only the first list that the pair shares makes it. head (places: at) holds the first HEAD
    entries of a set in the common order, so what both early heads share begins with the first shared entry;
    where they share none though one goes on early after its head, every list makes the pair."""
    m, need = F.least("x_k", "y_k"), _need("x_", "y_", percent)
    limit = {s: F.col(f"{s}size") - need + m for s in ("x_", "y_")}
    # At least m entries of each set must lie early enough, whatever the partner.
    enough = [F.coalesce(F.get(f"{s}at", m - 1) < bound, F.lit(False)) for s, bound in limit.items()]
    early = [F.slice(f"{s}head", F.lit(1), F.size(F.filter(f"{s}at", lambda e: e < bound))) for s, bound in limit.items()]
    shared = F.array_intersect(*early)
    whole = [(F.col(f"{s}entries") <= HEAD) | (F.element_at(f"{s}at", -1) >= bound) for s, bound in limit.items()]
    whole = whole[0] & whole[1]
    first = F.when(F.size(shared) == 0, ~whole).otherwise((F.get(shared, F.lit(0)) == F.col("token")) & (~whole | (F.size(shared) >= m)))
    return enough[0] & enough[1] & first


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar enough. Only texts of some pair are read again."""
    ids = small(pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct())
    wanted = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")

    def make():
        def score(block: Block) -> list:
            return [[s.view(np.int64) for s in shingle_sets(block, n)]]
        return score

    with arrow_batches(docs.sparkSession):
        sets = materialize(map_blocks(wanted, ["doc_id"], [StructField("s", ArrayType(LongType()))], make))
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct())


def similar_classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs(doc_id, text): n_shingles and component_id, the smallest doc_id
    reachable by links (100 * intersection >= percent * union of the sets of n-word shingles).

    Words are lower-cased (A-Z) runs of other than ASCII white space. Null or wordless texts have no
    shingles and are their own class. Rows that share an id are one document: linked with whatever
    any of its texts links with. A row without an id takes the class of equal sets if there is one,
    else null. Other columns are ignored."""
    with arrow_batches(docs.sparkSession):
        surveyed = materialize(survey(docs, n))
    rows = surveyed.where(F.col("part").isNull())
    classes = materialize(rows.where(F.col("n") > 0).groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    named = docs.where(F.col("doc_id").isNotNull())
    copies = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct().join(
        classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    alone = without(named, copies)

    counts = frequencies(surveyed)
    with arrow_batches(docs.sparkSession):
        lists = materialize(postings(alone, counts, n, percent))
    common = lists.groupBy("token").count().where(F.col("count") > 1).select("token")
    live = materialize(lists.join(common, "token"))
    # A set whose prefix ends before its partner's shares at most its live shingles and its suffix, which
    # has share - k. The largest suffix counts where texts share an id.
    free = live.groupBy("doc_id").agg(
        (F.count("*") + F.max(_share(F.col("size"), percent) - F.col("k"))).cast("int").alias("free"))
    live = materialize(with_partners(live.join(free, "doc_id"), percent))
    rank = (F.col("place").cast("long") * (1 << 31)) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    heads = live.groupBy("token").agg(*[F.min_by(x, rank).alias(f"l_{x}") for x in ("doc_id", "size", "place", "free", "k")])
    live = materialize(live.join(heads, "token"))

    # Every document meets the leader that it shares most lists with.
    star = (live.where((F.col("doc_id") != F.col("l_doc_id")) & _possible("", "l_", percent))
            .groupBy("doc_id", "l_doc_id").agg(F.count("*").alias("shared"))
            .groupBy("doc_id").agg(F.max_by("l_doc_id", F.struct("shared", "l_doc_id")).alias("l")))
    links = materialize(verified(docs, materialize(star.select(F.col("doc_id").alias("a"), F.col("l").alias("b"))), n, percent))

    # What the stars left apart is compared in full.
    fields = ["doc_id", "size", "place", "free", "k", "class", "entries", "head", "at"]
    known = components(links)
    placed = (live.join(known, F.col("doc_id") == F.col("node"), "left")
              .select("token", "doc_id", "size", "place", "free", "k", F.coalesce("component", "doc_id").alias("class"),
                      (F.col("doc_id") == F.col("l_doc_id")).alias("leads")))
    placed = materialize(placed)
    mixed = (placed.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"),
                                         F.max(F.when(F.col("leads"), F.col("class"))).alias("main"))
             .where(F.col("lo") != F.col("hi")).select("token", "main"))
    placed = materialize(placed.join(mixed, "token").drop("leads"))
    # Sets of different classes share entries of mixed lists alone, so only these count from here on.
    # Texts of one id, size and k share a head, which then holds the entries of each of them.
    order = F.array_sort(F.collect_list(F.struct("place", "token")))
    own = ["doc_id", "size", "k"]
    heads = placed.groupBy(*own).agg(order.alias("h")).select(
        *own, F.size("h").alias("entries"), F.slice("h.token", 1, HEAD).alias("head"), F.slice("h.place", 1, HEAD).alias("at"))
    placed = materialize(placed.join(heads, own))
    x = placed.where(F.col("class") != F.col("main")).select("token", *[F.col(c).alias(f"x_{c}") for c in fields])
    y = placed.select("token", "main", *[F.col(c).alias(f"y_{c}") for c in fields])
    once = (F.col("y_class") == F.col("main")) | (F.col("x_doc_id") < F.col("y_doc_id"))
    left = x.join(y, "token").where(
        (F.col("x_class") != F.col("y_class")) & once & _possible("x_", "y_", percent) & _fits_heads(percent))
    left = left.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()
    more = verified(docs, materialize(left), n, percent)

    final = components(links.unionByName(more))
    own = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        "n", "d1", "d2", F.coalesce("component", "rep").alias("class"))
    out = rows.select("doc_id", "n", "d1", "d2").join(own, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, without the documents whose class has a smaller id. Rows without an id stay."""
    found = similar_classes(docs, n, percent)
    return without(docs, materialize(found.where(F.col("component_id") < F.col("doc_id")).select("doc_id")))
