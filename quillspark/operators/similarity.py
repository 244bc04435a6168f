"""Exact and approximate nearest vectors for whole tables of queries.

Scoring is a blocked matrix product inside Arrow batches that keeps only the best k per
query, so no (query, chunk) pair table is ever built. Three ways to bring the sides together:

* broadcast: the query batch is checked to be small; chunks are scanned once, not shuffled.
* blocks: both sides are cut into cells of bounded size and cogrouped.
* buckets: like blocks, but only rows of one bucket meet; hot buckets are cut into cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_VALUES = 8_000_000
QUERY_CELL, CHUNK_CELL = 16_384, 65_536
_SCORES_AT_ONCE = 1_000_000


def _matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, unit vectors) for each vector length; null and zero vectors are left out."""
    if isinstance(ids, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    sizes = pc.list_value_length(vectors)
    for size in pc.unique(sizes.drop_null()).to_pylist():
        if not size:
            continue
        rows = pc.fill_null(pc.equal(sizes, size), False)
        flat = vectors.filter(rows).flatten().to_numpy(zero_copy_only=False).astype("float64")
        matrix = flat.reshape(-1, size)
        length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        usable = np.isfinite(length) & (length > 0)
        names = np.asarray(ids.filter(rows).to_pylist())
        yield size, names[usable], matrix[usable] / length[usable, None]


#: Queries that meet a tile of vectors; how far a single-precision score may be off; the share of a tile from which all of
#: it is scored in double precision.
_QUERY_TILE, _SINGLE_ERROR, _DENSE = 1024, 2e-5, 0.05


def exact_scores(left: np.ndarray, right: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The products of rows left[at] and right[to], pair by pair or, where they are many, from the whole product."""
    if len(at) > _DENSE * len(left) * len(right):
        return (left @ right.T)[at, to]
    step = max(1, _SCORES_AT_ONCE // left.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", left[at[i:i + step]], right[to[i:i + step]]) for i in range(0, len(at), step)] or [np.zeros(0)])


class _TopK:
    """Running top k of one query matrix; ties go to the smaller id. With slack, everything
    within slack of the k-th score is kept as well (k None keeps all above the floor)."""

    def __init__(self, qids, queries, k, exclude_self, floor, strict, slack):
        self.qids, self.queries, self.k = qids, queries, k
        self.exclude_self, self.slack = exclude_self, slack
        low = -np.inf if floor is None else (np.nextafter(floor, np.inf) if strict else floor)
        self.limit = np.full(len(qids), low)
        self.kept: list[tuple] = []
        self.pending = 0
        self.single = queries.astype(np.float32)
        self.rows: dict | None = None

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the queries and places in ids that bear the same id."""
        if self.rows is None:
            self.rows = {}
            for row, name in enumerate(self.qids.tolist()):
                self.rows.setdefault(name, []).append(row)
        pairs = [(row, at) for at, name in enumerate(ids.tolist()) for row in self.rows.get(name, ())]
        return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        single = matrix.astype(np.float32)
        own = self._own(ids) if self.exclude_self else None
        for low in range(0, len(self.qids), _QUERY_TILE):
            self._add(slice(low, low + _QUERY_TILE), ids, matrix, single, own)
        if self.pending > max(_SCORES_AT_ONCE // 2, 2 * (self.k or 0) * len(self.qids)):
            self.compact()

    def _add(self, tile: slice, ids: np.ndarray, matrix: np.ndarray, single: np.ndarray, own: tuple | None) -> None:
        """The queries of a tile meet all rows. Scores in single precision, with their error, say which are exactly scored."""
        queries, limit = self.queries[tile], self.limit[tile]
        step = max(1, _SCORES_AT_ONCE // max(1, len(queries)))
        best, kept, pending = self.k is not None and self.slack is None, [], 0
        if own is not None:
            mine = (own[0] >= tile.start) & (own[0] < tile.stop)
            own = own[0][mine] - tile.start, own[1][mine]
        for at in range(0, len(ids), step):
            part = ids[at:at + step]
            scores = self.single[tile] @ single[at:at + step].T
            if own is not None:
                here = (own[1] >= at) & (own[1] < at + step)
                scores[own[0][here], own[1][here] - at] = -np.inf
            if best and at == 0 and len(part) > self.k:
                # No score below the k-th best of these rows can be among the best k.
                limit = np.maximum(limit, np.partition(scores, -self.k, axis=1)[:, -self.k] - _SINGLE_ERROR)
            q, c = np.divmod(np.flatnonzero(scores >= np.maximum(limit - 2 * _SINGLE_ERROR, -2.0).astype(np.float32)[:, None]), len(part))
            exact = exact_scores(queries, matrix[at:at + step], q, c)
            good = exact >= limit[q]
            q, c, exact = q[good], c[good], exact[good]
            kept.append((q + tile.start, part[c], exact))
            pending += len(q)
            if best and pending > 2 * self.k * len(queries):
                self.limit[tile] = limit
                kept = [self._reduced(kept)]
                limit, pending = self.limit[tile], len(kept[0][0])
        self.limit[tile] = limit
        self.kept += kept
        self.pending += pending

    def compact(self) -> tuple | None:
        if not self.kept:
            return None
        q, ids, scores = self._reduced(self.kept)
        self.kept, self.pending = [(q, ids, scores)], 0
        return q, ids, scores

    def _reduced(self, kept: list[tuple]) -> tuple:
        """The best of what was kept, and their queries' new limits."""
        q, ids, scores = (np.concatenate(p) for p in zip(*kept))
        if self.k is not None:
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
            at_k = place == self.k - 1
            self.limit[q[at_k]] = np.maximum(self.limit[q[at_k]], scores[at_k] - (self.slack or 0.0))
            keep = place < self.k if self.slack is None else scores >= self.limit[q]
            q, ids, scores = q[keep], ids[keep], scores[keep]
        return q, ids, scores


def _emit(tops: list[_TopK], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for top in tops:
        found = top.compact()
        if found is None:
            continue
        q, ids, scores = found
        for at in range(0, len(q), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(top.qids[q[part]].tolist(), schema.field(0).type),
                 pa.array(ids[part].tolist(), schema.field(1).type), pa.array(scores[part])], schema=schema)


def _arrow_type(spark_type: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[spark_type]


class _Job:
    """Types and options of one similarity job."""

    def __init__(self, queries, chunks, k, exclude_self, floor, strict, slack):
        qtype = queries.schema["qid"].dataType.simpleString()
        ctype = chunks.schema["chunk_id"].dataType.simpleString()
        self.ddl = f"qid {qtype}, chunk_id {ctype}, vector_score double"
        self.schema = pa.schema([("qid", _arrow_type(qtype)), ("chunk_id", _arrow_type(ctype)),
                                 ("vector_score", pa.float64())])
        self.k = k
        self.options = (k, exclude_self, floor, strict, slack)

    def tops(self, ids, vectors) -> dict[int, _TopK]:
        return {d: _TopK(names, m, *self.options) for d, names, m in _matrices(ids, vectors)}


def _broadcast_scores(job: _Job, queries: pa.Table, chunks: DataFrame) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(
        [(d, names, m) for d, names, m in _matrices(queries["qid"], queries["emb"])])
    schema, options = job.schema, job.options

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {d: _TopK(names, m, *options) for d, names, m in shared.value}
        for batch in batches:
            for d, ids, matrix in _matrices(batch.column(0), batch.column(1)):
                if d in tops:
                    tops[d].add(ids, matrix)
        yield from _emit(list(tops.values()), schema)
    return chunks.select("chunk_id", "emb").mapInArrow(scan, job.ddl)


def _cell_scores(job: _Job, queries: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tops = job.tops(left["qid"], left["emb"]) if left.num_rows and right.num_rows else {}
        if tops:
            for d, ids, matrix in _matrices(right["chunk_id"], right["emb"]):
                if d in tops:
                    tops[d].add(ids, matrix)
        return pa.Table.from_batches(list(_emit(list(tops.values()), job.schema)), schema=job.schema)
    renewed = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # both sides may be one table
    return renewed.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInArrow(score, job.ddl)


def _cells(rows, size: int):
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(float(size)))).cast("int")


def _spread(df: DataFrame, own: str, id_col: str, own_cells, other: str, other_cells) -> DataFrame:
    """Put each row into one cell of its own side and copy it to every cell of the other."""
    return (df.withColumn(own, F.pmod(F.xxhash64(F.col(id_col)), own_cells).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), other_cells - 1))))


def _block_scores(job: _Job, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    q_cells = _cells(queries.agg(F.count("*")).scalar(), QUERY_CELL)
    c_cells = _cells(chunks.agg(F.count("*")).scalar(), CHUNK_CELL)
    return _cell_scores(
        job,
        _spread(queries.select("qid", "emb"), "_q", "qid", q_cells, "_c", c_cells),
        _spread(chunks.select("chunk_id", "emb"), "_c", "chunk_id", c_cells, "_q", q_cells), ["_q", "_c"])


def rank_scores(scores: DataFrame, k: int | None) -> DataFrame:
    # Scores of equal vectors may differ in the last bits; rounded, they tie and the id decides.
    order = W.partitionBy("qid").orderBy(F.desc(F.round("vector_score", 9)), "chunk_id")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "chunk_id", "vector_score")


def vector_scores(queries: DataFrame, chunks: DataFrame, k: int | None, exclude_self: bool = False,
                  floor: float | None = None, strict: bool = False, slack: float | None = None,
                  strategy: str = "auto", max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Candidate (qid, chunk_id, vector_score) rows: at least the top k of every query, from
    each task or cell separately (so a superset; rank it or use vector_topk).

    auto reads at most max_queries + 1 query rows to decide: a batch that fits is broadcast,
    anything larger is scored in blocks."""
    job = _Job(queries, chunks, k, exclude_self, floor, strict, slack)
    if strategy != "blocks":
        head = queries.select("qid", "emb").limit(max_queries + 1).toArrow()
        values = pc.sum(pc.list_value_length(head["emb"])).as_py() or 0
        if head.num_rows <= max_queries and values <= MAX_BROADCAST_VALUES:
            return _broadcast_scores(job, head, chunks)
        if strategy == "broadcast":
            raise ValueError("query batch too large to broadcast")
    return _block_scores(job, queries, chunks)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, exclude_self: bool = False,
                floor: float | None = None, strict: bool = False, strategy: str = "auto") -> DataFrame:
    """queries(qid, emb), chunks(chunk_id, emb) -> qid, rank, chunk_id, vector_score."""
    return rank_scores(vector_scores(queries, chunks, k, exclude_self, floor, strict, strategy=strategy), k)


def bucket_scores(queries: DataFrame, chunks: DataFrame, bucket: str, k: int, exclude_self: bool = False,
                  floor: float | None = None, query_cell: int = QUERY_CELL,
                  chunk_cell: int = CHUNK_CELL) -> DataFrame:
    """Top k per query among the chunks of the same bucket. Buckets above a cell's size are
    cut into cells on both sides, so one bucket with a third of all rows is spread out."""
    job = _Job(queries, chunks, k, exclude_self, floor, False, None)

    def hot(df: DataFrame, size: int, name: str) -> DataFrame:
        return (df.groupBy(bucket).count().where(F.col("count") > size)
                .select(bucket, _cells(F.col("count"), size).alias(name)))
    big = hot(queries, query_cell, "_qn").join(hot(chunks, chunk_cell, "_cn"), bucket, "full")

    def cells(df: DataFrame) -> DataFrame:
        return df.join(big, bucket, "left").fillna(1, ["_qn", "_cn"])
    return _cell_scores(
        job,
        _spread(cells(queries), "_q", "qid", F.col("_qn"), "_c", F.col("_cn")).select(bucket, "_q", "_c", "qid", "emb"),
        _spread(cells(chunks), "_c", "chunk_id", F.col("_cn"), "_q", F.col("_qn"))
        .select(bucket, "_q", "_c", "chunk_id", "emb"), [bucket, "_q", "_c"])


def _signatures(df: DataFrame, id_col: str, dim: int, bands: int, bits: int, seed: int) -> DataFrame:
    id_type = df.schema[id_col].dataType.simpleString()

    def sign(batches):
        planes = np.random.default_rng(seed).normal(size=(dim, bands * bits))
        weights = 1 << np.arange(bits, dtype="int64")
        for batch in batches:
            for d, ids, matrix in _matrices(batch.column(0), batch.column(1)):
                if d != dim:
                    continue
                signs = (matrix @ planes > 0).reshape(len(ids), bands, bits)
                keys = signs @ weights + (np.arange(bands, dtype="int64") << bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.tolist(), _arrow_type(id_type)),
                     pa.array(list(matrix.astype("float32")), pa.list_(pa.float32())),
                     pa.array(list(keys), pa.list_(pa.int64()))], names=[id_col, "emb", "keys"])
    return (df.select(id_col, "emb").mapInArrow(sign, f"{id_col} {id_type}, emb array<float>, keys array<bigint>")
            .select(id_col, "emb", F.explode("keys").alias("bucket")))


def vector_topk_approx(queries: DataFrame, chunks: DataFrame, k: int, dim: int, bands: int = 32,
                       bits: int = 6, seed: int = 7, exclude_self: bool = False) -> DataFrame:
    """Top k among the chunks that share a sign pattern with the query in at least one band of
    random projections; candidates are scored exactly."""
    found = bucket_scores(_signatures(queries, "qid", dim, bands, bits, seed),
                          _signatures(chunks, "chunk_id", dim, bands, bits, seed), "bucket", k, exclude_self)
    return rank_scores(found.groupBy("qid", "chunk_id").agg(F.max("vector_score").alias("vector_score")), k)


def recall_at_k(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Share of the exact top k found by the approximate one."""
    hit = approx.select("qid", "chunk_id", F.lit(1).alias("_hit"))
    return (exact.join(hit, ["qid", "chunk_id"], "left")
            .agg(F.count("*").alias("expected"), F.count("_hit").alias("found"))
            .withColumn("recall", F.try_divide("found", "expected")))


def threshold_search(queries: DataFrame, chunks: DataFrame, floor: float = 0.5, k: int = 3,
                     exclude_self: bool = False) -> DataFrame:
    """Up to k matches above the floor, else the single best one."""
    top = vector_topk(queries, chunks, k, exclude_self)
    above = F.col("vector_score") > floor
    return top.where(above | (F.col("rank") == 1)).withColumn("above_floor", above)
