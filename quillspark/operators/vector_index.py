"""Approximate nearest vectors by a trained index: k-means cells and product-quantised residuals.

Every vector gets the cell of its nearest centre and one byte for each few dimensions of what is left. The
index is a table in folders of neighbouring cells, so a query batch reads the cells it probes alone. Within a cell the
queries meet the vectors as their codes have stored them in one product; only vectors whose looked-up score
could still reach the query's running k-th best, given the error seen in training, are scored exactly.

Centres, codes, the number of probes and the error margin come from one bounded sample; all vectors are indexed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .similarity import (CHUNK_CELL, MAX_BROADCAST_QUERIES, MAX_BROADCAST_VALUES, QUERY_CELL, _arrow_type, _cells, _emit,
                         _matrices, _spread, _TopK, exact_scores, rank_scores)

#: Bound of the training sample, in vectors and in values.
SAMPLE, SAMPLE_VALUES = 65_536, 8_000_000
CODES, CODE_DIMENSIONS, MAX_CELLS = 256, 4, 4096
#: Cells of a folder.
SHELF = 16
#: Shares of true neighbours, in training, that the probed cells and the error margin keep.
PROBE_SHARE, MARGIN_SHARE = 0.97, 0.98
_TRIALS, _NEIGHBOURS, _TILE = 256, 10, 1_000_000


@dataclass
class Codebook:
    centres: np.ndarray       # cells x dimensions, unit length
    codes: list[np.ndarray]   # for each slice of dimensions: values x its width
    probes: int
    margin: float

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]

    def slices(self) -> list[slice]:
        edges = np.cumsum([0, *(c.shape[1] for c in self.codes)])
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]

    def encode(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code bytes of each row of unit vectors."""
        cell = (matrix @ self.centres.T).argmax(1)
        rest = matrix - self.centres[cell]
        return cell, np.stack([_nearest(rest[:, s], c) for s, c in zip(self.slices(), self.codes)], 1).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of a cell are stored as."""
        rest = np.concatenate([c[codes[:, m]] for m, c in enumerate(self.codes)], axis=1)
        return (self.centres[cell] + rest).astype(np.float32)

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """The cells a query looks into, nearest first."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, :self.probes]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) / 2 - rows @ centres.T).argmin(1)


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means on the training sample; empty centres restart at random rows."""
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(rows, centres)
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=len(centres))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        full = counts > 0
        centres[full] = np.add.reduceat(rows[order], starts[full], axis=0) / counts[full, None]
        centres[~full] = rows[rng.integers(0, len(rows), int((~full).sum()))]
    return centres


def fit(vectors: DataFrame, dimensions: int, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Codebook | None:
    """Trains on at most `sample` of vectors(chunk_id, emb), picked by a hash of the id. Null, zero and
    wrong-length vectors are left out; None if nothing is left. cells: about the root of the number of vectors."""
    bound = max(1, min(sample, SAMPLE_VALUES // dimensions))
    rows = vectors.where(F.size("emb") == dimensions).select("chunk_id", "emb")
    picked = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(bound).toArrow()
    known = [m for _, _, m in _matrices(picked["chunk_id"], picked["emb"])]
    if not known:
        return None
    x, rng = known[0], np.random.default_rng(seed)
    if cells is None:
        total = picked.num_rows if picked.num_rows < bound else rows.count()
        cells = int(min(MAX_CELLS, max(1, total ** 0.5)))
    centres = _means(x, min(cells, len(x)), rng)
    length = np.sqrt((centres * centres).sum(1, keepdims=True))
    centres = np.where(length > 0, centres / np.maximum(length, 1e-12), x[:1])
    cell = (x @ centres.T).argmax(1)
    rest = x - centres[cell]
    pieces = np.array_split(np.arange(dimensions), -(-dimensions // CODE_DIMENSIONS))
    book = Codebook(centres, [_means(rest[:, p], min(CODES, len(x)), rng, 5) for p in pieces], len(centres), 0.0)

    # What finding the true neighbours within the sample takes: how many cells, and which error of looked-up scores.
    trial = x[:_TRIALS]
    exact = trial @ x.T
    exact[np.arange(len(trial)), np.arange(len(trial))] = -np.inf
    k = min(_NEIGHBOURS, len(x) - 1)
    if k > 0:
        best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
        ranks = np.argsort(np.argsort(-(trial @ centres.T), axis=1), axis=1)
        needed = np.take_along_axis(ranks, cell[best], 1)
        book.probes = int(np.quantile(needed, PROBE_SHARE, method="higher")) + 1
        _, codes = book.encode(x)
        stored = centres[cell] + np.concatenate([c[codes[:, m]] for m, c in enumerate(book.codes)], axis=1)
        error = np.take_along_axis(exact, best, 1) - np.einsum("qd,qkd->qk", trial, stored[best])
        book.margin = max(0.0, float(np.quantile(error, MARGIN_SHARE, method="higher")))
    return book


def encode(vectors: DataFrame, book: Codebook) -> DataFrame:
    """The index rows of all vectors(chunk_id, emb): chunk_id, emb (unit length), codes, cell. Null, zero and
    wrong-length vectors have none."""
    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, ids, matrix in _matrices(batch.column(0), batch.column(1)):
                if d == shared.value.dimensions and len(ids):
                    cell, codes = shared.value.encode(matrix)
                    flat = pa.array(matrix.astype(np.float32).ravel())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids.tolist(), _arrow_type(id_type)),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, d), pa.int32()), flat),
                         pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())],
                        names=["chunk_id", "emb", "codes", "cell"])

    return vectors.select("chunk_id", "emb").mapInArrow(run, f"chunk_id {id_type}, emb array<float>, codes binary, cell int")


def write_index(vectors: DataFrame, book: Codebook, path: str) -> None:
    """Writes the index and its codebook: a folder for each SHELF cells, rows in order of the cell, so that a
    probe skips folders and row groups. Rebalanced, so that files are few and a cell with many vectors is cut."""
    rows = encode(vectors, book).withColumn("shelf", F.floor(F.col("cell") / SHELF).cast("int"))
    (rows.hint("rebalance", "shelf").sortWithinPartitions("shelf", "cell").write.partitionBy("shelf").mode("overwrite")
     .parquet(f"{path}/cells"))
    (vectors.sparkSession.createDataFrame([(bytearray(pickle.dumps(book)),)], "book binary").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/codebook"))


def read_index(spark: SparkSession, path: str, id_type: str = "bigint") -> tuple[DataFrame, Codebook]:
    """What write_index wrote; read only folders of your own, as the codebook is a pickled object."""
    book = pickle.loads(bytes(spark.read.parquet(f"{path}/codebook").first()["book"]))
    return cells(spark, path, id_type), book


def cells(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The index rows alone, for who holds the codebook."""
    return spark.read.schema(f"chunk_id {id_type}, emb array<float>, codes binary, cell int, shelf int").parquet(f"{path}/cells")


def _asking(book: Codebook, matrix: np.ndarray) -> dict[int, np.ndarray]:
    """For each probed cell the rows of the queries that look into it."""
    probed = book.probed(matrix)
    order = np.argsort(probed.ravel(), kind="stable")
    cells, starts = np.unique(probed.ravel()[order], return_index=True)
    return dict(zip(cells.tolist(), np.split(order // probed.shape[1], starts[1:])))


def _search(book: Codebook, names: np.ndarray, matrix: np.ndarray, by_cell: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch],
            k: int, exclude_self: bool, floor: float | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The best k of batches(chunk_id, emb, codes, cell) for each query, then a row without ids whose score is the number
    of exactly scored pairs."""
    top, scored = _TopK(names, matrix, k, exclude_self, floor, False, None), 0
    floor_limit = top.limit.copy()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.asarray(batch.column(0).to_pylist())
        vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
        cell = batch.column(3).to_numpy()
        for c in np.unique(cell).tolist():
            rows = np.flatnonzero(cell == c)
            asking = by_cell.get(c, rows[:0])
            step = max(1, _TILE // max(1, len(asking)))
            for at in range(0, len(rows) if len(asking) else 0, step):
                part = rows[at:at + step]
                guess, asked, held = top.single[asking] @ book.decode(c, codes[part]).T, matrix[asking], vectors[part].astype(np.float64)
                fresh = np.flatnonzero(top.limit[asking] == floor_limit[asking])
                if len(fresh):  # a first bar for queries without one: their best by looked-up score
                    few = np.argpartition(-guess[fresh], min(k, len(part)) - 1, axis=1)[:, :k]
                    q, c_at = np.repeat(fresh, few.shape[1]), few.ravel()
                    scored += _score(top, asking, ids[part], q, c_at, asked, held)
                    guess[q, c_at] = -np.inf
                    top.compact()
                bar = top.limit[asking] - book.margin
                q, c_at = np.divmod(np.flatnonzero(guess >= np.maximum(bar, -2.0).astype(np.float32)[:, None] - 1e-6), len(part))
                scored += _score(top, asking, ids[part], q, c_at, asked, held)
                if top.pending > k * len(names):
                    top.compact()
    yield from _emit([top], schema)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(0).type), pa.nulls(1, schema.field(1).type),
                                      pa.array([float(scored)])], schema=schema)


def _result(types: tuple[str, str]) -> tuple[pa.Schema, str]:
    schema = pa.schema([("qid", _arrow_type(types[0])), ("chunk_id", _arrow_type(types[1])), ("vector_score", pa.float64())])
    return schema, f"qid {types[0]}, chunk_id {types[1]}, vector_score double"


def _probe_scores(index: DataFrame, book: Codebook, queries: pa.Table, k: int, exclude_self: bool, floor: float | None,
                  types: tuple[str, str]) -> DataFrame:
    """_search of every task's rows by all queries."""
    known = [(names, m) for d, names, m in _matrices(queries["qid"], queries["emb"]) if d == book.dimensions]
    schema, ddl = _result(types)
    if not known:
        return index.sparkSession.createDataFrame([], ddl)
    names, matrix = known[0]
    by_cell = _asking(book, matrix)
    shared = index.sparkSession.sparkContext.broadcast((book, names, matrix, by_cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(*shared.value, batches, k, exclude_self, floor, schema)

    shelves = sorted({c // SHELF for c in by_cell})
    wanted = index.where(F.col("shelf").isin(shelves) & F.col("cell").isin(sorted(by_cell))).select("chunk_id", "emb", "codes", "cell")
    return wanted.mapInArrow(run, ddl)


def _block_search(queries: DataFrame, index: DataFrame, book: Codebook, k: int, exclude_self: bool, floor: float | None,
                  types: tuple[str, str], query_block: int) -> DataFrame:
    """_search of blocks of the index by blocks of queries, both of bounded size."""
    shared = index.sparkSession.sparkContext.broadcast(book)
    schema, ddl = _result(types)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found, book = [], shared.value
        for d, names, matrix in _matrices(left["qid"], left["emb"]) if left.num_rows and right.num_rows else ():
            if d == book.dimensions and len(names):
                rows = right.select(["chunk_id", "emb", "codes", "cell"]).sort_by("cell").combine_chunks().to_batches()
                found += _search(book, names, matrix, _asking(book, matrix), rows, k, exclude_self, floor, schema)
        return pa.Table.from_batches(found, schema=schema)

    q_blocks = _cells(queries.agg(F.count("*")).scalar(), query_block)
    c_blocks = _cells(index.agg(F.count("*")).scalar(), CHUNK_CELL)
    asked = _spread(queries.select("qid", "emb"), "_q", "qid", q_blocks, "_c", c_blocks)
    held = _spread(index.select("chunk_id", "emb", "codes", "cell"), "_c", "chunk_id", c_blocks, "_q", q_blocks)
    return asked.groupBy("_q", "_c").cogroup(held.groupBy("_q", "_c")).applyInArrow(search, ddl)


def _score(top: _TopK, asking: np.ndarray, ids: np.ndarray, q: np.ndarray, c: np.ndarray, asked: np.ndarray, held: np.ndarray) -> int:
    """Scores the pairs (row of asked, row of held) exactly and keeps those that reach their query's bar. Returns their
    number. asking, ids: the queries and ids of the rows."""
    if top.exclude_self:
        other = top.qids[asking[q]] != ids[c]
        q, c = q[other], c[other]
    exact, row = exact_scores(asked, held, q, c), asking[q]
    good = exact >= top.limit[row]
    top.kept.append((row[good], ids[c[good]], exact[good]))
    top.pending += int(good.sum())
    return len(q)


def index_scores(queries: DataFrame, index: DataFrame, book: Codebook, k: int, exclude_self: bool = False,
                 floor: float | None = None, max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Candidates (qid, chunk_id, vector_score) of queries(qid, emb): at least the best k found for each. Rows with a
    null qid hold numbers of exactly scored pairs. A batch of at most max_queries is broadcast; a larger
    one meets the index in blocks of both, pruned alike."""
    head = queries.select("qid", "emb").limit(max_queries + 1).toArrow()
    types = (queries.schema["qid"].dataType.simpleString(), index.schema["chunk_id"].dataType.simpleString())
    if head.num_rows <= max_queries and head.num_rows * book.dimensions <= MAX_BROADCAST_VALUES:
        return _probe_scores(index, book, head, k, exclude_self, floor, types)
    block = max(1, min(4 * max_queries, QUERY_CELL, MAX_BROADCAST_VALUES // book.dimensions))
    return _block_search(queries, index, book, k, exclude_self, floor, types, block)


def index_topk(queries: DataFrame, index: DataFrame, book: Codebook, k: int, exclude_self: bool = False,
               floor: float | None = None) -> DataFrame:
    """queries(qid, emb) -> qid, rank, chunk_id, vector_score by a trained index; scores are exact."""
    return rank_scores(index_scores(queries, index, book, k, exclude_self, floor).where("qid IS NOT NULL"), k)
