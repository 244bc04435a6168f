"""File sources and table sinks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import file_hash

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in TABLES}


def resolve_mime(name, declared=None):
    """The declared type if there is one, else by file extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    guessed = (F.when(extension == "pdf", "application/pdf").when(extension == "txt", "text/plain")
               .otherwise("application/octet-stream"))
    return guessed if declared is None else F.coalesce(F.nullif(declared, F.lit("")), guessed)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files below path: name, mime, size, content, file_hash."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    return files.select(F.url_decode(name).alias("name"), resolve_mime(name).alias("mime"),
                        F.col("length").alias("size"), "content", file_hash("content").alias("file_hash"))


#: Files above this many bytes are hashed in pieces: in one row a file takes several times its size in memory.
WHOLE_FILE = 16 << 20
#: Extensions that Spark's text reader unpacks. Such files have no pieces and are read whole.
PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst)$"


class _Digest:
    """file_hash of a file whose lines come in order. The reader leaves out the line breaks and a byte order mark at the
    start; the size says whether there was one, so both digests are kept. Base64 goes by three bytes, as long as the mark."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.seen = path, size, 0
        self.plain, self.marked, self.rest = hashlib.sha256(), hashlib.sha256(base64.b64encode(b"\xef\xbb\xbf")), b""
        self.first = True

    def lines(self, piece: bytes) -> None:
        self.add(piece if self.first else b"\n" + piece)
        self.first = False

    def add(self, data: bytes) -> None:
        self.seen += len(data)
        data = self.rest + data
        whole = len(data) - len(data) % 3
        self.update(data[:whole])
        self.rest = data[whole:]

    def update(self, data: bytes) -> None:
        code = base64.b64encode(data)
        self.plain.update(code)
        self.marked.update(code)

    def row(self) -> dict:
        if self.size - self.seen in (1, 4):  # the last line has a break too
            self.add(b"\n")
        if self.size - self.seen not in (0, 3):
            raise ValueError(f"{self.path}: {self.seen} of {self.size} bytes read")
        self.update(self.rest)
        return {"path": self.path, "size": self.size, "file_hash": (self.marked if self.seen < self.size else self.plain).hexdigest()}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one batch that stand in one part of a file, joined: (path, size, at, no, value)."""
    no = 0
    for batch in batches:
        paths, sizes, starts, values = batch.columns
        begin = 0
        while begin < batch.num_rows:
            path, at = paths[begin], starts[begin]
            same = pc.and_(pc.equal(paths, path), pc.equal(starts, at)).slice(begin)
            n = pc.index(same, False).as_py()
            n = batch.num_rows - begin if n < 0 else n
            yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "size": sizes[begin].as_py(), "at": at.as_py(), "no": no,
                                               "value": b"\n".join(values.slice(begin, n).to_pylist())}])
            begin, no = begin + n, no + 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, size, file_hash from (path, size, value): pieces in order, file after file."""
    now = None
    for batch in batches:
        for path, size, value in zip(*batch.columns):
            if now is None or now.path != path.as_py():
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row()])
                now = _Digest(path.as_py(), size.as_py())
            now.lines(value.as_py())
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()])


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """read_documents without the content: name, mime, size, file_hash. Files above `whole` bytes are split among tasks as
    raw lines, which meet again in order, joined by batches, a file a task, and are hashed as they pass by."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = ["path", F.col("length").alias("size"), file_hash("content").alias("file_hash")]
    # The reader opens no file that a condition on the length leaves out.
    small = listed.where(F.col("length") <= whole).select(*hashed)
    text = (spark.read.format("text").option("recursiveFileLookup", "true").option("lineSep", "\n").load(path)
            .where((F.col("_metadata.file_size") > whole) & ~F.col("_metadata.file_path").rlike(PACKED)))
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    pieces = lines.mapInArrow(_pieces, "path string, size bigint, at bigint, no bigint, value binary")
    ordered = pieces.repartition("path").sortWithinPartitions("path", "at", "no")
    large = ordered.select("path", "size", "value").mapInArrow(_digests, "path string, size bigint, file_hash string")
    # Paths of the metadata are encoded; those of the binary reader are not.
    large = large.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    files = small.unionByName(large)
    if listed.where((F.col("length") > whole) & F.col("path").rlike(PACKED)).limit(1).count():
        files = files.unionByName(listed.where(F.col("length") > whole).where(F.col("path").rlike(PACKED)).select(*hashed))
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    return files.select(F.url_decode(name).alias("name"), resolve_mime(name).alias("mime"), "size", "file_hash")


def text_documents(files: DataFrame) -> DataFrame:
    """Admitted plain-text files as documents(doc_id, filename, text)."""
    return (files.where(F.col("mime") == "text/plain")
            .select(F.col("file_hash").alias("doc_id"), F.col("name").alias("filename"),
                    F.decode("content", "UTF-8").alias("text")))


def write_snapshot(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write one version of a table under its own folder; a version is written whole or again, so a
    retry is harmless and a folder being read is never overwritten."""
    target = f"{root}/version={version}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target
