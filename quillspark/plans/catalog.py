"""Registered queries: how each operator runs over the given tables, with the SQL that checks it.

The tables stand in for the application's own (a document's text, a vector as its chunk
vector, messages as pages), so every query reads whole tables and grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"


class Tables:
    """The given tables, read on first use, and the views the queries share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        local = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df

    def corpus(self) -> DataFrame:
        """documents with owner, access, status, folder and file name."""
        status = (F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "processing")
                  .otherwise("completed"))
        return (self.documents.join(self.labels, "doc_id", "left")
                .select("doc_id", "text", "lang", "source", "n_chars",
                        F.pmod("doc_id", F.lit(150)).alias("owner_id"),
                        F.when(F.col("lang") == "en", "public").otherwise("private").alias("access"),
                        status.alias("status"), F.col("source").alias("folder_name"),
                        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename")))

    def chunks(self) -> DataFrame:
        """Documents as chunks; the vectors are dealt round, so that every document has one."""
        vectors = self.embeddings.agg(F.count("*")).scalar()
        return (self.corpus().withColumn("_vec", F.pmod("doc_id", vectors)).join(self.embeddings, F.col("_vec") == F.col("vec_id"))
                .select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"),
                        F.col("embedding").alias("emb"), "access", F.lit(1).alias("page")))

    def search_queries(self) -> DataFrame:
        """Benchmark passages, whole, with a vector."""
        return (self.benchmark.join(self.embeddings, F.col("item_id") == F.col("vec_id"))
                .select(F.col("item_id").alias("qid"), "text", F.col("embedding").alias("emb")))

    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("emb"), "label")

    def message_pages(self) -> DataFrame:
        """Conversations as documents with one page per turn."""
        return self.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"),
                                         "text", "role", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))

    def headed_pages(self) -> DataFrame:
        return self.message_pages().withColumn("text", with_headers(F.col("text")))


def with_headers(text: Column) -> Column:
    """Marks lines by their first letter, as the given text has no '#' headers."""
    marked = F.regexp_replace(text, r"(^|\n)(E)", "$1# $2")
    marked = F.regexp_replace(marked, r"(^|\n)(T)", "$1## $2")
    return F.regexp_replace(marked, r"(^|\n)(O)", "$1### $2")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def register(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, path: build(Tables(spark, path))
        if sql is not None:
            ORACLE[name] = sql
        return build
    return add


# --- SQL building blocks ------------------------------------------------------------------

def sql_match(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def sql_match_tokens(x: str) -> str:
    return f"list_filter(string_split({sql_match(x)}, ' '), lambda w: length(w) >= 3)"


def sql_term(x: str) -> str:
    return (f"regexp_replace(regexp_replace(trim(nfc_normalize(lower({x}))), '[^\\p{{L}}\\p{{N}}\\s_:-]', ' ', 'g'), "
            f"'\\s+', ' ', 'g')")


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def sql_estimate(x: str) -> str:
    return f"CAST(ceil(len({sql_words(x)}) * 1.5) AS BIGINT)"


def sql_trigrams(x: str) -> str:
    return (f"list_distinct(flatten(list_transform({sql_tokens(x)}, lambda w: list_transform("
            f"range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))")


SQL_CORPUS = """
corpus AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.doc_id % 150 AS owner_id,
         CASE WHEN d.lang = 'en' THEN 'public' ELSE 'private' END AS access,
         CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 0 THEN 'processing' ELSE 'completed' END AS status,
         d.source AS folder_name, d.source || '/' || d.doc_id || '.txt' AS filename
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

SQL_CHUNKS = SQL_CORPUS + """,
chunks AS (
  SELECT c.doc_id AS chunk_id, c.doc_id, c.text AS content, e.embedding::DOUBLE[] AS emb, c.access, c.status, c.owner_id
  FROM corpus c JOIN embeddings e ON c.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id)"""

SQL_SEARCH = """
search AS (
  SELECT b.item_id AS qid, b.text, e.embedding::DOUBLE[] AS emb
  FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"""

SQL_MARK = ("regexp_replace(regexp_replace(regexp_replace({x}, '(^|\\n)(E)', '\\1# \\2', 'g'), "
            "'(^|\\n)(T)', '\\1## \\2', 'g'), '(^|\\n)(O)', '\\1### \\2', 'g')")

SQL_MESSAGE_PAGES = "pages_in AS (SELECT conv_id AS doc_id, turn + 1 AS page, text, role FROM conversations)"
SQL_HEADED_PAGES = ("pages_in AS (SELECT conv_id AS doc_id, turn + 1 AS page, "
                    + SQL_MARK.format(x="text") + " AS text FROM conversations)")
SQL_DOCUMENT_PAGES = "pages_in AS (SELECT doc_id, 1 AS page, text FROM documents)"

SQL_LINES = """
raw_lines AS (
  SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM pages_in),
lines AS (
  SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS line_no
  FROM raw_lines WHERE trim(line) <> '')"""

SQL_HEADERS = SQL_LINES + """,
headed AS (
  SELECT *, CASE WHEN regexp_matches(line, '^(#{1,6})\\s+(.+)$') THEN length(regexp_extract(line, '^(#{1,6})\\s+(.+)$', 1))
                 WHEN length(line) < 80 AND regexp_matches(line,
                   '^([0-9]+\\.?\\s+)?([A-ZĚŠČŘŽÝÁÍÉ][A-Za-zěščřžýáíéůú\\s]+)[:.]?\\s*$') THEN 2 END AS level,
         CASE WHEN regexp_matches(line, '^(#{1,6})\\s+(.+)$') THEN trim(regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2))
              ELSE trim(line) END AS title
  FROM lines),
tracked AS (
  SELECT *, """ + ", ".join(
    f"last_value(CASE WHEN level = {k} THEN line_no END IGNORE NULLS) OVER w AS p{k}, "
    f"last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7)) + """
  FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
paths AS (
  SELECT doc_id, page, line, line_no, level, array_to_string(list_filter([""" + ", ".join(
    "CASE WHEN p{k} IS NOT NULL{c} THEN '{h} ' || t{k} END".format(
        k=k, h="#" * k, c="".join(f" AND p{k} > coalesce(p{u}, 0)" for u in range(1, k))) for k in range(1, 7)) + """
    ], lambda x: x IS NOT NULL), ' > ') AS header_path
  FROM tracked)"""

SQL_SEGMENTS = SQL_HEADERS + """,
numbered AS (
  SELECT *, sum(CASE WHEN level IS NOT NULL OR page IS DISTINCT FROM prev THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seg_no
  FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM paths)),
segs AS (
  SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, min(page) AS page, max(header_path) AS header_path,
         trim(string_agg(line, chr(10) ORDER BY line_no)) AS text
  FROM numbered GROUP BY doc_id, seg_no)"""


def sql_chunks(min_tokens: int) -> str:
    """Chunks of documents whose segments are not split."""
    return SQL_SEGMENTS + f""",
sized AS (SELECT *, {sql_estimate('text')} AS token_count FROM segs),
cut AS (
  SELECT doc_id || '-' || (row_number() OVER w - 1) AS chunk_id, doc_id, row_number() OVER w - 1 AS chunk_index, page,
         header_path AS parent_header, text AS content, token_count, sha256(text) AS content_hash
  FROM sized WHERE token_count >= {min_tokens} WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no))"""


def sql_blocks(source: str = "pages_in") -> str:
    """One block per non-blank line; x = 0 and width = 1."""
    return f"""
kept_lines AS (
  SELECT doc_id, page, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS kept,
         len(string_split(text, chr(10))) AS n FROM {source}),
blocks AS (
  SELECT doc_id, page, i - 1 AS pos, trim(kept[i]) AS text, 0.0::DOUBLE AS x, (i - 1) * (1.0::DOUBLE / n) AS y,
         1.0::DOUBLE AS w, 1.0::DOUBLE / n AS h
  FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM kept_lines))"""
