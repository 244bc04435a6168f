"""Benchmark decontamination: the benchmark's word n-grams form a broadcast hash set, every window of
every training text is looked up in it, hits are verified word by word, and texts or spans go.

A window's key is a hash of its length and of three of its words, which needs no copy of the window;
the verification compares all of its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import MAX_BROADCAST_ROWS, without
from quillspark.session import materialize

WINDOW = 13
#: A text is contaminated if its hit words times this are at least its words.
SHARE = 20
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORDS), F.lit(0))


def _key(words: Column, at: Column, size: Column) -> Column:
    """Hash of the window of size words that begins at the 0-based position at."""
    return F.xxhash64(size, *[F.get(words, at + shift) for shift in
                              (F.lit(0), (size / 2).cast("int"), size - 1)])


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The distinct windows of the benchmark with the items they occur in: key, n, gram, item_ids.
    An item of fewer than size words, but not none, is one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    spans = items.select("item_id", "w", F.least(F.size("w"), F.lit(size)).alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n")))
    cut = spans.select("item_id", "n", "w", at.alias("at")).select(
        "item_id", "n", F.slice("w", F.col("at") + 1, F.col("n")).alias("gram"))
    return (cut.groupBy("n", "gram").agg(F.collect_set("item_id").alias("item_ids"))
            .select(_key(F.col("gram"), F.lit(0), F.col("n")).alias("key"), "n", "gram", "item_ids"))


def _scan(docs: DataFrame, benchmark: DataFrame, size: int, max_rows: int) -> DataFrame:
    """One pass over the texts, written once to the checkpoint folder: a row for each row of docs (doc_id, text hash,
    n_words) and for each verified occurrence (doc_id, text hash, at (word), n, item_ids; n_words null).

    The windows are broadcast if there are at most max_rows; each text has a last entry of its own that meets
    an entry of the set made for it, so that texts without hits stay. Beyond max_rows only keys and places
    of the texts' windows are shuffled, and words are read again for texts with an equal key alone."""
    wanted = materialize(windows(benchmark, size))
    broadcast = wanted.limit(max_rows + 1).count() <= max_rows
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # at most size values
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    n_words = F.size("w").cast("long").alias("n_words")
    items = wanted.schema["item_ids"].dataType
    rows = texts.select("doc_id", "text_hash", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("n"),
                        F.lit(None).cast(items).alias("item_ids"), n_words)
    if not lengths:
        return materialize(rows)
    own = F.col("at") == F.size("w")
    places = texts.select("doc_id", "text_hash", "w", F.posexplode(F.array_append("w", F.lit(""))).alias("at", "word")).drop("word")
    places = places.withColumn("n", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*[F.lit(n) for n in lengths])))
    inside = F.col("at") + F.col("n") <= F.size("w")
    if broadcast:
        places = places.where(inside | (own & (F.col("n") == lengths[0])))
        places = places.withColumn("key", F.when(own, 0).otherwise(_key(F.col("w"), F.col("at"), F.col("n"))))
        end = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("n"),
                                                F.lit(None).cast("array<string>").alias("gram"), F.lit(None).cast(items).alias("item_ids"))
        found = places.join(F.broadcast(wanted.unionByName(end).withColumnRenamed("n", "n_")), "key")
        same = F.when(own, F.col("n_") == 0).otherwise(
            (F.col("n") == F.col("n_")) & (F.slice("w", F.col("at") + 1, F.col("n")) == F.col("gram")))
        return materialize(found.where(same).select(
            "doc_id", "text_hash", *[F.when(~own, F.col(c)).alias(c) for c in ("at", "n", "item_ids")],
            F.when(own, F.size("w").cast("long")).alias("n_words")))
    keys = places.where(inside).select("doc_id", "text_hash", "at", "n", _key(F.col("w"), F.col("at"), F.col("n")).alias("key"))
    near = materialize(keys.join(wanted.select("key", F.col("n").alias("n_"), "gram", "item_ids"), "key").where("n = n_")
                       .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "at", "n", "gram", "item_ids").distinct())
    some = near.select("d", "t").distinct()
    read = texts.dropDuplicates(["doc_id", "text_hash"]).join(
        some, texts["doc_id"].eqNullSafe(some["d"]) & (texts["text_hash"] == some["t"]), "left_semi")
    met = near.join(read, read["doc_id"].eqNullSafe(near["d"]) & (read["text_hash"] == near["t"]))
    met = met.where(F.slice("w", F.col("at") + 1, F.col("n")) == F.col("gram"))
    return materialize(rows.unionByName(met.select("doc_id", "text_hash", "at", "n", "item_ids",
                                                   F.lit(None).cast("long").alias("n_words"))))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Verified occurrences: doc_id, text hash, at (word), n, item_ids. Repeated rows give theirs once."""
    found = _scan(docs, benchmark, size, max_rows).where("n_words IS NULL").drop("n_words")
    return found.dropDuplicates(["doc_id", "text_hash", "at", "n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE,
                  max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A row for each row of docs(doc_id, text): n_words, n_hit (words inside any hit), n_items,
    items_sha256 (of the items' ids, sorted as strings, comma-joined) and contaminated.

    A null or empty text has no words and is clean. Repeated rows each get their row, rows of one id
    but different texts are judged apart, a null id is an id like others; other columns are ignored."""
    scanned = _scan(docs, benchmark, size, max_rows)
    counted, found = scanned.where("n_words IS NOT NULL").select("doc_id", "text_hash", "n_words"), scanned.where("n_words IS NULL")
    # Both sums run over partial aggregates, so a document or item with very many hits is no hot key.
    covered = (found.select("doc_id", "text_hash", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("word"))
               .distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit")))
    items = (found.select("doc_id", "text_hash", F.explode("item_ids").alias("item")).distinct()
             .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("ids")))
    marks = covered.join(items, (covered["doc_id"].eqNullSafe(items["doc_id"])) & (covered["text_hash"] == items["text_hash"]))
    marks = marks.select(covered["doc_id"].alias("d"), covered["text_hash"].alias("t"), "n_hit", "ids")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (counted.join(marks, counted["doc_id"].eqNullSafe(marks["d"]) & (counted["text_hash"] == marks["t"]), "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"),
                    F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
                    ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs, all columns, without the rows whose doc_id has a contaminated text: rows of one id go or stay
    together, those without an id too; columns may have any names."""
    judged = contamination(docs, benchmark, size, share).where("contaminated").select("doc_id")
    return without(docs, materialize(judged))


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id and text without the words inside hits; text between words stays. The words of a text are
    visited in order, so a text is rewritten in one row. Texts without hits come back unchanged, repeated rows
    each, rows of one id but different texts each by its own hits; other columns are left out."""
    found = hits(docs, benchmark, size)
    gone = (found.select("doc_id", "text_hash", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("word"))
            .groupBy("doc_id", "text_hash").agg(F.collect_set("word").alias("gone"))
            .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "gone"))
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    joined = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = joined.join(gone, joined["doc_id"].eqNullSafe(gone["d"]) & (joined["text_hash"] == gone["t"]), "left")
    # The gaps keep their own letters: words have none in common with gaps, so the lower-cased text
    # splits at the same places as the text itself, and both are joined back from their parts.
    gaps = F.split(F.col("text"), WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"), -1)
    words = F.regexp_extract_all("text", F.lit(WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")), F.lit(0))
    kept = F.transform(words, lambda w, i: F.when(F.array_contains("gone", i), F.lit("")).otherwise(w))
    text = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(kept, F.slice(gaps, 2, F.size(words)),
                                                                 lambda w, g: F.concat(w, g)), ""))
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("text"))
