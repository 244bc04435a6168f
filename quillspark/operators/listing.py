"""Listings, paging, folders, conversations and bulk edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import display_filename, trim_unicode
from .skew import split_row_number

MAX_FOLDER = 128


def keyset_page(df: DataFrame, order_col: str, id_col: str, limit: int = 50, cursor=None, cursor_id=None,
                max_limit: int = 200) -> DataFrame:
    """One page, newest first, with has_next and next_cursor on every row. A cursor of the time
    alone follows the plain rule (ts < cursor); with cursor_id rows of an equal time are not lost."""
    limit = max(1, min(limit, max_limit))
    rows = df
    if cursor is not None:
        at = cursor if isinstance(cursor, Column) else F.try_to_timestamp(F.lit(cursor))
        before = F.col(order_col) < at
        if cursor_id is not None:
            before = before | ((F.col(order_col) == at) & (F.col(id_col) > cursor_id))
        rows = rows.where(F.coalesce(before, F.lit(True)))
    head = rows.orderBy(F.desc(order_col), F.asc(id_col)).limit(limit + 1)
    packed = head.agg(F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros(F.col(order_col).cast("timestamp"))).alias("_o"), F.col(id_col).alias("_i"), F.struct(*df.columns).alias("_row"))))
        .alias("_all"))
    more = F.size("_all") > limit
    kept = packed.select(F.slice("_all", 1, limit).alias("_kept"), more.alias("has_next"))
    return (kept.select(F.posexplode("_kept").alias("_pos", "_e"), "has_next",
                        F.when(F.col("has_next"), F.element_at("_kept", -1)["_row"][order_col]).alias("next_cursor"))
            .select("_e._row.*", (F.col("_pos") + 1).alias("position"), "has_next", "next_cursor"))


def assign_pages(df: DataFrame, key: str, order_col: str, id_col: str, limit: int = 20,
                 bucket: Column | None = None) -> DataFrame:
    """Page number of every row within its key, newest first."""
    cut = bucket if bucket is not None else F.date_trunc("day", F.col(order_col))
    ranked = split_row_number(df, [key], cut, [F.desc(order_col), F.asc(id_col)], "position", descending=True)
    return ranked.withColumn("page", F.floor((F.col("position") - 1) / limit).cast("bigint"))


def folders(documents: DataFrame) -> DataFrame:
    name = trim_unicode("folder_name")
    return (documents.select(name.alias("folder_name")).where(F.col("folder_name") != "").distinct()
            .orderBy("folder_name"))


def filter_documents(documents: DataFrame, folder: str = "__all__", text: str = "") -> DataFrame:
    name = F.coalesce(trim_unicode("folder_name"), F.lit(""))
    in_folder = {"__all__": F.lit(True), "__unsorted__": name == ""}.get(folder, name == folder)
    wanted = F.lit(text.lower())
    return documents.where(in_folder & (F.contains(F.lower(display_filename("filename")), wanted)
                                        | F.contains(F.lower("filename"), wanted)))


def move_folders(documents: DataFrame, updates: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """updates(doc_id, folder_name): (new snapshot, refused updates). NULL or blank clears."""
    name = F.nullif(trim_unicode("folder_name"), F.lit(""))
    checked = updates.select("doc_id", name.alias("_folder")).withColumn(
        "_ok", F.coalesce(F.length("_folder") <= MAX_FOLDER, F.lit(True)))
    good = checked.where("_ok").select("doc_id", "_folder", F.lit(True).alias("_hit"))
    moved = (documents.join(good, "doc_id", "left")
             .withColumn("folder_name", F.when(F.col("_hit"), F.col("_folder")).otherwise(F.col("folder_name")))
             .withColumn("updated_at", F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at")))
             .select(*documents.columns))
    known = documents.select("doc_id")
    refused = (checked.where(~F.col("_ok")).select("doc_id", F.lit("DOCUMENT_FOLDER_INVALID").alias("code"))
               .unionByName(checked.where("_ok").join(known, "doc_id", "left_anti")
                            .select("doc_id", F.lit("DOCUMENT_NOT_FOUND").alias("code"))))
    return moved, refused


def cascade_delete(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New snapshots without the parents in ids and without their children."""
    gone = ids.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def load_conversations(messages: DataFrame) -> DataFrame:
    """messages(.., sources array<struct>) in order, with older source shapes filled in."""
    def repaired(s: Column) -> Column:
        title = F.coalesce(s["filename"], s["title"])
        boxes = F.coalesce(s["highlight_boxes"], F.when(s["bounding_box"].isNotNull(), F.array(s["bounding_box"])))
        return (s.withField("filename", title)
                .withField("original_filename", F.coalesce(s["original_filename"], title))
                .withField("highlight_boxes", boxes))
    return messages.withColumn("sources", F.transform("sources", repaired)).orderBy("conv_id", "turn")


def sync_users(users: DataFrame, logins: DataFrame, allow: list[str], as_of: Column) -> DataFrame:
    """users(id, email, role, updated_at), logins(email): unknown emails are added, and the role of
    everyone who logged in follows the allow-list."""
    admins = [a.strip().lower() for a in allow if a.strip()]
    role = F.when(F.col("email").isin(admins), "admin").otherwise("user") if admins else F.lit("user")
    seen = (logins.select(F.lower(trim_unicode("email")).alias("email")).where(F.contains("email", F.lit("@")))
            .distinct().withColumn("_seen", F.lit(True)))
    merged = users.alias("u").join(seen, "email", "full")
    changed = F.col("_seen") & (F.col("role").isNull() | (F.col("role") != F.col("_role")))
    return (merged.withColumn("_role", role)
            .select(F.coalesce(F.col("id").cast("string"), F.sha2("email", 256)).alias("id"), "email",
                    F.when(F.col("_seen"), F.col("_role")).otherwise(F.col("role")).alias("role"),
                    F.when(changed, as_of).otherwise(F.col("updated_at")).alias("updated_at")))


def union_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.unionByName(b).dropDuplicates([key])
