"""Template profile registry files: a single profile, or {"profiles": [...], "defaultProfileId": ...}."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import BOX

_PROFILE = (f"id:string,version:int,name:string,description:string,matchThreshold:double,"
            f"anchors:array<struct<text:string,page:int,region:{BOX},weight:double>>,"
            f"boilerplatePatterns:array<string>,"
            f"sampledPages:array<struct<page:int,visualHash:string,tokenHash:string>>")
_FILE = (f"struct<{_PROFILE},defaultProfileId:string,profiles:array<struct<{_PROFILE}>>,_corrupt:string>")


@dataclass
class Registry:
    profiles: DataFrame
    anchors: DataFrame
    patterns: DataFrame
    sampled: DataFrame
    warnings: DataFrame


def load_profiles(spark: SparkSession, path: str) -> Registry:
    """Malformed profiles, anchors, patterns and page entries are dropped; unreadable files and files
    of another shape give a warning row each."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = text.withColumn("p", F.from_json("value", _FILE, {"mode": "PERMISSIVE",
                                                              "columnNameOfCorruptRecord": "_corrupt"}))
    single = F.struct(*[F.col(f"p.{n}") for n in ("id", "version", "name", "description", "matchThreshold",
                                                  "anchors", "boilerplatePatterns", "sampledPages")])
    entries = F.coalesce("p.profiles", F.array(single))
    named = (F.trim(F.coalesce("e.id", F.lit(""))) != "") & (F.trim(F.coalesce("e.name", F.lit(""))) != "")
    listed = (parsed.where(F.col("p._corrupt").isNull())
              .select("file", F.col("p.profiles").isNotNull().alias("_registry"),
                      F.col("p.defaultProfileId").alias("default_id"), F.posexplode(entries).alias("ord", "e"))
              .withColumn("_ok", named))
    good = listed.where("_ok").withColumn("profile_id", F.trim("e.id"))
    unreadable = parsed.where(F.col("p._corrupt").isNotNull()).select(
        F.concat(F.lit("profile_file_unreadable:"), "file").alias("warning"))
    shapeless = listed.where(~F.col("_ok") & ~F.col("_registry")).select(
        F.concat(F.lit("profile_file_invalid_structure:"), "file").alias("warning"))
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("e.matchThreshold")))
    anchors = (good.select("profile_id", F.posexplode("e.anchors").alias("_pos", "a"))
               .where(F.trim(F.coalesce("a.text", F.lit(""))) != ""))
    complete = F.lit(True)
    for n in ("x", "y", "width", "height"):
        complete = complete & F.col(f"a.region.{n}").isNotNull()
    return Registry(
        profiles=good.select("profile_id", "ord", F.trim("e.name").alias("name"),
                             F.when(F.col("e.matchThreshold").isNotNull(), clamp).alias("match_threshold"),
                             (F.col("default_id") == F.col("profile_id")).alias("is_default")),
        anchors=anchors.select("profile_id", F.col("_pos").alias("anchor_no"), F.trim("a.text").alias("text"),
                               F.col("a.page").alias("page"), F.when(complete, F.col("a.region")).alias("region"),
                               F.col("a.weight").alias("weight")),
        patterns=good.select("profile_id", F.explode("e.boilerplatePatterns").alias("pattern"))
        .where(F.trim(F.coalesce("pattern", F.lit(""))) != ""),
        sampled=good.select("profile_id", F.explode("e.sampledPages").alias("s"))
        .where((F.col("s.page") > 0) & (F.coalesce("s.visualHash", F.lit("")) != ""))
        .select("profile_id", "s.page", F.col("s.visualHash").alias("visual_hash"),
                F.col("s.tokenHash").alias("token_hash")),
        warnings=unreadable.unionByName(shapeless))
