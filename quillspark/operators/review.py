"""Term review: queue, batch approval and rejection as delta tables, and graph audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import normalize_term, trim_unicode, upper_single
from .concepts import SCOPE


def review_queue(candidates: DataFrame, status: str = "pending", limit: int = 50) -> DataFrame:
    return (candidates.where(F.col("status") == status).orderBy(F.desc("detected_at"), "id").limit(limit))


def approve(decisions: DataFrame, state: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """decisions(candidate_id, concept_key, concept_label, definition, reviewer_id, confidence,
    criticality) applied to state(candidates, concepts, definitions, aliases). Returns the rows to
    add (concepts, definitions, aliases, evidence, reviews), the updated candidates and the
    rejected decisions (unknown candidate or empty key). Several approvals of one concept in a
    batch take consecutive versions in candidate order. Candidates carry the five scope columns."""
    c = state["candidates"].withColumnRenamed("id", "candidate_id")
    key = upper_single(trim_unicode("concept_key"))
    joined = decisions.withColumn("_key", key).join(
        c.withColumnRenamed("confidence", "_candidate_confidence"), "candidate_id", "left")
    valid = F.col("term_original").isNotNull() & (F.coalesce("_key", F.lit("")) != "")
    errors = joined.where(~valid).select(
        "candidate_id", F.when(F.col("term_original").isNull(), "candidate_not_found")
        .otherwise("concept_key_required").alias("error"))
    known = state["concepts"].select(F.col("id").alias("_known_id"), F.col("key").alias("_key"))
    work = (joined.where(valid).join(known, "_key", "left")
            .withColumn("concept_id", F.coalesce("_known_id", F.sha2(F.col("_key"), 256))))

    new_concepts = (work.where(F.col("_known_id").isNull()).groupBy("_key", "concept_id")
                    .agg(F.min_by(F.struct("concept_label", "criticality", "reviewer_id"), "candidate_id").alias("f"))
                    .select(F.col("concept_id").alias("id"), F.col("_key").alias("key"),
                            trim_unicode("f.concept_label").alias("label"), F.lit("approved").alias("status"),
                            F.coalesce("f.criticality", F.lit("normal")).alias("criticality"),
                            F.col("f.reviewer_id").alias("approved_by")))
    latest = state["definitions"].groupBy("concept_id").agg(F.max("version").alias("_latest"))
    order = W.partitionBy("concept_id").orderBy("candidate_id")
    versioned = (work.join(latest, "concept_id", "left")
                 .withColumn("version", F.coalesce("_latest", F.lit(0)) + F.row_number().over(order))
                 .withColumn("definition_id", F.sha2(F.concat_ws("|", "concept_id", "version"), 256)))
    definitions = versioned.select(
        F.col("definition_id").alias("id"), "concept_id", "version", trim_unicode("definition").alias("definition"),
        F.lit("approved").alias("status"),
        F.coalesce("confidence", "_candidate_confidence", F.lit(0.7)).alias("confidence"), *SCOPE,
        as_of.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        F.col("document_id").alias("source_document_id"), F.col("reviewer_id").alias("approved_by"))

    with_alias = versioned.withColumn("alias_normalized", normalize_term("term_original"))
    old = (state["aliases"].groupBy("concept_id", "alias_normalized").agg(F.min("id").alias("_old_alias")))
    linked = (with_alias.join(old, ["concept_id", "alias_normalized"], "left")
              .withColumn("alias_id", F.coalesce("_old_alias", F.sha2(
                  F.concat_ws("|", "concept_id", "alias_normalized"), 256))))
    first = F.min_by(F.struct("term_original", "_candidate_confidence", "reviewer_id", *SCOPE), "candidate_id")
    aliases = (linked.where(F.col("_old_alias").isNull()).groupBy("alias_id", "concept_id", "alias_normalized")
               .agg(first.alias("f"))
               .select(F.col("alias_id").alias("id"), "concept_id", F.col("f.term_original").alias("alias"),
                       "alias_normalized", *[f"f.{s}" for s in SCOPE], F.lit("active").alias("status"),
                       F.col("f._candidate_confidence").alias("confidence"), as_of.alias("valid_from"),
                       F.lit(None).cast("timestamp").alias("valid_to"), F.col("f.reviewer_id").alias("approved_by")))
    evidence = (linked.where((F.size("contexts") > 0) | F.col("document_id").isNotNull())
                .select("concept_id", F.col("definition_id").alias("definition_version_id"), "alias_id", "document_id",
                        "source_type", F.coalesce(F.try_element_at("contexts", F.lit(1)), "term_original")
                        .alias("excerpt"), *SCOPE))
    approved = work.select("candidate_id", F.col("_key").alias("_new_key"), F.col("reviewer_id").alias("_reviewer"))
    hit = F.col("_new_key").isNotNull()
    candidates = (c.join(approved, "candidate_id", "left")
                  .withColumn("status", F.when(hit, "approved").otherwise(F.col("status")))
                  .withColumn("candidate_concept_key", F.col("_new_key"))
                  .withColumn("reviewed_by", F.col("_reviewer"))
                  .withColumn("reviewed_at", F.when(hit, as_of))
                  .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
                  .drop("_new_key", "_reviewer").withColumnRenamed("candidate_id", "id"))
    reviews = versioned.select("candidate_id", "concept_id", F.col("definition_id").alias("definition_version_id"),
                               "reviewer_id", F.lit("approved").alias("decision"),
                               F.lit("Approved via review workflow").alias("notes"))
    return {"concepts": new_concepts, "definitions": definitions, "aliases": aliases, "evidence": evidence,
            "candidates": candidates, "reviews": reviews, "errors": errors}


def reject(decisions: DataFrame, candidates: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """decisions(candidate_id, reviewer_id, notes)."""
    d = decisions.select(F.col("candidate_id").alias("id"), F.col("reviewer_id").alias("_reviewer"), "notes")
    hit = F.col("_hit")
    updated = (candidates.join(d.drop("notes").withColumn("_hit", F.lit(True)), "id", "left")
               .withColumn("status", F.when(hit, "rejected").otherwise(F.col("status")))
               .withColumn("reviewed_by", F.col("_reviewer")).withColumn("reviewed_at", F.when(hit, as_of))
               .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
               .drop("_hit", "_reviewer"))
    reviews = (d.join(candidates.select("id"), "id", "left_semi")
               .select(F.col("id").alias("candidate_id"), F.lit(None).cast("string").alias("concept_id"),
                       F.col("_reviewer").alias("reviewer_id"), F.lit("rejected").alias("decision"),
                       F.coalesce("notes", F.lit("Rejected via review workflow")).alias("notes")))
    errors = (d.join(candidates.select("id"), "id", "left_anti")
              .select(F.col("id").alias("candidate_id"), F.lit("candidate_not_found").alias("error")))
    return {"candidates": updated, "reviews": reviews, "errors": errors}


def duplicate_keys(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    """Groups that break a unique key: null_safe counts NULL as equal, sql_null as SQL does
    (a NULL in any key column exempts the row)."""
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    over = (df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
            .agg(F.count("*").alias("null_safe"), F.count_if(full).alias("sql_null")))
    return over.select(F.lit(check).alias("check"), "null_safe", "sql_null")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, check: str) -> DataFrame:
    ids = parent.select(F.col(pk).alias(fk))
    return (child.where(F.col(fk).isNotNull()).select(fk).join(ids, fk, "left_anti").agg(F.count("*").alias("null_safe"))
            .select(F.lit(check).alias("check"), "null_safe", F.col("null_safe").alias("sql_null")))


def graph_audit(state: dict[str, DataFrame]) -> DataFrame:
    """Uniqueness and reference checks of the graph tables: check, null_safe, sql_null."""
    scope = list(SCOPE)
    checks = [
        duplicate_keys(state["concepts"], ["key"], "concepts.key"),
        duplicate_keys(state["aliases"], ["alias_normalized", *scope, "valid_from"], "aliases.scope"),
        duplicate_keys(state["definitions"], ["concept_id", "version"], "definitions.version"),
        duplicate_keys(state["relationships"], ["from_id", "to_id", "relation_type", *scope, "valid_from"],
                       "relationships.scope"),
        orphans(state["aliases"], "concept_id", state["concepts"], "id", "aliases.concept"),
        orphans(state["definitions"], "concept_id", state["concepts"], "id", "definitions.concept"),
        orphans(state["relationships"], "from_id", state["concepts"], "id", "relationships.from"),
        orphans(state["relationships"], "to_id", state["concepts"], "id", "relationships.to"),
    ]
    return reduce(DataFrame.unionByName, checks)
