"""Concept graph: scoped, time-valid aliases, definitions and one-hop relations for a table of
queries(qid, text, team, product, region, process, role, as_of)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import candidate_terms
from ..session import materialize

SCOPE = ("team", "product", "region", "process", "role")
AMBIGUOUS = {"strict": "Ambiguous internal term detected under strict policy.",
             "show_both": "Term maps to multiple concepts depending on scope/time."}
STRICT_AMBIGUITY = "Ambiguous internal terminology requires manual clarification."
STRICT_MISSING = "Missing approved definition for critical concepts: "
#: Rows of the graph that every task may hold; more are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000
STRICT_INTRO = "Need verification workflow before answering this request."


def scope_ok(entity: str, context: str) -> Column:
    """Five columns must agree; NULL or '' on either side is a wildcard. Arguments are aliases."""
    ok = F.lit(True)
    for name in SCOPE:
        a, b = F.nullif(F.col(f"{entity}.{name}"), F.lit("")), F.nullif(F.col(f"{context}.{name}"), F.lit(""))
        ok = ok & F.coalesce(a == b, F.lit(True))
    return ok


def valid_at(valid_from: Column | str, valid_to: Column | str, at: Column | str) -> Column:
    start, end, t = (F.col(c) if isinstance(c, str) else c for c in (valid_from, valid_to, at))
    return (start <= t) & (end.isNull() | (end > t))


def _applies(entity: str, context: str) -> Column:
    return scope_ok(entity, context) & valid_at(f"{entity}.valid_from", f"{entity}.valid_to", f"{context}.as_of")


def _shipped(df: DataFrame) -> DataFrame:
    """One side of a graph join: broadcast if at most MAX_BROADCAST_ROWS rows were read of it, else sorted and merged. Left to
    the optimiser, whose sizes miss explodes and joins, the queries' side could be broadcast."""
    return df.hint("broadcast" if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else "merge")


def _contexts(df: DataFrame) -> DataFrame:
    """What a definition or relation of a concept depends on, once however many queries ask."""
    return df.select("concept_id", *SCOPE, "as_of").distinct()


def _same_context(a: str, b: str) -> Column:
    same = F.col(f"{a}.concept_id") == F.col(f"{b}.concept_id")
    for name in (*SCOPE, "as_of"):
        same = same & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return same


def _dealt(queries: DataFrame) -> DataFrame:
    """Queries by id: their terms cost far more than reading them, and what follows groups and joins by query."""
    return queries.repartition("qid")


def _with_terms(queries: DataFrame, *columns: str) -> DataFrame:
    """The columns and _terms, dealt by id once more: Spark no longer knows how rows lie that went through Python, and
    would exchange all matches of the terms and whatever is joined to them."""
    return _dealt(_dealt(queries).select(*columns, candidate_terms("text").alias("_terms")))


def _each_term(asked: DataFrame) -> DataFrame:
    # Outer, as a condition on the array would be pushed below the exchange and take the terms a second time.
    return asked.select("qid", *SCOPE, "as_of", F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())


def query_terms(queries: DataFrame) -> DataFrame:
    return _each_term(_with_terms(queries, "qid", *SCOPE, "as_of"))


def resolve_aliases(terms: DataFrame, aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """Active aliases of approved concepts that match a term, in scope and valid."""
    live = concepts.where(F.col("status") == "approved").select(
        F.col("id").alias("concept_id"), F.col("key").alias("concept_key"), F.col("label").alias("concept_label"),
        "criticality")
    usable = (aliases.where(F.col("status") == "active").join(live, "concept_id"))
    t, a = terms.alias("t"), _shipped(usable).alias("a")
    return (t.join(a, (F.col("t.term") == F.col("a.alias_normalized")) & _applies("a", "t"))
            .select("t.qid", *[f"t.{s}" for s in SCOPE], "t.as_of", F.col("a.id").alias("alias_id"), "a.alias",
                    "a.alias_normalized", F.col("a.confidence").alias("alias_confidence"), "a.concept_id",
                    "a.concept_key", "a.concept_label", "a.criticality"))


def best_definitions(matches: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per (query, concept) the approved definition with the highest confidence, then the latest
    start, then the smallest id."""
    wanted = matches.select("qid", *SCOPE, "as_of", "concept_id").dropDuplicates(["qid", "concept_id"])
    best = _shipped(materialize(_context_definitions(wanted, definitions)))
    return (wanted.alias("m").join(best.alias("b"), _same_context("m", "b"))
            .select("m.qid", "m.concept_id", "b.definition_id", "b.definition", "b.definition_confidence"))


def _context_definitions(matches: DataFrame, definitions: DataFrame) -> DataFrame:
    d = _shipped(definitions.where(F.col("status") == "approved")).alias("d")
    m = _contexts(matches).alias("m")
    context = ["concept_id", *SCOPE, "as_of"]
    order = W.partitionBy(*context).orderBy(F.desc("confidence"), F.desc("valid_from"), "definition_id")
    return (m.join(d, (F.col("m.concept_id") == F.col("d.concept_id")) & _applies("d", "m"))
            .select(*[f"m.{c}" for c in context], F.col("d.id").alias("definition_id"), "d.definition", "d.confidence",
                    "d.valid_from")
            .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1)
            .select(*context, "definition_id", "definition", F.col("confidence").alias("definition_confidence")))


def resolved_concepts(matches: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per (query, alias, concept), the smallest alias id first, with its definition."""
    once = (matches.groupBy("qid", "alias_normalized", "concept_id")
            .agg(F.min_by(F.struct("alias", "alias_confidence", "concept_key", "concept_label", "criticality",
                                   "as_of", *SCOPE), "alias_id").alias("m")))
    best = _shipped(materialize(_context_definitions(matches, definitions))).alias("b")
    flat = once.select("qid", "alias_normalized", "concept_id", "m.*").alias("m")
    return (flat.join(best, _same_context("m", "b"), "left")
            .select("m.qid", "m.concept_id", "m.concept_key", "m.concept_label", "m.alias", "m.alias_normalized",
                    "b.definition_id", "b.definition",
                    F.coalesce("b.definition_confidence", "m.alias_confidence").alias("confidence"),
                    "m.criticality", "m.as_of", *[f"m.{s}" for s in SCOPE]))


def unresolved(terms: DataFrame, matches: DataFrame) -> DataFrame:
    seen = matches.select("qid", F.col("alias_normalized").alias("term")).distinct()
    return terms.select("qid", "term").join(seen.hint("merge"), ["qid", "term"], "left_anti")


def ambiguities(resolved: DataFrame, policy: str = "show_both") -> DataFrame:
    keys = F.array_sort(F.collect_set("concept_key"))
    return (resolved.groupBy("qid", F.col("alias_normalized").alias("term")).agg(keys.alias("candidates"))
            .where(F.size("candidates") > 1).withColumn("reason", F.lit(AMBIGUOUS[policy])))


class HintLists(NamedTuple):
    """The hints of queries without their texts. numbers: qid and, in the order of the relations, the places of its hints
    in texts, an array of all hints of a graph of at most MAX_BROADCAST_ROWS relations."""

    numbers: DataFrame
    texts: Column


def graph_hints(resolved: DataFrame, relationships: DataFrame, concepts: DataFrame, listed: bool = False) -> DataFrame | HintLists:
    """Approved outgoing relations of the resolved concepts as 'FROM type TO'. listed: as HintLists, if the graph is small
    enough, for who puts them into a query's text. There a hint is a number until the text is made, which is neither
    sorted nor exchanged."""
    sources = resolved.select("qid", "concept_id", "as_of", *SCOPE).dropDuplicates(["qid", "concept_id"]).alias("s")
    f = concepts.select(F.col("id").alias("from_id"), F.col("key").alias("_from"))
    t = concepts.select(F.col("id").alias("to_id"), F.col("key").alias("_to"))
    edges = relationships.where(F.col("status") == "approved").join(f.hint("merge"), "from_id", "left").join(t.hint("merge"), "to_id", "left")
    hint = F.concat_ws(" ", F.coalesce("_from", F.col("from_id").cast("string")), "relation_type",
                       F.coalesce("_to", F.col("to_id").cast("string")))
    edges = edges.select("id", "from_id", *SCOPE, "valid_from", "valid_to", hint.alias("hint"))
    if listed:
        edges = materialize(edges)
        if edges.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
            return _hint_lists(sources, edges)
    named = _shipped(edges).alias("e")
    return (sources.join(named, (F.col("s.concept_id") == F.col("e.from_id")) & _applies("e", "s"))
            .select("s.qid", F.col("e.id").alias("relation_id"), "e.hint"))


def _hint_lists(sources: DataFrame, edges: DataFrame) -> HintLists:
    edges = materialize(edges.withColumn("_n", F.row_number().over(W.orderBy("id", "hint")) - 1))  # at most MAX_BROADCAST_ROWS
    texts = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "hint"))), lambda e: e["hint"])).scalar()
    entry = F.struct("_n", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in SCOPE], "valid_from", "valid_to")
    out = edges.groupBy("from_id").agg(F.collect_list(entry).alias("_edges"))

    def applies(e: Column) -> Column:
        ok = valid_at(e["valid_from"], e["valid_to"], F.col("s.as_of"))
        for name in SCOPE:
            ok = ok & F.coalesce(e[name] == F.nullif(F.col(f"s.{name}"), F.lit("")), F.lit(True))
        return ok
    met = sources.join(F.broadcast(out), F.col("s.concept_id") == F.col("from_id")).select(
        "s.qid", F.transform(F.filter("_edges", applies), lambda e: e["_n"]).alias("_numbers")).where(F.size("_numbers") > 0)
    return HintLists(met.groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list("_numbers"))).alias("_numbers")), texts)


def _ordered(entry: Column, *keys: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*keys, entry.alias("_entry"))))
    return F.transform(rows, lambda r: r["_entry"])


def _scope_json() -> Column:
    return F.to_json(F.struct(*[F.nullif(F.col(s), F.lit("")).alias(s) for s in SCOPE]))


def _expanded(meaning: Column, graph: Column) -> Column:
    """Query text with its meaning block and, if there are hints, its graph block."""
    return F.concat(
        F.col("text"), F.lit("\n\n[INTERNAL_MEANING]\n"),
        F.when(F.col("_scope") != "{}", F.concat(F.lit("Scope: "), F.col("_scope"), F.lit("\n"))).otherwise(""),
        F.lit("EffectiveAt: "), F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit("\nResolved concepts:\n"), meaning,
        F.coalesce(F.concat(F.lit("\n\n[GRAPH_RELATIONSHIPS]\n"), graph), F.lit("")))


def _with_graph(base: DataFrame, hints: DataFrame | HintLists) -> DataFrame:
    """Adds _graph, the text of each query's hints, NULL without one."""
    if not isinstance(hints, HintLists):
        lines = _ordered(F.concat(F.lit("- "), F.col("hint")), "relation_id")
        return base.join(hints.groupBy("qid").agg(F.array_join(lines, "\n").alias("_graph")).hint("merge"), "qid", "left")
    told = base.join(hints.numbers.hint("merge"), "qid", "left").withColumn("_texts", hints.texts)
    block = F.array_join(F.transform("_numbers", lambda n: F.concat(F.lit("- "), F.get("_texts", n))), "\n")
    return told.withColumn("_graph", block).drop("_numbers", "_texts")


def rewrite_queries(queries: DataFrame, resolved: DataFrame, hints: DataFrame | HintLists) -> DataFrame:
    """qid, query_text, expanded_query. A query without a resolved term stays as it is."""
    line = F.concat(F.lit("- "), F.col("concept_key"), F.lit(": "),
                    F.coalesce(F.nullif("definition", F.lit("")), F.lit("(definition missing)")))
    meaning = resolved.groupBy("qid").agg(
        F.array_join(_ordered(line, "alias_normalized", "concept_key", "concept_id"), "\n").alias("_meaning"))
    text = _expanded(F.col("_meaning"), F.col("_graph"))
    return (_with_graph(queries.join(meaning.hint("merge"), "qid", "left"), hints).withColumn("_scope", _scope_json())
            .select("qid", F.col("text").alias("query_text"),
                    F.when(F.col("_meaning").isNull(), F.col("text")).otherwise(text).alias("expanded_query")))


def strict_gate(queries: DataFrame, resolved: DataFrame, ambiguous: DataFrame, policy: str = "show_both",
                strict: bool = True) -> DataFrame:
    """qid and the message that blocks an answer, or NULL."""
    unclear = ambiguous.select("qid").distinct().withColumn("_unclear", F.lit(True))
    missing = (resolved.where((F.col("criticality") == "critical") & F.col("definition_id").isNull())
               .groupBy("qid").agg(F.array_join(_ordered(F.col("concept_key"), "alias_normalized", "concept_key"),
                                                ", ").alias("_missing")))
    reasons = F.filter(F.array(
        F.when(F.lit(policy == "strict") & F.col("_unclear"), F.lit(f"- {STRICT_AMBIGUITY}")),
        F.when(F.lit(strict) & F.col("_missing").isNotNull(),
               F.concat(F.lit(f"- {STRICT_MISSING}"), F.col("_missing")))), lambda r: r.isNotNull())
    return (queries.select("qid").join(unclear.hint("merge"), "qid", "left").join(missing.hint("merge"), "qid", "left")
            .withColumn("_r", reasons)
            .select("qid", F.when(F.size("_r") > 0, F.concat(F.lit(STRICT_INTRO + "\n"), F.array_join("_r", "\n")))
                    .alias("failure")))


def interpretation(resolved: DataFrame, rewritten: DataFrame) -> DataFrame:
    """One payload per query. At most a query's own terms times their concepts are collected."""
    concept = F.struct("alias_normalized", "concept_key", "concept_id", "alias", "definition_id", "confidence")
    payload = resolved.groupBy("qid").agg(
        F.array_sort(F.collect_set("alias_normalized")).alias("detected_terms"),
        F.array_sort(F.collect_list(concept)).alias("resolved_concepts"),
        F.array_sort(F.collect_set("definition_id")).alias("definition_ids"))
    out = rewritten.join(payload.hint("merge"), "qid", "left")
    for name in ("detected_terms", "resolved_concepts", "definition_ids"):
        kind = payload.schema[name].dataType.simpleString()
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out.select("qid", "detected_terms", "resolved_concepts", "definition_ids",
                      F.col("expanded_query").alias("rewritten_query"))


def interpret(queries: DataFrame, graph: dict[str, DataFrame], policy: str = "show_both", strict: bool = True,
              graph_enabled: bool = True) -> DataFrame:
    """The whole interpretation: expanded query, payload, ambiguities, unknown terms, gate. One
    aggregate per query feeds everything but the graph hints."""
    asked = _with_terms(queries, *queries.columns)
    terms = _each_term(asked)
    resolved = resolved_concepts(resolve_aliases(terms, graph["aliases"], graph["concepts"]), graph["definitions"])
    row = F.struct("alias_normalized", "concept_key", "concept_id", "alias", "definition_id", "definition",
                   "confidence", "criticality")
    found = resolved.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    base = asked.join(found.hint("merge"), "qid", "left")
    if graph_enabled:
        base = _with_graph(base, graph_hints(resolved, graph["relationships"], graph["concepts"], listed=True))
    kind = found.schema["_rows"].dataType.simpleString()
    base = base.withColumn("_rows", F.coalesce("_rows", F.array().cast(kind)))
    base = base.withColumn("detected_terms", F.array_distinct(F.transform("_rows", lambda r: r["alias_normalized"])))

    def candidates(term: Column) -> Column:
        return F.array_distinct(F.transform(F.filter("_rows", lambda r: r["alias_normalized"] == term),
                                            lambda r: r["concept_key"]))
    doubtful = F.filter(F.transform("detected_terms", lambda t: F.struct(
        t.alias("term"), candidates(t).alias("candidates"), F.lit(AMBIGUOUS[policy]).alias("reason"))),
        lambda a: F.size(a["candidates"]) > 1)
    missing = F.filter("_rows", lambda r: (r["criticality"] == "critical") & r["definition_id"].isNull())
    reasons = F.filter(F.array(
        F.when(F.lit(policy == "strict") & (F.size("ambiguities") > 0), F.lit(f"- {STRICT_AMBIGUITY}")),
        F.when(F.lit(strict) & (F.size("_missing") > 0), F.concat(
            F.lit(f"- {STRICT_MISSING}"), F.array_join(F.transform("_missing", lambda r: r["concept_key"]), ", ")))),
        lambda r: r.isNotNull())
    line = F.transform("_rows", lambda r: F.concat(
        F.lit("- "), r["concept_key"], F.lit(": "), F.coalesce(F.nullif(r["definition"], F.lit("")),
                                                              F.lit("(definition missing)"))))
    expanded = _expanded(F.array_join(line, "\n"), F.col("_graph")) if graph_enabled else F.col("text")
    return (base.withColumn("_scope", _scope_json()).withColumn("ambiguities", doubtful)
            .withColumn("_missing", missing).withColumn("_r", reasons)
            .select("qid", "detected_terms",
                    F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in (
                        "alias_normalized", "concept_key", "concept_id", "alias", "definition_id", "confidence")]))
                    .alias("resolved_concepts"),
                    F.array_sort(F.array_distinct(F.filter(F.transform("_rows", lambda r: r["definition_id"]),
                                                           lambda d: d.isNotNull()))).alias("definition_ids"),
                    F.when(F.size("_rows") == 0, F.col("text")).otherwise(expanded).alias("rewritten_query"),
                    F.array_sort(F.array_except("_terms", "detected_terms")).alias("unknown_terms"), "ambiguities",
                    F.when(F.size("_r") > 0, F.concat(F.lit(STRICT_INTRO + "\n"), F.array_join("_r", "\n")))
                    .alias("failure")))
