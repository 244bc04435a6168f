"""Queries for the concept graph, listings and request analytics (G, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A, concepts as G, listing as L, mining as N, quota as Q, review as V, temporal as TJ
from ..functions import geometry as B
from .catalog import AS_OF, SQL_CORPUS, Tables, as_of, register, sql_term

from .text_queries import messages, sql_candidates

# --- G: concept graph -------------------------------------------------------------------------
# Part names are the terminology: every name is a concept, its words are aliases (so a noun is
# ambiguous), brands give definitions, and neighbouring parts give relations. Queries mention
# one part each, asked by a team (the part type) at a time given by its size.


def day(col):
    return F.timestamp_add("DAY", col.cast("int"), F.lit("2024-01-01").cast("timestamp"))


def part_queries(t: Tables):
    text = F.concat(F.lit("Je to "), F.upper("p_type"), F.lit(" "), F.col("p_name"), F.lit(" pro "), "p_brand", F.lit("?"))
    none = F.lit(None).cast("string")
    return t.part.select(
        F.col("p_partkey").alias("qid"), text.alias("text"),
        F.when(F.col("p_size") > 20, F.lower("p_type")).alias("team"), none.alias("product"), none.alias("region"),
        F.lit("").alias("process"), none.alias("role"), day(F.col("p_size")).alias("as_of"))


def part_graph(t: Tables):
    none = F.lit(None).cast("string")
    scope = [none.alias("product"), none.alias("region"), none.alias("process"), none.alias("role")]
    names = t.part.groupBy("p_name").agg(
        F.min("p_partkey").alias("k"), F.min("p_size").alias("s"), F.max("p_size").alias("z"), F.min("p_type").alias("ty"))
    concepts = names.select(
        F.col("p_name").alias("id"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("key"),
        F.initcap("p_name").alias("label"), F.when(F.col("k") % 11 == 0, "deprecated").otherwise("approved").alias("status"),
        F.when(F.col("k") % 3 == 0, "critical").otherwise("normal").alias("criticality"))
    words = names.select("*", F.posexplode(F.concat(F.array("p_name"), F.split("p_name", " "))).alias("pos", "alias"))
    aliases = words.select(
        F.concat_ws("#", "p_name", F.col("pos").cast("string")).alias("id"), F.col("p_name").alias("concept_id"), "alias",
        F.col("alias").alias("alias_normalized"), F.when(F.col("pos") == 1, F.lower("ty")).alias("team"), *scope,
        F.when(F.col("k") % 7 == 0, "deprecated").otherwise("active").alias("status"),
        (F.lit(0.5) + F.col("pos") / 10).alias("confidence"), day(F.col("s") + F.col("pos")).alias("valid_from"),
        F.when(F.col("pos") == 2, day(F.lit(40))).alias("valid_to"))
    by_brand = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("s"),
                                                       F.min("p_type").alias("ty"))
    definitions = by_brand.select(
        F.concat_ws("#", "p_name", "p_brand").alias("id"), F.col("p_name").alias("concept_id"),
        F.col("k").cast("int").alias("version"), F.concat(F.lit("as made by "), "p_brand").alias("definition"),
        F.when(F.col("k") % 2 == 0, "approved").otherwise("draft").alias("status"),
        (F.lit(0.5) + F.col("k") % 4 / 10).alias("confidence"), F.when(F.col("s") > 25, F.lower("ty")).alias("team"), *scope,
        day(F.col("s")).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    a = t.part.select((F.col("p_partkey") + 1).alias("k"), F.col("p_name").alias("from_id"))
    b = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("to_id"), F.lower("p_type").alias("relation_type"),
                      "p_size")
    edges = a.join(b, "k").groupBy("from_id", "to_id", "relation_type").agg(F.min("k").alias("k"), F.min("p_size").alias("s"))
    relationships = edges.select(
        F.concat_ws("#", "from_id", "to_id", "relation_type").alias("id"), "from_id", "to_id", "relation_type",
        F.when(F.col("k") % 5 == 0, "approved").otherwise("draft").alias("status"), none.alias("team"), *scope,
        day(F.col("s")).alias("valid_from"), day(F.lit(45)).alias("valid_to"))
    return {"concepts": concepts, "aliases": aliases, "definitions": definitions, "relationships": relationships}


def sql_day(x: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_days(({x})::INT)"


QUERY_TEXT = "'Je to ' || upper(p_type) || ' ' || p_name || ' pro ' || p_brand || '?'"
SQL_GRAPH = f"""
queries AS (
  SELECT p_partkey AS qid, {QUERY_TEXT} AS text, CASE WHEN p_size > 20 THEN lower(p_type) END AS team, {sql_day('p_size')} AS as_of FROM part),
names AS (SELECT p_name, min(p_partkey) AS k, min(p_size) AS s, min(p_type) AS ty FROM part GROUP BY p_name),
concepts AS (
  SELECT p_name AS id, upper(replace(p_name, ' ', '_')) AS key, CASE WHEN k % 11 = 0 THEN 'deprecated' ELSE 'approved' END AS status,
         CASE WHEN k % 3 = 0 THEN 'critical' ELSE 'normal' END AS criticality FROM names),
words AS (SELECT *, unnest(list_concat([p_name], string_split(p_name, ' '))) AS alias,
                 generate_subscripts(list_concat([p_name], string_split(p_name, ' ')), 1) - 1 AS pos FROM names),
aliases AS (
  SELECT p_name || '#' || pos AS id, p_name AS concept_id, alias, CASE WHEN pos = 1 THEN lower(ty) END AS team,
         CASE WHEN k % 7 = 0 THEN 'deprecated' ELSE 'active' END AS status, 0.5 + pos / 10.0 AS confidence,
         {sql_day('s + pos')} AS valid_from, CASE WHEN pos = 2 THEN {sql_day('40')} END AS valid_to FROM words),
definitions AS (
  SELECT p_name || '#' || p_brand AS id, p_name AS concept_id, min(p_partkey) AS version, 'as made by ' || p_brand AS definition,
         CASE WHEN min(p_partkey) % 2 = 0 THEN 'approved' ELSE 'draft' END AS status, 0.5 + min(p_partkey) % 4 / 10.0 AS confidence,
         CASE WHEN min(p_size) > 25 THEN lower(min(p_type)) END AS team, {sql_day('min(p_size)')} AS valid_from
  FROM part GROUP BY p_name, p_brand),
edges AS (
  SELECT a.p_name AS from_id, b.p_name AS to_id, lower(b.p_type) AS relation_type, min(b.p_partkey) AS k, min(b.p_size) AS s
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 GROUP BY ALL),
relationships AS (
  SELECT from_id || '#' || to_id || '#' || relation_type AS id, *, CASE WHEN k % 5 = 0 THEN 'approved' ELSE 'draft' END AS status,
         {sql_day('s')} AS valid_from, {sql_day('45')} AS valid_to FROM edges),
terms AS (SELECT qid, team, as_of, unnest({sql_candidates('text')}) AS term FROM queries),
matches AS (
  SELECT t.qid, t.team, t.as_of, a.id AS alias_id, a.alias, a.confidence AS alias_confidence, a.concept_id, c.key AS concept_key,
         c.criticality
  FROM terms t JOIN aliases a ON a.alias = t.term AND a.status = 'active' JOIN concepts c ON c.id = a.concept_id AND c.status = 'approved'
  WHERE (a.team IS NULL OR t.team IS NULL OR a.team = t.team) AND a.valid_from <= t.as_of AND (a.valid_to IS NULL OR a.valid_to > t.as_of)),
best AS (
  SELECT m.qid, m.concept_id, d.id AS definition_id, d.definition, d.confidence
  FROM (SELECT DISTINCT qid, team, as_of, concept_id FROM matches) m JOIN definitions d ON d.concept_id = m.concept_id AND d.status = 'approved'
  WHERE (d.team IS NULL OR m.team IS NULL OR d.team = m.team) AND d.valid_from <= m.as_of
  QUALIFY row_number() OVER (PARTITION BY m.qid, m.concept_id ORDER BY d.confidence DESC, d.valid_from DESC, d.id) = 1),
resolved AS (
  SELECT m.qid, m.team, m.as_of, m.concept_id, m.concept_key, m.alias, m.criticality, b.definition_id, b.definition,
         coalesce(b.confidence, m.alias_confidence) AS confidence
  FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY qid, alias, concept_id ORDER BY alias_id) = 1) m
  LEFT JOIN best b ON b.qid = m.qid AND b.concept_id = m.concept_id),
ambiguous AS (
  SELECT qid, alias AS term, array_to_string(list_sort(list(DISTINCT concept_key)), ',') AS candidates FROM resolved
  GROUP BY qid, alias HAVING count(DISTINCT concept_key) > 1),
hints AS (
  SELECT r.qid, e.id AS relation_id, f.key || ' ' || e.relation_type || ' ' || g.key AS hint
  FROM (SELECT DISTINCT qid, as_of, concept_id FROM resolved) r JOIN relationships e ON e.from_id = r.concept_id AND e.status = 'approved'
  JOIN concepts f ON f.id = e.from_id JOIN concepts g ON g.id = e.to_id WHERE e.valid_from <= r.as_of AND e.valid_to > r.as_of),
meaning AS (
  SELECT qid, string_agg('- ' || concept_key || ': ' || coalesce(definition, '(definition missing)'), chr(10)
                         ORDER BY alias, concept_key, concept_id) AS m FROM resolved GROUP BY qid),
graph AS (SELECT qid, string_agg('- ' || hint, chr(10) ORDER BY relation_id) AS g FROM hints GROUP BY qid),
expanded AS (
  SELECT q.qid, CASE WHEN m IS NULL THEN text ELSE text || chr(10) || chr(10) || '[INTERNAL_MEANING]' || chr(10)
    || CASE WHEN team IS NOT NULL THEN 'Scope: {{"team":"' || team || '"}}' || chr(10) ELSE '' END
    || 'EffectiveAt: ' || strftime(as_of, '%Y-%m-%dT%H:%M:%S.000Z') || chr(10) || 'Resolved concepts:' || chr(10) || m
    || coalesce(chr(10) || chr(10) || '[GRAPH_RELATIONSHIPS]' || chr(10) || g, '') END AS expanded_query
  FROM queries q LEFT JOIN meaning USING (qid) LEFT JOIN graph USING (qid)),
gate AS (
  SELECT q.qid, CASE WHEN u.qid IS NULL AND mi.missing IS NULL THEN NULL ELSE
    'Need verification workflow before answering this request.' || chr(10) || concat_ws(chr(10),
      CASE WHEN u.qid IS NOT NULL THEN '- Ambiguous internal terminology requires manual clarification.' END,
      CASE WHEN mi.missing IS NOT NULL THEN '- Missing approved definition for critical concepts: ' || mi.missing END) END AS failure
  FROM queries q LEFT JOIN (SELECT DISTINCT qid FROM ambiguous) u USING (qid)
  LEFT JOIN (SELECT qid, string_agg(concept_key, ', ' ORDER BY alias, concept_key) AS missing FROM resolved
             WHERE criticality = 'critical' AND definition_id IS NULL GROUP BY qid) mi USING (qid))"""


def matched(t: Tables):
    graph = part_graph(t)
    terms = G.query_terms(part_queries(t))
    return terms, G.resolve_aliases(terms, graph["aliases"], graph["concepts"]), graph


def resolved(t: Tables):
    _, matches, graph = matched(t)
    return G.resolved_concepts(matches, graph["definitions"]), graph


@register("g01_scope_ok", """
SELECT a.o_orderkey, b.o_orderkey AS other, a.o_orderstatus = b.o_orderstatus AS team_equal,
  (a.o_orderstatus = b.o_orderstatus OR b.o_orderstatus = 'P') AND (a.o_orderpriority = b.o_orderpriority OR a.o_orderpriority = '5-LOW') AS ok
FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def _(t):
    empty = F.lit(None).cast("string")
    def side(df, team, product):
        return df.select("o_orderkey", F.col("o_orderstatus").alias("raw"), team.alias("team"), product.alias("product"),
                         F.lit("").alias("region"), empty.alias("process"), empty.alias("role"))
    a = side(t.orders, F.col("o_orderstatus"), F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("a")
    b = side(t.orders, F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(""), F.col("o_orderpriority")).alias("b")
    return a.join(b, F.col("b.o_orderkey") == F.col("a.o_orderkey") + 1).select(
        "a.o_orderkey", F.col("b.o_orderkey").alias("other"), (F.col("a.raw") == F.col("b.raw")).alias("team_equal"),
        G.scope_ok("a", "b").alias("ok"))


@register("g02_valid_at", """
WITH o AS (SELECT o_orderkey, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS u FROM orders)
SELECT o_orderkey, f <= TIMESTAMP '1998-01-01' AND (u IS NULL OR u > TIMESTAMP '1998-01-01') AS valid FROM o""")
def _(t):
    from pyspark.sql import Window
    later = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    spans = t.orders.select("o_orderkey", "o_orderdate", later.alias("u"))
    return spans.select("o_orderkey", G.valid_at("o_orderdate", "u", F.lit("1998-01-01").cast("timestamp")).alias("valid"))


SQL_TERMS_OF_ORDERS = """
v AS (SELECT o_custkey % 150 AS user_id, o_orderkey, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000) AS since,
             CASE WHEN o_orderkey % 40 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000)
                                            + to_seconds((o_orderkey % 97 + 1) * (o_orderkey % 5 + 1) * 600) END AS until FROM orders)"""


def order_versions(t: Tables):
    """Orders as versions of their user's terms, dealt over the month of the events; some have no end."""
    since = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("o_orderkey") * 7919 % 2_592_000)
    hold = (F.col("o_orderkey") % 97 + 1) * (F.col("o_orderkey") % 5 + 1) * 600
    until = F.when(F.col("o_orderkey") % 40 != 0, F.timestamp_seconds(F.unix_seconds(since) + hold))
    return t.orders.select((F.col("o_custkey") % 150).alias("user_id"), "o_orderkey", since.alias("since"), until.alias("until"))


@register("g04_as_of_join", f"""
WITH {SQL_TERMS_OF_ORDERS}
SELECT event_id, user_id, o_orderkey, epoch_us(since) AS since_us FROM (
  SELECT e.event_id, e.user_id, v.o_orderkey, v.since,
         row_number() OVER (PARTITION BY e.event_id ORDER BY v.since DESC, v.o_orderkey DESC) AS rn
  FROM events e LEFT JOIN v ON v.user_id = e.user_id AND v.since <= e.ts) WHERE rn = 1""")
def _(t):
    got = TJ.as_of_join(t.events.select("event_id", "user_id", "ts"), order_versions(t), "user_id", "ts", "since", "o_orderkey",
                        ["o_orderkey", "since"])
    return got.select("event_id", "user_id", "o_orderkey", F.unix_micros("since").alias("since_us"))


@register("g02_interval_join", f"""
WITH {SQL_TERMS_OF_ORDERS}
SELECT e.event_id, e.user_id, v.o_orderkey FROM events e JOIN v ON v.user_id = e.user_id AND v.since <= e.ts
AND (v.until IS NULL OR e.ts < v.until)""")
def _(t):
    return TJ.interval_join(t.events.select("event_id", "user_id", "ts"), order_versions(t), "user_id", "ts", "since", "until").select(
        "event_id", "user_id", "o_orderkey")


@register("g03_resolve_aliases", f"""
WITH {SQL_GRAPH} SELECT qid, alias_id, concept_key, round(alias_confidence, 6) AS alias_confidence, criticality FROM matches""")
def _(t):
    _, matches, _ = matched(t)
    return matches.select("qid", "alias_id", "concept_key", F.round("alias_confidence", 6).alias("alias_confidence"), "criticality")


@register("g04_best_definitions", f"""
WITH {SQL_GRAPH} SELECT qid, concept_id, definition_id, definition, round(confidence, 6) AS definition_confidence FROM best""")
def _(t):
    _, matches, graph = matched(t)
    best = G.best_definitions(matches, graph["definitions"])
    return best.withColumn("definition_confidence", F.round("definition_confidence", 6))


@register("g05_resolved_concepts", f"""
WITH {SQL_GRAPH} SELECT qid, alias, concept_key, definition_id, round(confidence, 6) AS confidence, criticality FROM resolved""")
def _(t):
    return resolved(t)[0].select("qid", "alias", "concept_key", "definition_id", F.round("confidence", 6).alias("confidence"),
                                 "criticality")


@register("g06_unresolved", f"""
WITH {SQL_GRAPH} SELECT qid, term FROM terms t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.qid = t.qid AND m.alias = t.term)""")
def _(t):
    terms, matches, _ = matched(t)
    return G.unresolved(terms, matches)


@register("g07_ambiguities", f"""
WITH {SQL_GRAPH} SELECT qid, term, candidates, 'Term maps to multiple concepts depending on scope/time.' AS reason FROM ambiguous""")
def _(t):
    return G.ambiguities(resolved(t)[0]).withColumn("candidates", F.array_join("candidates", ","))


@register("g08_graph_hints", f"WITH {SQL_GRAPH} SELECT qid, relation_id, hint FROM hints")
def _(t):
    found, graph = resolved(t)
    return G.graph_hints(found, graph["relationships"], graph["concepts"])


@register("g09_rewrite_queries", f"WITH {SQL_GRAPH} SELECT qid, text AS query_text, expanded_query FROM expanded JOIN queries USING (qid)")
def _(t):
    found, graph = resolved(t)
    return G.rewrite_queries(part_queries(t), found, G.graph_hints(found, graph["relationships"], graph["concepts"], listed=True))


@register("g10_strict_gate", f"WITH {SQL_GRAPH} SELECT qid, failure FROM gate")
def _(t):
    found, _ = resolved(t)
    return G.strict_gate(part_queries(t), found, G.ambiguities(found, "strict"), policy="strict")


SQL_PAYLOAD = """
payload AS (
  SELECT q.qid, coalesce(array_to_string(list_sort(list(DISTINCT alias) FILTER (alias IS NOT NULL)), ','), '') AS detected_terms,
         count(concept_key) AS concepts,
         coalesce(array_to_string(list_sort(list(DISTINCT definition_id) FILTER (definition_id IS NOT NULL)), ','), '') AS definition_ids
  FROM queries q LEFT JOIN resolved r USING (qid) GROUP BY q.qid)"""


def payload_columns():
    return [F.array_join("detected_terms", ",").alias("detected_terms"),
            F.size("resolved_concepts").cast("bigint").alias("concepts"),
            F.array_join("definition_ids", ",").alias("definition_ids")]


@register("g11_interpretation", f"WITH {SQL_GRAPH}, {SQL_PAYLOAD} SELECT qid, detected_terms, concepts, definition_ids FROM payload")
def _(t):
    found, graph = resolved(t)
    rewritten = G.rewrite_queries(part_queries(t), found, G.graph_hints(found, graph["relationships"], graph["concepts"]))
    return G.interpretation(found, rewritten).select("qid", *payload_columns())


@register("g20_interpret", f"""
WITH {SQL_GRAPH}, {SQL_PAYLOAD},
unknown AS (SELECT qid, count(*) AS n FROM terms t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.qid = t.qid AND m.alias = t.term) GROUP BY qid)
SELECT qid, detected_terms, concepts, definition_ids, expanded_query AS rewritten_query, coalesce(u.n, 0) AS unknown,
       coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM ambiguous a WHERE a.qid = p.qid), '') AS ambiguous, failure
FROM payload p JOIN expanded USING (qid) JOIN gate USING (qid) LEFT JOIN unknown u USING (qid)""")
def _(t):
    out = G.interpret(part_queries(t), part_graph(t), policy="strict", strict=True)
    return out.select("qid", *payload_columns(), "rewritten_query",
                      F.coalesce(F.size("unknown_terms"), F.lit(0)).cast("bigint").alias("unknown"),
                      F.coalesce(F.array_join(F.transform("ambiguities", lambda a: a["term"]), ","), F.lit("")).alias("ambiguous"),
                      "failure")


def slang_documents(t: Tables):
    """Documents in which sentence starts of two languages introduce a term."""
    text = F.regexp_replace(F.regexp_replace("text", r"(^|\n)(The|Der) ", "$1Interně TOMU Říkáme \"$2 "), r"(^|\n)Of ", "$1Gate aka ")
    return t.documents.select("doc_id", text.alias("text"))


SQL_SLANG = """
slang AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(^|\\n)(The|Der) ', '\\1Interně TOMU Říkáme "\\2 ', 'g'),
                                        '(^|\\n)Of ', '\\1Gate aka ', 'g') AS text FROM documents)"""
SQL_PATTERNS = SQL_SLANG + f""",
slines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM slang),
found AS (
  SELECT doc_id, n, 0 AS sub, line, trim(regexp_extract(line, '(?i)(?:říkáme tomu|interně tomu říkáme)\\s+["“]?([^"\\n”]{{2,80}})["”]?', 1)) AS term FROM slines
  UNION ALL
  SELECT doc_id, n, 1, line, trim(regexp_extract(line, '(?i)(?:aka|a\\.k\\.a\\.|=)\\s+([A-Za-z0-9_\\- :]{{2,80}})', 1)) FROM slines),
pattern_terms AS (
  SELECT doc_id, term AS term_original, {sql_term('term')} AS term_normalized, left(trim(line), 500) AS context, n, sub FROM found WHERE term <> '')"""


@register("g12_mine_patterns", f"""
WITH {SQL_PATTERNS} SELECT doc_id, term_original, term_normalized, context, 0.65::DOUBLE AS confidence FROM pattern_terms
WHERE term_normalized <> ''""")
def _(t):
    return N.mine_patterns(slang_documents(t)).select("doc_id", "term_original", "term_normalized", "context", "confidence")


def sql_ngrams(source: str) -> str:
    return f"""
gw AS (SELECT doc_id, list_filter(string_split({sql_term('text')}, ' '), lambda w: length(w) BETWEEN 3 AND 30) AS w FROM {source}),
grams AS (
  SELECT doc_id, w[i] AS term, 2 * i AS spot FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM gw)
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1], 2 * i + 1 FROM (SELECT *, unnest(range(1, len(w))) AS i FROM gw)),
ngrams AS (
  SELECT doc_id, term, count(*) AS n, min(spot) AS spot FROM grams GROUP BY doc_id, term HAVING count(*) >= 3
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(spot)) <= 100)"""


@register("g13_mine_ngrams", f"""
WITH {sql_ngrams('documents')}
SELECT doc_id, term AS term_normalized, round(least(0.6, 0.2 + n * 0.05), 6) AS confidence, n AS occurrences FROM ngrams""")
def _(t):
    return N.mine_ngrams(t.documents).select("doc_id", "term_normalized", F.round("confidence", 6).alias("confidence"),
                                             "occurrences")


SQL_CANDIDATES = f"""{SQL_PATTERNS}, {sql_ngrams('slang')},
every AS (
  SELECT doc_id, term_original, term_normalized, context, 0.65 AS confidence, 1 AS occ, (0, n, sub) AS ord FROM pattern_terms WHERE term_normalized <> ''
  UNION ALL SELECT doc_id, term, term, '', least(0.6, 0.2 + n * 0.05), n, (1, spot, 0) FROM ngrams),
mined AS (
  SELECT doc_id, term_normalized, arg_min(term_original, ord) AS term_original, max(confidence) AS confidence,
         coalesce(arg_min(context, ord) FILTER (context <> ''), '') AS context, sum(occ)::BIGINT AS occurrences FROM every GROUP BY ALL)"""


@register("g14_dedupe_candidates", f"""
WITH {SQL_CANDIDATES} SELECT doc_id, term_normalized, term_original, round(confidence, 6) AS confidence, context, occurrences FROM mined""")
def _(t):
    return N.mine_candidates(slang_documents(t)).select(
        "doc_id", "term_normalized", "term_original", F.round("confidence", 6).alias("confidence"), "context", "occurrences")


def candidate_table(t: Tables, mined=None):
    """The plain documents' n-grams as candidates already on record."""
    mined = N.mine_ngrams(t.documents) if mined is None else mined
    return mined.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), "term_normalized").alias("id"), "term_original", "term_normalized",
        F.col("doc_id").alias("document_id"), F.array().cast("array<string>").alias("contexts"), F.lit(1).alias("frequency"),
        "occurrences", F.lit("document").alias("source_type"), "confidence",
        F.when(F.col("occurrences") > 8, "pending").otherwise("new").alias("status"),
        day(F.col("occurrences")).alias("detected_at"), day(F.col("occurrences")).alias("updated_at"))


@register("g15_upsert_candidates", f"""
WITH {SQL_CANDIDATES}, o AS (WITH {sql_ngrams('documents')} SELECT doc_id, term, n, least(0.6, 0.2 + n * 0.05) AS confidence FROM ngrams)
SELECT coalesce(o.doc_id, m.doc_id) AS document_id, coalesce(o.term, m.term_normalized) AS term_normalized,
       CASE WHEN o.term IS NOT NULL AND m.term_normalized IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS frequency,
       round(CASE WHEN o.term IS NOT NULL AND m.term_normalized IS NOT NULL THEN greatest(m.confidence, 0.3)
                  ELSE coalesce(o.confidence, m.confidence) END, 6) AS confidence,
       CASE WHEN o.term IS NOT NULL THEN CASE WHEN o.n > 8 THEN 'pending' ELSE 'new' END ELSE 'pending' END AS status
FROM o FULL JOIN mined m ON o.doc_id = m.doc_id AND o.term = m.term_normalized""")
def _(t):
    out = N.upsert_candidates(candidate_table(t), N.mine_candidates(slang_documents(t)), as_of())
    return out.select("document_id", "term_normalized", F.col("frequency").cast("bigint"),
                      F.round("confidence", 6).alias("confidence"), "status")


SQL_RECORD = f"""{sql_ngrams('documents')},
record AS (SELECT doc_id || ':' || term AS id, doc_id, term, n, least(0.6, 0.2 + n * 0.05) AS confidence,
                  CASE WHEN n > 8 THEN 'pending' ELSE 'new' END AS status FROM ngrams)"""


@register("g16_review_queue", f"""
WITH {SQL_RECORD} SELECT id, n AS occurrences FROM record WHERE status = 'pending' ORDER BY n DESC, id LIMIT 50""")
def _(t):
    return V.review_queue(candidate_table(t)).select("id", "occurrences")


def review_state(t: Tables):
    graph = part_graph(t)
    none = F.lit(None).cast("string")
    candidates = candidate_table(t).withColumns({s: none for s in G.SCOPE})
    decisions = candidates.where(F.col("occurrences") > 12).select(
        F.col("id").alias("candidate_id"), F.concat(F.lit(" "), "term_original").alias("concept_key"),
        F.col("term_original").alias("concept_label"), F.concat(F.lit(" about "), "term_original").alias("definition"),
        F.lit("r1").alias("reviewer_id"), F.lit(None).cast("double").alias("confidence"), none.alias("criticality"))
    return decisions, {**graph, "candidates": candidates}


SQL_DECISIONS = f"""{SQL_RECORD}, decided AS (
  SELECT *, upper(trim(term)) AS key, row_number() OVER (PARTITION BY upper(trim(term)) ORDER BY id) AS version FROM record WHERE n > 12)"""


@register("g17_approve_concepts", f"""
WITH {SQL_DECISIONS} SELECT DISTINCT key, first_value(trim(term)) OVER (PARTITION BY key ORDER BY id) AS label, 'approved' AS status, 'normal' AS criticality FROM decided""")
def _(t):
    decisions, state = review_state(t)
    return V.approve(decisions, state, as_of())["concepts"].select("key", "label", "status", "criticality")


@register("g17_approve_definitions", f"""
WITH {SQL_DECISIONS} SELECT sha256(key) AS concept_id, version, 'about ' || term AS definition, round(confidence, 6) AS confidence,
  doc_id AS source_document_id FROM decided""")
def _(t):
    decisions, state = review_state(t)
    return V.approve(decisions, state, as_of())["definitions"].select(
        "concept_id", F.col("version").cast("bigint"), "definition", F.round("confidence", 6).alias("confidence"),
        "source_document_id")


@register("g17_approve_aliases", f"""
WITH {SQL_DECISIONS} SELECT DISTINCT sha256(key) AS concept_id, term AS alias, term AS alias_normalized, 'active' AS status FROM decided""")
def _(t):
    decisions, state = review_state(t)
    return V.approve(decisions, state, as_of())["aliases"].select("concept_id", "alias", "alias_normalized", "status")


@register("g17_approve_evidence", f"""
WITH {SQL_DECISIONS} SELECT sha256(key) AS concept_id, doc_id AS document_id, term AS excerpt FROM decided""")
def _(t):
    decisions, state = review_state(t)
    return V.approve(decisions, state, as_of())["evidence"].select("concept_id", "document_id", "excerpt")


@register("g17_approve_candidates", f"""
WITH {SQL_DECISIONS} SELECT r.id, CASE WHEN d.id IS NULL THEN r.status ELSE 'approved' END AS status, d.key AS candidate_concept_key
FROM record r LEFT JOIN decided d USING (id)""")
def _(t):
    decisions, state = review_state(t)
    return V.approve(decisions, state, as_of())["candidates"].select("id", "status", "candidate_concept_key")


@register("g17_approve_reviews", f"""
WITH {SQL_DECISIONS} SELECT id AS candidate_id, sha256(key) AS concept_id, 'approved' AS decision FROM decided""")
def _(t):
    decisions, state = review_state(t)
    return V.approve(decisions, state, as_of())["reviews"].select("candidate_id", "concept_id", "decision")


@register("g18_reject", f"""
WITH {SQL_DECISIONS} SELECT r.id, CASE WHEN d.id IS NULL THEN r.status ELSE 'rejected' END AS status FROM record r LEFT JOIN decided d USING (id)""")
def _(t):
    decisions, state = review_state(t)
    return V.reject(decisions.select("candidate_id", "reviewer_id", F.lit(None).cast("string").alias("notes")),
                    state["candidates"], as_of())["candidates"].select("id", "status")


@register("g19_graph_audit", f"""
WITH {SQL_GRAPH},
orphan AS (SELECT count(*) AS n FROM aliases WHERE concept_id NOT IN (SELECT id FROM concepts WHERE status = 'approved'))
SELECT unnest(['concepts.key', 'aliases.scope', 'definitions.version', 'relationships.scope', 'aliases.concept', 'definitions.concept',
               'relationships.from', 'relationships.to']) AS "check",
       unnest([0, (SELECT count(*) FROM (SELECT 1 FROM aliases GROUP BY alias, team, valid_from HAVING count(*) > 1)), 0, 0,
               (SELECT n FROM orphan), 0, 0, 0])::BIGINT AS null_safe,
       unnest([0, 0, 0, 0, (SELECT n FROM orphan), 0, 0, 0])::BIGINT AS sql_null""")
def _(t):
    graph = part_graph(t)
    approved = graph["concepts"].where(F.col("status") == "approved")
    checks = V.graph_audit(graph).where(F.col("check") != "aliases.concept")
    return checks.unionByName(V.orphans(graph["aliases"], "concept_id", approved, "id", "aliases.concept"))


# --- H: listings ----------------------------------------------------------------------------------

@register("h01_keyset_page", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position, true AS has_next,
       (SELECT epoch_us(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' ORDER BY o_orderdate DESC, o_orderkey OFFSET 49 LIMIT 1) AS next_cursor
FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' QUALIFY position <= 50""")
def _(t):
    page = L.keyset_page(t.orders, "o_orderdate", "o_orderkey", 50, cursor="2000-01-01")
    return page.select("o_orderkey", F.col("position").cast("bigint"), "has_next", F.unix_micros("next_cursor").alias("next_cursor"))


@register("h02_assign_pages", """
SELECT o_orderkey, o_custkey, row_number() OVER w AS position, (row_number() OVER w - 1) // 5 AS page
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)""")
def _(t):
    return L.assign_pages(t.orders, "o_custkey", "o_orderdate", "o_orderkey", 5).select("o_orderkey", "o_custkey", "position", "page")


@register("h03_folders", "SELECT DISTINCT trim(source) AS folder_name FROM documents WHERE trim(source) <> ''")
def _(t):
    return L.folders(t.corpus())


@register("h04_filter_documents", f"""
WITH {SQL_CORPUS} SELECT doc_id FROM corpus WHERE folder_name = 'src3' AND contains(lower(filename), '7')""")
def _(t):
    return L.filter_documents(t.corpus(), "src3", "7").select("doc_id")


@register("h05_move_folders", f"""
WITH {SQL_CORPUS} SELECT doc_id, CASE WHEN lang = 'de' THEN 'archive' WHEN lang = 'fr' THEN NULL ELSE folder_name END AS folder_name FROM corpus""")
def _(t):
    docs = t.corpus().withColumn("updated_at", as_of())
    wanted = F.when(F.col("lang") == "de", " archive ").when(F.col("lang") == "fr", "  ").otherwise(F.repeat(F.lit("x"), 200))
    updates = t.documents.where(F.col("lang") != "en").select("doc_id", wanted.alias("folder_name"))
    return L.move_folders(docs, updates, as_of())[0].select("doc_id", "folder_name")


@register("h05_move_folders_refused", "SELECT doc_id, 'DOCUMENT_FOLDER_INVALID' AS code FROM documents WHERE lang = 'es'")
def _(t):
    docs = t.corpus().withColumn("updated_at", as_of())
    wanted = F.when(F.col("lang") == "de", " archive ").when(F.col("lang") == "fr", "  ").otherwise(F.repeat(F.lit("x"), 200))
    updates = t.documents.where(F.col("lang") != "en").select("doc_id", wanted.alias("folder_name"))
    return L.move_folders(docs, updates, as_of())[1]


@register("h06_cascade_delete", """
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def _(t):
    chats = t.conversations.select("conv_id").distinct()
    gone = t.conversations.where(F.col("role") == "system").select("conv_id")
    return L.cascade_delete(chats, t.conversations, gone, "conv_id")[1].select("conv_id", "turn")


@register("h07_load_conversations", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL WHEN role = 'system' THEN 'titled' ELSE 'named' END AS filename,
       CASE WHEN role = 'user' THEN NULL WHEN role = 'system' THEN 'titled' ELSE 'first' END AS original_filename,
       CASE WHEN role <> 'user' THEN 1 END::BIGINT AS boxes FROM conversations""")
def _(t):
    none = F.lit(None).cast("string")
    def source(filename, original, title):
        return F.struct(filename.alias("filename"), original.alias("original_filename"), title.alias("title"),
                        B.box(0, 0, 1, 1).alias("bounding_box"), F.lit(None).cast(f"array<{B.BOX}>").alias("highlight_boxes"))
    sources = (F.when(F.col("role") == "assistant", F.array(source(F.lit("named"), F.lit("first"), F.lit("other"))))
               .when(F.col("role") == "system", F.array(source(none, none, F.lit("titled")))))
    loaded = L.load_conversations(t.conversations.withColumn("sources", sources))
    first = F.col("sources")[0]
    return loaded.select("conv_id", "turn", first["filename"].alias("filename"), first["original_filename"].alias("original_filename"),
                         F.size(first["highlight_boxes"]).cast("bigint").alias("_n")).withColumn(
        "boxes", F.when(F.col("filename").isNotNull(), F.col("_n"))).drop("_n")


@register("h09_sync_users", """
WITH users AS (SELECT c_custkey AS id, lower(c_name) || '@x.org' AS email, 'user' AS role FROM customer),
logins AS (SELECT DISTINCT lower(replace(s_name, 'Supplier', 'Customer')) || '@x.org' AS email FROM supplier
           UNION SELECT DISTINCT lower(s_name) || '@x.org' FROM supplier)
SELECT email, CASE WHEN l.email IS NULL THEN u.role WHEN email = 'customer#000000003@x.org' THEN 'admin' ELSE 'user' END AS role,
       u.email IS NULL AS created
FROM users u FULL JOIN logins l USING (email)""")
def _(t):
    mail = F.lit("@x.org")
    users = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lower("c_name"), mail).alias("email"),
                              F.lit("user").alias("role"), F.lit(AS_OF).cast("timestamp").alias("updated_at"))
    logins = t.supplier.select(F.explode(F.array(
        F.concat(F.lit(" "), F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER")), mail),
        F.concat("s_name", mail))).alias("email"))
    synced = L.sync_users(users, logins, ["Customer#000000003@x.org "], as_of())
    return synced.select("email", "role", (F.length("id") == 64).alias("created"))


@register("h10_union_distinct", """
SELECT doc_id FROM documents WHERE text LIKE '%License%' UNION SELECT doc_id FROM documents WHERE text LIKE '%the%'""")
def _(t):
    docs = t.documents.select("doc_id", "text")
    return L.union_distinct(docs.where(F.col("text").like("%License%")), docs.where(F.col("text").like("%the%")), "doc_id").select("doc_id")


# --- I: health and analytics --------------------------------------------------------------------------

def damaged_vectors(t: Tables):
    """Vectors of three labels are damaged, one way each."""
    broken = (F.when(F.col("label") == 0, F.lit(None).cast("array<float>"))
              .when(F.col("label") == 1, F.transform("embedding", lambda v: v * F.lit(0).cast("float")))
              .when(F.col("label") == 2, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return t.embeddings.select("vec_id", broken.alias("emb"))


@register("i01_embedding_health", """
SELECT count(*) AS total, count(*) FILTER (label > 1) AS valid, count(*) FILTER (label = 1) AS zero, count(*) FILTER (label = 0) AS "null" FROM embeddings""")
def _(t):
    return A.embedding_health(damaged_vectors(t))


@register("i02_dimension_audit", """
WITH d AS (SELECT CASE label WHEN 0 THEN NULL WHEN 2 THEN 10 ELSE len(embedding) END AS dimension FROM embeddings)
SELECT dimension::BIGINT AS dimension, count(*) AS chunks, CASE WHEN dimension IS NULL THEN 'missing' WHEN dimension = 64 THEN 'ok' ELSE 'wrong' END AS verdict
FROM d GROUP BY dimension""")
def _(t):
    return A.dimension_audit(damaged_vectors(t), 64).withColumn("dimension", F.col("dimension").cast("bigint"))


@register("i03_keyword_coverage", """
WITH c AS (SELECT conv_id AS doc_id, turn, text, contains(lower(text), 'license') OR contains(lower(text), 'idiot') OR contains(lower(text), 'thand') AS hit FROM conversations)
SELECT doc_id, count(*) AS chunks, count(*) FILTER (hit) AS matching,
       arg_min(replace(left(text, 100), chr(10), ' ') || '...', turn) FILTER (hit) AS sample FROM c GROUP BY doc_id""")
def _(t):
    chunks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return A.keyword_coverage(chunks.select("doc_id").distinct(), chunks, ["License", "idiot", "thand"])


@register("i04_box_audit", """
WITH b AS (SELECT vec_id AS chunk_id, abs(embedding[3]::DOUBLE) * 2 AS w, abs(embedding[4]::DOUBLE) * 2 AS h, abs(embedding[5]::DOUBLE) * 2 AS w2,
                  abs(embedding[6]::DOUBLE) * 2 AS h2 FROM embeddings)
SELECT chunk_id, 2::BIGINT AS boxes, round(w * h + w2 * h2, 6) AS total_area, round(greatest(w, 0.1 + w2), 6) AS envelope_width,
  (w * h > 0.35 OR w > 0.8 OR h > 0.35) OR greatest(w, 0.1 + w2) * greatest(h, 0.1 + h2) > 0.35 OR w * h + w2 * h2 > 0.45 AS coarse FROM b""")
def _(t):
    def side(i):
        return F.abs(F.col("embedding")[i].cast("double")) * 2
    first, second = B.box(0, 0, side(2), side(3)), B.box(.1, .1, side(4), side(5))
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), first.alias("bbox"), F.array(first, second).alias("boxes"))
    return A.box_audit(chunks).select("chunk_id", F.col("boxes").cast("bigint"), F.round("total_area", 6).alias("total_area"),
                                      F.round("envelope.width", 6).alias("envelope_width"), "coarse")


@register("i05_corpus_digest", f"""
WITH {SQL_CORPUS}, m AS (SELECT conv_id AS doc_id, count(*) AS n, arg_min(left(text, 50), turn) AS f FROM conversations GROUP BY conv_id)
SELECT doc_id, filename, status, coalesce(n, 0) AS chunk_count, n IS NOT NULL AS has_chunks, f AS first_chunk FROM corpus LEFT JOIN m USING (doc_id)""")
def _(t):
    chunks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return A.corpus_digest(t.corpus(), chunks)


def requests(t: Tables):
    return t.events.select("event_type", "user_id", (F.col("event_type") != "error").alias("success"),
                           (F.col("value") > 150).alias("degraded"), F.col("value").alias("duration"))


@register("i06_latency_summary", """
WITH r AS (SELECT event_type, value, event_type <> 'error' AS ok, value > 150 AS slow, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT event_type, count(*) AS requests, count(*) FILTER (ok) AS success, count(*) FILTER (ok AND slow) AS degraded,
             max(value) FILTER (rn = ceil(0.95 * n)) AS percentile FROM r GROUP BY event_type)
SELECT event_type, requests, success, degraded, round(success / requests, 4) AS success_rate, round(degraded / requests, 4) AS degraded_rate,
       round(1 - success / requests, 4) AS error_rate, percentile,
       1 - success / requests <= 0.01 AND degraded / requests <= 0.1 AND percentile <= 8000 AS passed FROM s""")
def _(t):
    return A.latency_summary(requests(t), ["event_type"])


@register("i06_latency_sketch", """
SELECT event_type, count(DISTINCT date_trunc('hour', ts)) AS hours, count(*) AS requests, true AS within_error FROM events GROUP BY event_type""")
def _(t):
    """The sketch's percentile is not SQL's; that its rank keeps the stated error is."""
    merged = A.merged_percentile(A.hourly_sketches(t.events, ["event_type"], "ts", "value"), ["event_type"])
    ranks = (t.events.join(F.broadcast(merged), "event_type").groupBy("event_type", "hours", "requests")
             .agg(F.avg((F.col("value") <= F.col("percentile")).cast("int")).alias("rank")))
    return ranks.select("event_type", "hours", "requests", (F.abs(F.col("rank") - 0.95) <= A.SKETCH_ERROR).alias("within_error"))


@register("i06_status_histogram", "SELECT event_type, count(*) AS requests FROM events GROUP BY event_type")
def _(t):
    return A.status_histogram(t.events, "event_type")


@register("i07_rolling_count", """
WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS requests FROM events)
SELECT event_id, user_id, requests, requests > 5 AS over_limit FROM c""")
def _(t):
    return Q.rolling_count(t.events, "user_id", "ts", "event_id", 24 * 3600, 5).select("event_id", "user_id", "requests", "over_limit")


SQL_QUOTA = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT event_id, user_id, t, i, t AS start, 1::BIGINT AS n FROM e WHERE i = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.t, e.i, CASE WHEN w.start < e.t - 86400000000 THEN e.t ELSE w.start END,
         CASE WHEN w.start < e.t - 86400000000 THEN 1 ELSE w.n + 1 END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, user_id, n AS requests, start AS window_start_us, greatest(0, 5 - n) AS remaining, n <= 5 AS allowed FROM walk"""


def quota_columns(df):
    return df.select("event_id", "user_id", "requests", F.unix_micros("window_start").alias("window_start_us"),
                     F.col("remaining").cast("bigint"), "allowed")


@register("i08_anchored_quota", SQL_QUOTA)
def _(t):
    return quota_columns(Q.anchored_quota(t.events, "user_id", "ts", "event_id", 24 * 3600, 5))


@register("i09_error_breakdown", """
SELECT CASE WHEN event_type IN ('click', 'error') THEN 'CHAT_UPSTREAM_TRANSIENT' WHEN event_type = 'view' THEN 'CHAT_DB_TRANSIENT' ELSE 'CHAT_UNEXPECTED' END AS code,
  CASE WHEN event_type IN ('click', 'error') THEN 'upstream' WHEN event_type = 'view' THEN 'database' ELSE 'unknown' END AS stage,
  event_type IN ('click', 'error', 'view') AS retryable, count(*) AS errors FROM events GROUP BY ALL""")
def _(t):
    return A.error_breakdown(messages(t))


@register("i10_status_counts", f"WITH {SQL_CORPUS} SELECT status, count(*) AS documents FROM corpus GROUP BY status")
def _(t):
    return A.status_counts(t.corpus())


@register("i10_stuck_documents", "SELECT o_orderkey AS doc_id, epoch_us(o_orderdate) AS created_us FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return A.stuck_documents(docs, "P").select("doc_id", F.unix_micros("created_at").alias("created_us"))
