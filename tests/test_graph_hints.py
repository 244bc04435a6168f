"""Hints become text last: no exchange, sort or aggregate carries their texts, and matches are not exchanged again."""

import datetime as dt

import pytest

from quillspark.operators import concepts as G

DAY = dt.datetime(2024, 1, 5)
SCOPED = "team string, product string, region string, process string, role string"


def graph(spark):
    end = [None, dt.datetime(2024, 1, 3), dt.datetime(2025, 1, 1)]
    concepts = [(n, None if n == "d" else n.upper(), n, "approved", "normal") for n in "abcd"]
    aliases = [(f"{n}{i}", n, alias, alias, None, *[None] * 4, "active", 0.5, dt.datetime(2024, 1, 1), None)
               for n, words in (("a", ["alpha", "red"]), ("b", ["beta", "red"]), ("c", ["red", "gamma"]), ("d", ["delta"])) for i, alias in enumerate(words)]
    edges = [(f"r{(i * 7) % 23:02}", x, y, f"t{i}", "approved" if i % 4 else "draft", ["", "x", None, "y"][i % 4 if i % 3 else 0],
              *[None] * 4, dt.datetime(2024, 1, 1 + i % 8), end[i % 3]) for i, (x, y) in enumerate((x, y) for x in "abcde" for y in "dcbae")]
    return {
        "concepts": spark.createDataFrame(concepts, "id string, key string, label string, status string, criticality string"),
        "aliases": spark.createDataFrame(aliases, f"id string, concept_id string, alias string, alias_normalized string, {SCOPED}, status string, "
                                         "confidence double, valid_from timestamp, valid_to timestamp"),
        "definitions": spark.createDataFrame([("d1", "a", 1, "first", "approved", 0.9, *[None] * 5, dt.datetime(2024, 1, 1), None)],
                                             "id string, concept_id string, version int, definition string, status string, confidence double, "
                                             f"{SCOPED}, valid_from timestamp, valid_to timestamp"),
        "relationships": spark.createDataFrame(edges, f"id string, from_id string, to_id string, relation_type string, status string, {SCOPED}, "
                                               "valid_from timestamp, valid_to timestamp")}


def queries(spark):
    texts = ["alpha and beta", "red", "delta?", "nothing", None, "gamma red alpha", "alpha"]
    rows = [(i, text, [None, "x", "", "y"][i % 4], *[None] * 4, DAY if i < 6 else None) for i, text in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "beta", *[None] * 5, DAY)], f"qid long, text string, {SCOPED}, as_of timestamp")


def rewritten(spark, listed):
    g, asked = graph(spark), queries(spark)
    found = G.resolved_concepts(G.resolve_aliases(G.query_terms(asked), g["aliases"], g["concepts"]), g["definitions"])
    return G.rewrite_queries(asked, found, G.graph_hints(found, g["relationships"], g["concepts"], listed=listed))


def test_numbers_give_the_same_texts(spark, monkeypatch):
    def rows(df):
        return sorted(map(repr, df.collect()))
    want = rows(rewritten(spark, False))
    assert rows(rewritten(spark, True)) == want and sum("GRAPH_RELATIONSHIPS" in r for r in want) > 3
    whole = rows(G.interpret(queries(spark), graph(spark)))
    monkeypatch.setattr(G, "MAX_BROADCAST_ROWS", 3)
    assert rows(rewritten(spark, True)) == want and rows(G.interpret(queries(spark), graph(spark))) == whole


@pytest.mark.parametrize("build", [lambda s: rewritten(s, True), lambda s: G.interpret(queries(s), graph(s))])
def test_neither_texts_nor_matches_move(spark, build):
    plan = build(spark)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(qid" in line]
    assert moved and not any("alias_normalized" in line or "concept_id" in line for line in moved)
    assert "collect_list(struct(relation_id" not in plan and "collect_list(_numbers" in plan


def test_terms_are_taken_once(spark):
    plan = G.query_terms(queries(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
