"""Joins of the concept graph are not broadcast by the optimiser's guess of the queries' side."""

from pyspark.sql import functions as F

from quillspark.operators import concepts as G
from quillspark.plans.memory_queries import part_graph, part_queries
from quillspark.plans.catalog import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() if hasattr(df, "_jdf") else ""


def test_the_graph_side_is_shipped(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    graph = part_graph(t)
    matches = G.resolve_aliases(G.query_terms(part_queries(t)), graph["aliases"], graph["concepts"])
    # Whichever side the sizes favour, the queries' terms stay where they are.
    assert "BuildLeft" not in plan(matches)
    resolved = G.resolved_concepts(matches, graph["definitions"])
    assert "BroadcastHashJoin [qid" not in plan(G.strict_gate(part_queries(t), resolved, G.ambiguities(resolved, "strict"), "strict"))


def test_large_graphs_are_merged(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_BROADCAST_ROWS", 3)
    t = Tables(spark, "/root/testdata/sf0.001")
    graph, queries = part_graph(t), part_queries(t).where("qid < 40")
    def found():
        matches = G.resolve_aliases(G.query_terms(queries), graph["aliases"], graph["concepts"])
        return sorted(map(tuple, G.resolved_concepts(matches, graph["definitions"]).select(
            "qid", "alias", "concept_key", F.coalesce("definition_id", F.lit(""))).collect()))
    merged = found()
    monkeypatch.setattr(G, "MAX_BROADCAST_ROWS", 200_000)
    assert merged and merged == found()
