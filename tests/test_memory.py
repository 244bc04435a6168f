"""Concept graph, mining, quota, paging and source goldens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit as A, cache as K, concepts as G, listing as L, mining as N, quota as Q, review as V
from quillspark.operators import ingest as I
from quillspark.sources import documents as D, profiles as P
from quillspark.sources.buckets import BucketedTable
from quillspark.streaming import jobs as J


def unscoped():
    return {s: F.lit(None).cast("string") for s in ("product", "region", "process", "role")}


def table(spark, rows, ddl, times=()):
    df = spark.createDataFrame(rows, ddl)
    return df.withColumns({t: F.col(t).cast("timestamp") for t in times})


def graph(spark):
    concepts = table(spark, [(1, "GREEN_STATUS", "Green status", "approved", "normal"), (2, "RELEASE_GATE", "Release gate", "approved", "critical"),
                             (3, "GREEN_ENERGY", "Green energy", "approved", "normal"), (4, "LEGACY_GATE", "Legacy gate", "deprecated", "normal")],
                     "id long, key string, label string, status string, criticality string")
    aliases = table(spark, [(1, 1, "Green", "green", None, "active", .9, "2026-01-01", None), (2, 3, "green", "green", "energy", "active", .8, "2026-01-01", None),
                            (3, 2, "release gate", "release gate", None, "active", 1.0, "2026-01-01", "2026-06-01"),
                            (4, 4, "gate", "gate", None, "active", 1.0, "2026-01-01", None), (5, 1, "gs", "gs", None, "deprecated", 1.0, "2026-01-01", None)],
                    "id long, concept_id long, alias string, alias_normalized string, team string, status string, confidence double, valid_from string, valid_to string",
                    ("valid_from", "valid_to")).withColumns(unscoped())
    definitions = table(spark, [(1, 1, 1, "old meaning", "approved", .7, None, "2026-01-01", "2026-03-01"), (2, 1, 2, "new meaning", "approved", .7, None, "2026-03-01", None),
                                (3, 1, 3, "draft", "draft", .9, None, "2026-03-01", None)],
                        "id long, concept_id long, version int, definition string, status string, confidence double, team string, valid_from string, valid_to string",
                        ("valid_from", "valid_to")).withColumns(unscoped())
    relationships = table(spark, [(1, 1, 2, "requires", "approved", None, "2026-01-01", None), (2, 1, 3, "opposes", "draft", None, "2026-01-01", None)],
                          "id long, from_id long, to_id long, relation_type string, status string, team string, valid_from string, valid_to string",
                          ("valid_from", "valid_to")).withColumns(unscoped())
    text = "Je to GREEN status pro release gate?"
    queries = table(spark, [(1, text, None, "2026-02-01"), (2, text, "energy", "2026-07-01"), (3, text, "sales", "2026-03-01")],
                    "qid long, text string, team string, as_of string", ("as_of",)).withColumns(unscoped())
    return queries, {"concepts": concepts, "aliases": aliases, "definitions": definitions, "relationships": relationships}


def test_interpretation(spark):
    queries, tables = graph(spark)
    terms = G.query_terms(queries)
    matches = G.resolve_aliases(terms, tables["aliases"], tables["concepts"])
    resolved = G.resolved_concepts(matches, tables["definitions"])
    got = {}
    for r in resolved.collect():
        got.setdefault(r["qid"], set()).add((r["alias_normalized"], r["concept_key"], r["definition"]))
    assert got == {1: {("green", "GREEN_STATUS", "old meaning"), ("green", "GREEN_ENERGY", None), ("release gate", "RELEASE_GATE", None)},
                   2: {("green", "GREEN_STATUS", "new meaning"), ("green", "GREEN_ENERGY", None)},
                   3: {("green", "GREEN_STATUS", "new meaning"), ("release gate", "RELEASE_GATE", None)}}
    assert {(r["qid"], r["term"]) for r in G.ambiguities(resolved).collect()} == {(1, "green"), (2, "green")}
    assert {(r["qid"], r["hint"]) for r in G.graph_hints(resolved, tables["relationships"], tables["concepts"]).collect()} == {
        (q, "GREEN_STATUS requires RELEASE_GATE") for q in (1, 2, 3)}
    whole = {r["qid"]: r for r in G.interpret(queries, tables, strict=True).collect()}
    assert [q for q in whole if whole[q]["failure"]] and {q for q in whole if whole[q]["failure"]} == {1, 3}
    assert "EffectiveAt: 2026-02-01T00:00:00.000Z" in whole[1]["rewritten_query"]
    assert 'Scope: {"team":"energy"}' in whole[2]["rewritten_query"]
    strict = G.interpret(queries, tables, policy="strict", strict=False)
    assert {r["qid"] for r in strict.collect() if r["failure"]} == {1, 2}
    plain = {r["qid"]: r["rewritten_query"] for r in G.interpret(queries, tables, graph_enabled=False).collect()}
    assert plain[1] == "Je to GREEN status pro release gate?"


def test_combined_interpretation_equals_its_parts(spark):
    queries, tables = graph(spark)
    terms = G.query_terms(queries)
    matches = G.resolve_aliases(terms, tables["aliases"], tables["concepts"])
    resolved = G.resolved_concepts(matches, tables["definitions"])
    rewritten = G.rewrite_queries(queries, resolved, G.graph_hints(resolved, tables["relationships"], tables["concepts"]))
    parts = {r["qid"]: r for r in G.interpretation(resolved, rewritten).collect()}
    whole = {r["qid"]: r for r in G.interpret(queries, tables).collect()}
    for q in parts:
        for c in ("detected_terms", "resolved_concepts", "definition_ids", "rewritten_query"):
            assert parts[q][c] == whole[q][c]
    gate = {r["qid"]: r["failure"] for r in G.strict_gate(queries, resolved, G.ambiguities(resolved)).collect()}
    assert gate == {q: whole[q]["failure"] for q in whole}


def test_validity_end_is_exclusive(spark):
    def ok(at):
        return spark.range(1).select(G.valid_at(*[F.lit(t).cast("timestamp") for t in ("2026-01-01", "2026-02-01", at)])).first()[0]
    assert ok("2026-01-01") and not ok("2026-02-01") and not ok("2026-03-01")


def test_mining(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha beta alpha gamma ab beta alpha beta")], "doc_id long, text string")
    got = [(r["term_normalized"], r["occurrences"], round(r["confidence"], 2)) for r in N.mine_ngrams(docs).orderBy("ord").collect()]
    assert got == [("alpha", 4, .4), ("alpha beta", 3, .35), ("beta", 4, .4), ("beta alpha", 3, .35)] or got == [
        ("alpha", 4, .4), ("alpha beta", 3, .35), ("beta", 4, .4)]
    slang = spark.createDataFrame([(1, 'Tym A: interně tomu ŘÍKÁME "Green Status" pro nas'), (2, "")], "doc_id long, text string")
    row = N.mine_patterns(slang).first()
    assert "green status" in row["term_normalized"] and row["confidence"] == .65


def test_candidates_keep_best_confidence_and_first_context(spark):
    c = spark.createDataFrame([(1, "Green", "green", "a", .2, 1, 0), (1, "green", "green", "b", .8, 1, 1)],
                              "doc_id long, term_original string, term_normalized string, context string, confidence double, occurrences long, ord int")
    row = N.dedupe_candidates(c).first()
    assert (row["term_original"], row["confidence"], row["context"], row["occurrences"]) == ("Green", .8, "a", 2)


def test_candidate_upsert(spark):
    at = F.lit("2026-01-01").cast("timestamp")
    new = spark.createDataFrame([(1, "x", "X", "", .2, 5), (None, "y", "Y", "c", .5, 1)],
                                "doc_id long, term_normalized string, term_original string, context string, confidence double, occurrences long")
    first = N.upsert_candidates(spark.createDataFrame([], N.EMPTY_CANDIDATES.format(id="long")), new, at)
    again = {r["term_normalized"]: r for r in N.upsert_candidates(first, new, at).collect()}
    assert len(again) == 2 and again["x"]["frequency"] == 2 and again["x"]["confidence"] == .3
    assert again["y"]["frequency"] == 2 and again["y"]["contexts"] == ["c"]


def test_review_versions_continue(spark):
    queries, tables = graph(spark)
    at = F.lit("2026-01-01").cast("timestamp")
    new = spark.createDataFrame([(i, t, t, "", .5, 1) for i, t in enumerate(["gs", "status light"])],
                                "doc_id long, term_normalized string, term_original string, context string, confidence double, occurrences long")
    candidates = N.upsert_candidates(spark.createDataFrame([], N.EMPTY_CANDIDATES.format(id="long")), new, at)
    candidates = candidates.withColumn("team", F.lit(None).cast("string")).withColumns(unscoped())
    ids = sorted(r["id"] for r in candidates.select("id").collect())
    decisions = spark.createDataFrame([(ids[0], " green_status", "l", "d", "r", None, None), (ids[1], "GREEN_STATUS", "l", "d", "r", None, None),
                                       ("missing", "K", "l", "d", "r", None, None)],
                                      "candidate_id string, concept_key string, concept_label string, definition string, reviewer_id string, confidence double, criticality string")
    tables = {k: v.withColumn("id", F.col("id").cast("string")) for k, v in tables.items()}
    for name, key in (("definitions", "concept_id"), ("aliases", "concept_id")):
        tables[name] = tables[name].withColumn(key, F.col(key).cast("string"))
    out = V.approve(decisions, {**tables, "candidates": candidates}, at)
    assert sorted(r["version"] for r in out["definitions"].collect()) == [4, 5]
    assert out["concepts"].count() == 0 and [r["alias"] for r in out["aliases"].collect()] == ["status light"]
    assert [(r["candidate_id"], r["error"]) for r in out["errors"].collect()] == [("missing", "candidate_not_found")]
    assert {r["status"] for r in out["candidates"].collect()} == {"approved"}
    assert V.reject(decisions.withColumn("notes", F.lit(None).cast("string")), candidates, at)["errors"].count() == 1


def quota_rows(spark, hours, limit):
    rows = [(i, 1, int(h * 3600)) for i, h in enumerate(hours)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    return events, Q.anchored_quota(events, "user_id", "ts", "event_id", 24 * 3600, limit).orderBy("event_id").collect()


def fold_quota(rows, width, limit):
    out, state = {}, {}
    for key, t, i in sorted(rows):
        start, n = state.get(key, (None, 0))
        start, n = (t, 1) if start is None or t - start > width else (start, n + 1)
        state[key] = start, n
        out[i] = n, start, n <= limit
    return out


@pytest.mark.parametrize("segment,block", [(1 << 20, 1 << 16), (40, 1 << 16), (1, 1 << 16), (40, 12), (10, 0)])
def test_quota_by_composed_segments(spark, segment, block):
    """One piece a key, keys cut into segments, dense keys by sorts: a hot key with a third of all rows, gaps, repeated times."""
    rng = np.random.default_rng(segment + block)
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.choice([1, 1, 2, 3, 4], 900), rng.integers(0, 60, 900) * 4000 + rng.integers(0, 3, 900)))]
    rows += [(5, 86_400 * d, 1000 + d) for d in range(12)] + [(6, 86_400 * d + d, 2000 + d) for d in range(12)]
    events = spark.createDataFrame([(i, k, t) for k, t, i in rows], "event_id long, user_id long, s long").select(
        "event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    got = Q.anchored_quota(events, "user_id", "ts", "event_id", 86_400, 3, segment, block).withColumn("s", F.unix_seconds("window_start")).collect()
    assert len(got) == len(rows)
    assert {r["event_id"]: (r["requests"], r["s"], r["allowed"]) for r in got} == fold_quota(rows, 86_400, 3)


def test_anchored_quota_golden(spark):
    _, rows = quota_rows(spark, [0, 1, 2, 3, 24, 24.5, 48.5, 49], 2)
    assert [r["requests"] for r in rows] == [1, 2, 3, 4, 5, 1, 2, 1]
    assert [r["allowed"] for r in rows] == [True, True, False, False, False, True, True, True]


def test_anchored_quota_matches_a_fold(spark):
    rng = random.Random(3)
    hours = sorted(rng.choice([rng.random() * 400, rng.randint(0, 400)]) for _ in range(300))
    _, rows = quota_rows(spark, hours, 3)
    want, start, n = [], None, 0
    for s in (int(h * 3600) for h in hours):
        start, n = (s, 1) if start is None or s - start > 86400 else (start, n + 1)
        want.append((start, n))
    assert [(int(r["window_start"].timestamp()), r["requests"]) for r in rows] == want


def test_latency_sketches_merge(spark):
    """Any range of hours, merged, keeps the rank error against the exact percentile; nulls count nowhere."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("ts"),
        F.when(F.col("id") % 50 != 0, F.pow(F.rand(5), F.lit(3.0)) * 1000).alias("duration")).cache()
    sketches = A.hourly_sketches(rows, ["k"], "ts")
    for hours in (sketches, sketches.where("hour >= timestamp_seconds(86400)")):
        for r in A.merged_percentile(hours, ["k"]).collect():
            inside = rows.where((F.col("k") == r["k"]) & F.col("duration").isNotNull())
            inside = inside if hours is sketches else inside.where("ts >= timestamp_seconds(86400)")
            assert inside.count() == r["requests"]
            assert abs(inside.where(F.col("duration") <= r["percentile"]).count() / r["requests"] - .95) <= A.SKETCH_ERROR
    assert A.merged_percentile(A.hourly_sketches(rows.limit(0), ["k"], "ts"), ["k"]).count() == 0


def test_nearest_rank(spark):
    for values, want in (([float(v) for v in range(1, 21)], 19), ([5.0], 5), ([float(v) for v in range(1, 101)], 95), ([7.0] * 50, 7)):
        df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
        for width in (1.0, 30.0):
            assert A.nearest_rank(df, ["k"], "v", .95, width).first()["percentile"] == want


def test_keyset_pages_do_not_skip_ties(spark):
    rows = spark.createDataFrame([(i, "2026-01-01" if i < 6 else "2026-01-02") for i in range(10)], "id long, t string")
    rows = rows.withColumn("ts", F.col("t").cast("timestamp"))
    first = L.keyset_page(rows, "ts", "id", 5).collect()
    assert [r["id"] for r in first] == [6, 7, 8, 9, 0] and first[0]["has_next"] and str(first[0]["next_cursor"]).startswith("2026-01-01")
    second = L.keyset_page(rows, "ts", "id", 5, cursor="2026-01-01", cursor_id=0).collect()
    assert [r["id"] for r in second] == [1, 2, 3, 4, 5] and not second[0]["has_next"] and second[0]["next_cursor"] is None
    assert L.keyset_page(rows, "ts", "id", 5, cursor="nonsense").count() == 5


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("Hello")
    (tmp_path / "c.PDF").write_bytes(b"abc")
    (tmp_path / "d.bin").write_bytes(b"x" * 20)
    files = D.read_documents(spark, str(tmp_path))
    good, bad = I.split_admitted(files, max_bytes=10)
    got = {r["name"]: (r["mime"], r["file_hash"]) for r in good.collect()}
    assert got["a b.txt"][0] == "text/plain"
    assert got["c.PDF"] == ("application/pdf", "35d95694d3f160215db293c7899daa5907837838fb4b8119ed713e32446c1266")
    assert [(r["name"], r["reject_code"]) for r in bad.collect()] == [("d.bin", "INGEST_FILE_TOO_LARGE")]
    assert D.text_documents(good).first()["text"] == "Hello"
    target = D.write_snapshot(good, str(tmp_path / "out"), "1", ["mime"])
    assert spark.read.parquet(target).count() == 2


def test_profile_registry(spark, tmp_path):
    (tmp_path / "reg.json").write_text('{"defaultProfileId": "p1", "profiles": [{"id": " p1 ", "name": "One", "matchThreshold": 7, '
                                       '"anchors": [{"text": " Demo ", "page": 1, "region": {"x": 0, "y": 0, "width": 1, "height": 1}}, {"text": " "}], '
                                       '"boilerplatePatterns": ["kontakt", " "], "sampledPages": [{"page": 0, "visualHash": "a"}, {"page": 2, "visualHash": "b"}]}, '
                                       '{"id": "", "name": "bad"}]}')
    (tmp_path / "single.json").write_text('{"id": "p2", "name": "Two", "anchors": [{"text": "x", "region": {"x": 0}}]}')
    (tmp_path / "broken.json").write_text("{nope")
    (tmp_path / "shape.json").write_text('{"hello": 1}')
    reg = P.load_profiles(spark, str(tmp_path))
    profiles = {r["profile_id"]: r for r in reg.profiles.collect()}
    assert set(profiles) == {"p1", "p2"} and profiles["p1"]["match_threshold"] == 1.0 and profiles["p1"]["is_default"]
    anchors = {(r["profile_id"], r["text"]): r["region"] for r in reg.anchors.collect()}
    assert set(anchors) == {("p1", "Demo"), ("p2", "x")} and anchors["p2", "x"] is None
    assert [r["pattern"] for r in reg.patterns.collect()] == ["kontakt"] and [r["page"] for r in reg.sampled.collect()] == [2]
    assert {r["warning"] for r in reg.warnings.collect()} == {"profile_file_unreadable:broken.json", "profile_file_invalid_structure:shape.json"}


def test_batches_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    """Twenty small batches on a large table: what each reads and writes follows the batch."""
    table = BucketedTable(str(tmp_path), ["k"], "k long, n long", 64)

    def add(old, new):
        return old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))

    def size(version):
        return sum(f.stat().st_size for f in (tmp_path / "data" / str(version)).rglob("*.parquet"))

    table.merge(spark.range(60_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")), 0, add)
    rng, want = random.Random(4), {k: 1 for k in range(60_000)}
    for version in range(1, 21):
        keys = [rng.randrange(60_500) for _ in range(3)] + [None]
        batch = spark.createDataFrame([(k, version) for k in keys], "k long, n long")
        old = table.touched(batch, version)
        assert len({f.split("bucket=")[1].split("/")[0] for f in old.inputFiles()}) <= 4
        table.merge(batch, version, add)
        if version == 7:
            table.merge(batch, version, add)  # a batch that is run again
        for k in keys:
            want[k] = want.get(k, 0) + version
        assert size(version) < 0.2 * size(0)
    assert {r["k"]: r["n"] for r in table.read(spark).collect()} == want
    assert table.read(spark, 0).count() == 60_000 and table.latest(spark) == 20
    table.merge(batch, 21, lambda old, new: old.join(new.select("k"), "k", "left_anti").where("k IS NOT NULL"))
    assert table.read(spark).where(F.col("k").isin([k for k in keys if k is not None])).count() == 0


def test_cache_entries_arrive_as_a_stream(spark, tmp_path):
    """The bucketed cache after three batches is what one snapshot after another is."""
    schema = "hash string, text string, emb array<float>, answer string, confidence double, verified boolean, seq long"
    at, cache, table = F.lit("2024-02-01").cast("timestamp"), None, J.cache_table(f"{tmp_path}/cache", 16)
    for n in range(3):
        rows = [(f"h{i}", f"q{i}", [1.0], f"a{n}", .9, i != 2, n) for i in range(n, n + 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.stream_cache_entries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/check", at, 16).awaitTermination()
        cache = K.upsert_cache(spark.createDataFrame([], table.schema) if cache is None else cache, spark.createDataFrame(rows, schema), at)
    assert sorted(map(str, table.read(spark).collect())) == sorted(map(str, cache.select(*table.read(spark).columns).collect()))


def test_streams_take_rows_in_any_order(spark, tmp_path):
    """Shuffled arrival over several batches gives the batch result; one key holds half of all rows."""
    rng = np.random.default_rng(2)
    rows = [(i, 1 if i % 2 else int(rng.integers(2, 6)), int(t)) for i, t in enumerate(rng.integers(0, 40 * 3600, 600))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    events.orderBy(F.rand(3)).repartition(2).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(-1, 0, 2_000_000_000)], "event_id long, user_id long, s long").select(
        "event_id", "user_id", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = J.quota_stream(stream, "user_id", "ts", "event_id", 7200, 5, delay="30 days", reorder=True, bucket_seconds=600)
    J.write_stream(counts, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {r["event_id"]: (r["requests"], r["allowed"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["event_id"] >= 0}
    want = Q.anchored_quota(events, "user_id", "ts", "event_id", 7200, 5).collect()
    assert got == {r["event_id"]: (r["requests"], r["allowed"]) for r in want} and len(got) == 600


def test_streams_over_several_batches(spark, tmp_path):
    """Two files, one per micro-batch: duplicates of the first are set aside in the second."""
    source = str(tmp_path / "in")
    words = " ".join(["word"] * 60)
    for n, rows in enumerate([[(1, "u", words)], [(2, "u", words), (3, "u", "tiny"), (4, "v", words)]]):
        spark.createDataFrame(rows, "doc_id long, user_id string, text string").coalesce(1).write.mode("append").parquet(source)
        query = J.stream_ingest(spark.readStream.schema("doc_id long, user_id string, text string").parquet(source),
                                str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
    docs = {r["doc_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()}
    assert docs == {1: "completed", 3: "failed", 4: "completed"}
