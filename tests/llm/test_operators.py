"""The training-data operators against plain versions on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import (decontamination, jaccard_join, language_id, packing, pii, quality_classifier, quality_rules,
                            substring_dedup, toxicity, url_filter)
from quillspark.llm.components import components
from quillspark.llm.queries import tokenizer_path

PATH = "/root/testdata/sf0.001"
WORDS = [f"w{i}x{i * 7919 % 97}" for i in range(400)]
SCHEMA = "doc_id long, text string, n_words long, score double, digest string"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


LONG = prose(1, 60_000)
BASE = prose(2, 120)
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two Words"), (6, BASE), (7, BASE), (7, BASE), (8, BASE.upper()),
        (9, BASE.replace(WORDS[3], "zz") + " tail"), (10, LONG), (11, LONG + " end"), (12, "É à la carte : 12 €\r\n\tok"),
        (None, BASE), (13, "x" * 50_000), (14, "12" * 20_000), (15, "same line here\n" * 40), (16, "a b c"), (17, "A B c"),
        (18, prose(5, 60) + "\n" + prose(6, 90)), (19, prose(7, 60) + "\n" + prose(6, 90))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, 0.5, "clash") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(BASE.split()[10:40])), (10, "a B c"), (2, None), (3, "!!"), (5, " ".join(BASE.split()[10:40])),
             (6, prose(99, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for item, text in items:
        w = pattern.findall(lower(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i:i + n])].add(str(item))
    want = []
    for doc, text in ROWS:
        w, hit, found = pattern.findall(lower(text)), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i:i + n])]
        want.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                     bool(hit) and 20 * len(hit) >= len(w)))
    got = [tuple(r) for r in decontamination.contamination(docs, bench).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert decontamination.hits(docs, bench, max_rows=0).count() == decontamination.hits(docs, bench).count()
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    gone = {r[0] for r in want if r[5]}
    assert sorted(r[0] or 0 for r in kept.collect()) == sorted(d or 0 for d, _ in ROWS if d not in gone)
    cleaned = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, bench).collect()}
    assert cleaned[4] == "one" and WORDS and cleaned[1] is None and len(cleaned[6].split()) == 90
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_jaccard_join(docs, empty):
    sets = []
    for doc, text in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append((doc, set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()))
    parent = {i: i for i in range(len(sets))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (da, a) in enumerate(sets):
        for j, (db, b) in enumerate(sets[:i]):
            if (a and b and 100 * len(a & b) >= 90 * len(a | b)) or (da == db and da is not None):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = [(d, len(s), low.get(find(i))) for i, (d, s) in enumerate(sets)]
    got = [tuple(r) for r in jaccard_join.similar_classes(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert jaccard_join.similar_classes(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect())[8] == 0


def test_jaccard_join_of_near_copies(spark):
    """A large group of near copies on both sides of the threshold, against all pairs."""
    rng, base, rows = np.random.default_rng(3), prose(11, 150).split(), []
    for i in range(160):
        w = list(base)
        for k in rng.choice(len(w), rng.integers(0, 6), replace=False):
            w[k] = WORDS[rng.integers(0, len(WORDS))]
        rows.append((i, " ".join(w)))
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    edges = [(i, j) for i in range(160) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    parent = list(range(160))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, j in edges:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(160)} and len(set(got.values())) > 1


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_join_of_unequal_sizes(spark, n, percent):
    """Sentences appended and removed on both sides of the threshold, against all pairs: the longer text has
    shingles in its prefix that nobody shares."""
    rng, rows = np.random.default_rng(17), []
    for g in range(60):
        w = [f"g{g}v{k}" for k in rng.permutation(int(rng.integers(40, 160)))]
        cut, at = int(len(w) * rng.choice([.04, .08, .1, .15, .2, .25])), int(rng.integers(0, len(w)))
        rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(w + [f"n{g}v{k}" for k in range(cut)] if g % 3 else w[:at] + w[at + cut:])))
    rows.append((len(rows), "one sentence more " + rows[0][1]))
    rows.append((len(rows) - 1, "an unrelated short text under the same id"))
    sets = [set(zip(*[t.split()[k:] for k in range(n)])) for _, t in rows]
    low = list(range(len(rows)))
    for _ in range(3):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if rows[i][0] == rows[j][0] or 100 * len(a & b) >= percent * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    want = {d: low[i] for i, (d, _) in enumerate(rows)}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_classes(
        spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == want and 20 < len(set(want.values())) < 110


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(tokenizer_path())
    pieces = packing.token_pieces(docs, tokenizer_path()).collect()
    ids = defaultdict(list)
    for r in sorted(pieces, key=lambda r: r["piece"]):
        assert r["length"] == len(r["ids"]) // 4 <= 2048 and (r["piece"] == 0 or r["length"] == 2048)
        ids[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for doc, text in ROWS:
        if doc not in (7, None):
            want = exact.encode(text or "", add_special_tokens=False).ids + [0]
            assert sum((x for _, x in ids[doc]), []) == want
            assert [s for s, _ in ids[doc]] == [sum(len(x) for _, x in ids[doc][:k]) for k in range(len(ids[doc]))]
    packed = packing.pack_documents(docs, tokenizer_path())
    rows = packed.collect()
    assert len(rows) == len(pieces)
    fills = defaultdict(list)
    for r in rows:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r["ids_crc32"] for r in rows} == {zlib.crc32(r["ids"]) for r in pieces}
    whole = packing.sequences(packing.pack(packing.token_pieces(docs, tokenizer_path()))).collect()
    assert sum(r["n_ids"] for r in whole) == sum(r["length"] for r in pieces) == sum(len(r["ids"]) // 4 for r in whole)
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_fast_ids_equal_the_tokenizer():
    encode = packing.encoder(tokenizer_path())
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} x\n{chr(c)}'s " for c in range(0x250)]
    texts += ["<|endoftext|> a <|endoftext|>", "日本 語", " " * 5000, "a" * 5000, "don't  stop\n\n now", "  x"]
    for text in texts:
        assert encode.ids(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_bounds_and_best_fit():
    rng = np.random.default_rng(4)
    for top in (20, 60, 100):
        lengths = rng.integers(1, top + 1, 300)
        bins, offsets, fill = packing.best_fit(lengths, 100)
        assert fill.max() <= 100 and fill.sum() == lengths.sum()
        bound = packing.lower_bound(np.bincount(lengths, minlength=101))
        assert -(-lengths.sum() // 100) <= bound <= len(fill)
    assert packing.lower_bound(np.bincount([60] * 7, minlength=101)) == 7


def test_repacking_closes_gaps(spark):
    rows = [(i, 0, 0, int(n)) for i, n in enumerate(np.random.default_rng(8).integers(1, 90, 600))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long")
    packed = packing.pack(pieces, capacity=100, group=40).collect()
    bound = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=101))
    assert len(packed) == 600 and len({r["sequence_id"] for r in packed}) <= 1.05 * bound + 1


def test_groups_are_certified(spark):
    """Each group's flag says whether it meets its own bound, and certified sequences stay unless the last exchange
    opens them."""
    rng = np.random.default_rng(12)
    lengths = [*([50] * 160), *rng.integers(34, 60, 240).tolist()]
    pieces = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(lengths)], "_number long, length long, fill string")
    packed = packing._pack_groups(pieces, 8, 0, 100).collect()
    groups = defaultdict(list)
    for r in packed:
        groups[r["sequence_id"] >> 20].append(r)
    flags = set()
    for rows in groups.values():
        bound = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=101))
        assert {r["certified"] for r in rows} == {len({r["sequence_id"] for r in rows}) == bound}
        flags |= {r["certified"] for r in rows}
    whole = packing.pack(pieces.drop("_number"), capacity=100, group=50)
    assert whole.columns == ["length", "sequence_id", "offset"]
    got = whole.collect()
    fills = Counter()
    for r in got:
        fills[r["sequence_id"]] += r["length"]
    assert len(got) == 400 and max(fills.values()) <= 100 and len(fills) <= len({r["sequence_id"] for r in packed})
    assert len(fills) >= packing.lower_bound(np.bincount(lengths, minlength=101))


def test_packing_deals_repeated_rows_to_all_groups(spark):
    rows = [(None, 0, 0, 30 + i % 7) for i in range(1000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long"), capacity=100, group=50, rounds=1)
    got = packed.collect()
    sizes = Counter(r["sequence_id"] >> 20 for r in got)
    assert len(got) == 1000 and len(sizes) == 20 and max(sizes.values()) < 100
    fills = Counter()
    for r in got:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 100 and packed.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset"]


def test_substring_dedup(spark, docs, empty):
    got = substring_dedup.repeated_passages(docs).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        text = dict(ROWS)[r["doc_id"]][r["start"]:r["end"]]
        assert len(text) == r["n_chars"] >= 120
    assert set(by_doc) == {6, 7, 9, 10, 11, 18, 19}
    assert max(r["n_chars"] for r in by_doc[19]) > 0.8 * len(prose(6, 90))
    assert all(r["removed_chars"] == 0 for r in by_doc[6] + by_doc[10] + by_doc[18])
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(docs.where("doc_id in (1, 4, 18, 19)")).collect()}
    assert kept[18] == dict(ROWS)[18] and kept[4] == "one" and kept[1] is None and len(kept[19]) < len(dict(ROWS)[19]) - 200
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_passages_are_cut_from_their_own_text(spark):
    """Texts under one id keep what only another of them repeats; clashing columns and null ids do no harm."""
    shared, other = prose(31, 80), prose(32, 120)
    rows = [(1, shared, 0, 0), (2, "intro words " + shared, 0, 0), (2, other, 0, 0), (2, other, 0, 0), (None, shared, 0, 0), (3, None, 0, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, start long, text_hash long")
    got = sorted(((r["doc_id"], r["text"]) for r in substring_dedup.remove_passages(table).collect()), key=str)
    texts = [t for d, t in got if d == 2]
    assert len(got) == 6 and texts.count(other) == 2 and (1, shared) in got and (None, shared) in got and (3, None) in got
    assert len(min(texts, key=len)) < 200


def test_pii(spark, empty):
    rows = [(1, "mail a.b@c.de, x_y@z.co.uk and a@b.c_d@e.f or no@where"), (2, "hosts 1.2.3.4 and 999.1.1.1, 1.2.3.4.5.6.7.8"),
            (3, "card 4111 1111 1111 1111 and 4111-1111-1111-1112"), (4, "call +1 (551) 555-0826 or +12 34"), (5, None), (6, ""),
            (7, "é" * 30 + " a@b.de " + "é 4111111111111111 " * 600), (7, "again a@b.de"), (8, "a" * 60_000 + "@"), (9, "1" * 60_000),
            (None, "+49 30 1234567 x")]
    table = spark.createDataFrame([(i, t, 3, 9) for i, t in rows], "doc_id long, text string, n_email int, n_chars long")
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            d = [int(c) for c in digits[::-1]]
            return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    want = []
    for doc, text in rows:
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m.group())]
                 if not (doc == 8 and k == "email") else [] for k, p in patterns.items()}
        listed = ",".join(f"{k}:{s}:{e}" for k in patterns for s, e in spans[k])
        want.append((doc, *(len(spans[k]) for k in patterns), hashlib.sha256(listed.encode()).hexdigest(), listed))
    model = pii.train(table)
    got = pii.summary(table, model).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((w[:6] for w in want), key=key)
    spans = {w[5]: w[6] for w in want}
    for r in got:
        assert set(filter(None, spans[r["base_sha256"]].split(","))) <= set(r["spans"].split(","))
    red = pii.redact(table, model)
    assert red.columns == table.columns
    out = {(r["doc_id"], len(r["text"] or "")): r for r in red.collect()}
    texts = [r["text"] for r in out.values() if r["text"]]
    assert any(t.startswith("card [CARD] and ") for t in texts) and not any("a@b.de" in t for t in texts)
    assert pii.summary(empty, pii.train(empty)).count() == 0


def test_pii_trees_do_not_see_the_label(spark):
    """Digits that only the checksum tells apart look alike to the trees, so none is added to the base."""
    rng = np.random.default_rng(3)
    rows = [(i, f"paid with card {''.join(map(str, rng.integers(0, 10, 16)))} today") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(table)
    used = {f for tree in model.trees for f in (tree[0], tree[2][0], tree[3][0])}
    assert used <= set(pii.FEATURES) and not used & {"check", "label"}
    got = pii.find(table, model, "doc_id").collect()
    assert 0 < sum(len(r["base_card"]) for r in got) < 100
    assert all(r["all_card"] == r["base_card"] for r in got)


def test_url_filter(spark):
    rows = [(1, "http://www.Example.com/en/1?x#y"), (2, "https://example.com/en/"), (3, "http://a.net/es/1"), (4, "http://a.org/p"),
            (5, None), (6, "no scheme"), (7, "http://x.com"), (8, "http://b.org/q?utm=1"), (9, "http://b.org/q/"), (9, "http://b.org/q/")]
    pages = spark.createDataFrame([(i, u, None if i != 4 else '<link rel="canonical" href="http://a.net/es/1">', "v") for i, u in rows],
                                  "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("net/es/", "block")
    assert got[4][2:] == (None, "block"), "the canonical page is blocked"
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("x.com", "", None, "allow")
    moved = spark.createDataFrame([("http://b.org/q", "http://a.net/fr/1"), ("http://b.org/q", "http://ok.com/1")], "from_url string, to_url string")
    assert {r["verdict"] for r in url_filter.judge(pages, moved.limit(1)).where("page_id in (8, 9)").collect()} == {"block"}
    assert {r["verdict"] for r in url_filter.judge(pages, moved).where("page_id in (8, 9)").collect()} == {"allow"}, "allow comes first"
    assert url_filter.judge(pages).count() == len(rows) and url_filter.judge(pages.limit(0)).count() == 0


def test_quality_rules(docs, empty):
    want = []
    for doc, text in ROWS:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        inside = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)))
    got = quality_rules.quality_rules(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(empty).count() == 0


def test_classifiers_on_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (4, 5, 6, 7, 9, 12, 15, 16, 18)] + [(None, 1, 1), (8, None, None)],
                                   "doc_id long, quality int, toxic int")
    anyone = F.lit(True)
    for module, score in ((quality_classifier, quality_classifier.score_quality), (toxicity, toxicity.score_toxicity)):
        for model in (module.train(docs, labels, anyone), module.train(docs, labels.limit(0), anyone)):
            got = score(docs, model).collect()
            assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
            assert score(empty, model).count() == 0
    tagged = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, "bb"))
    for model in (language_id.train(tagged, anyone), language_id.train(tagged.limit(0), anyone)):
        got = language_id.identify(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 14)} == {"und"}
        assert language_id.identify(empty, model).count() == 0


@pytest.mark.parametrize("name", ["op2_quality_classifier", "op7_toxicity", "op8_language_id"])
def test_held_out_accuracy(spark, name):
    from quillspark.llm.queries import QUERIES
    path = PATH.replace("0.001", "0.01")
    found = QUERIES[name](spark, path).where("held_out")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    if name == "op8_language_id":
        right = found.join(docs, "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
        assert right.agg(F.avg("ok")).first()[0] > 0.95
        return
    label = "quality" if name.startswith("op2") else "toxic"
    rows = [(r["score"], r[label]) for r in found.join(labels, "doc_id").collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > (0.95 if label == "quality" else 0.7)


def test_pipeline(spark):
    """Each stage by its rule: plain versions of what the stages drop, change and pack."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 456", "en", "s", 7)], docs.schema)
    one = stages["language_id"](spark, docs.unionByName(extra), PATH)
    assert one.columns == names and one.count() == docs.count()
    two = stages["jaccard_join"](spark, one, PATH)
    classes = jaccard_join.similar_classes(one)
    assert two.count() == classes.select("component_id").distinct().count() and two.columns == names
    three = stages["decontamination"](spark, two, PATH)
    bad = decontamination.contamination(two, spark.read.parquet(f"{PATH}/benchmark.parquet")).where("contaminated")
    assert three.count() == two.count() - bad.count() and three.columns == names
    four = stages["pii"](spark, three, PATH)
    assert four.columns == names and four.count() == three.count()
    assert four.where(F.col("text").rlike(r"@mail[0-9]\.example\.com")).count() == 0
    assert four.where(F.length("text") != F.col("n_chars")).count() == 0
    final = corpus_pipeline.run(spark, PATH)
    assert final.where("piece = 0").count() == four.count()
    assert final.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_decontamination_by_shuffle_equals_broadcast(spark, docs, empty):
    items = [(1, " ".join(BASE.split()[10:40])), (2, "a B c"), (3, "one"), (4, " ".join(LONG.split()[500:520]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    ways = [sorted((tuple(r) for r in decontamination.contamination(docs, bench, max_rows=n).collect()), key=key) for n in (1000, 0)]
    assert ways[0] == ways[1] and sum(r[2] > 0 for r in ways[0]) > 5
    for bench in (bench, bench.limit(0)):
        assert decontamination.contamination(empty, bench).count() == 0
    clean = decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(ROWS) and not any(r["contaminated"] for r in clean)


def test_jaccard_join_of_a_group_just_under_the_limit(spark):
    """Thousands of copies of one text, each with edits of its own, mostly under 90 % of each other: the links and
    classes of brute force, and far fewer pairs compared than the square of the group."""
    rng, base = np.random.default_rng(77), prose(70, 120).split()
    rows = []
    for i in range(1500):
        words = list(base)
        for at in rng.choice(len(words), int(rng.integers(1, 6)), replace=False):
            words[at] = f"e{rng.integers(0, 40) if i % 3 else i}y{at}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[j:j + 3]) for j in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    under = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
            else:
                under += 1
    assert under > 700_000
    compared = []
    checked = jaccard_join.verified
    try:
        jaccard_join.verified = lambda docs, pairs, n, percent: (compared.append(pairs.count()), checked(docs, pairs, n, percent))[1]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_classes(docs).collect()}
    finally:
        jaccard_join.verified = checked
    assert got == {i: root(i) for i in range(len(rows))}
    assert sum(compared) < under / 7, compared  # most pairs differ by more, and each counts once


def test_quality_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    scores = []
    for n in (1, 7):
        table = docs.repartition(n, F.xxhash64("doc_id", F.lit(n)))
        model = quality_classifier.train(table, labels, F.col("doc_id") % 5 != 0)
        scores.append({r["doc_id"]: r["score"] for r in quality_classifier.score_quality(docs, model).collect()})
    assert max(abs(scores[0][d] - scores[1][d]) for d in scores[0]) < 1e-9


def test_jaccard_lists_keep_only_rows_with_a_possible_partner(spark):
    """No row of a possible pair is lost, a list of two is judged exactly, and most chance meetings go."""
    rng = np.random.default_rng(11)
    rows = []
    for token in range(300):
        for _ in range(int(rng.integers(1, 6))):
            size = int(rng.integers(20, 60))
            rows.append((token, len(rows), size, int(rng.integers(0, size // 10 + 2)), int(rng.integers(size * 8 // 10, size + 1)),
                         int(rng.integers(1, 4))))
    live = spark.createDataFrame(rows, "token long, doc_id long, size int, place int, free int, k int")
    a, b = (live.select("token", *[F.col(c).alias(f"{s}{c}") for c in live.columns[1:]]) for s in ("x_", "y_"))
    pairs = a.join(b, "token").where((F.col("x_doc_id") != F.col("y_doc_id")) & jaccard_join._possible("x_", "y_", 90))
    needed = {r["x_doc_id"] for r in pairs.select("x_doc_id").distinct().collect()}
    kept = {r["doc_id"] for r in jaccard_join.with_partners(live, 90).collect()}
    two = {t for t, n in Counter(r[0] for r in rows).items() if n == 2}
    assert needed <= kept
    assert {r[1] for r in rows if r[0] in two} & kept == {r[1] for r in rows if r[0] in two} & needed
    assert 0 < len(needed) and len(kept) < 2 * len(rows) // 3
