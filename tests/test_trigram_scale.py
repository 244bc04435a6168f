"""The trigram join scores short sets where their first shared trigram meets; cells, blocks and long sets change nothing."""

import random

from quillspark.operators import fuzzy


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {p[i:i + 3] for w in words for p in [f"  {w} "] for i in range(len(p) - 2)}


def expected(left, right, threshold):
    out = set()
    for i, a in left:
        for j, b in right:
            x, y = grams(a), grams(b)
            if x and y and len(x & y) / len(x | y) > threshold:
                out.add((i, j, round(len(x & y) / len(x | y), 9)))
    return out


def test_trigram_join_in_cells(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "CELL", 3)
    monkeypatch.setattr(fuzzy, "BLOCK", 2)
    monkeypatch.setattr(fuzzy, "SHORT", 20)  # some sets are longer
    rng = random.Random(3)
    left = [(i, f"Supplier#{rng.randrange(200):06d}") for i in range(40)] + [(90, "!!"), (91, "Été à Brno"), (92, "Supplier#000001")]
    right = [(i, f"Customer#{rng.randrange(200):06d}" + " of the north" * (i % 3)) for i in range(60)] + [(99, "ete a Brno"), (None, "Supplier#000001")]
    found = fuzzy.trigram_join(spark.createDataFrame(left, "id long, text string"),
                               spark.createDataFrame(right, "id long, text string"), 0.25).collect()
    rows = [(r["left_id"], r["right_id"], round(r["similarity"], 9)) for r in found]
    assert len(rows) == len(set(rows)) and set(rows) == expected(left, right, 0.25)
