"""Personal data by candidate gradient boosting, in SQL expressions throughout.

Strict and loose generators propose overlapping spans of four kinds. What a strict generator finds and
its check accepts is a base span. Boosted trees over format and context features, fitted on counts of
feature combinations over the whole corpus, score every candidate; a threshold for each kind, set for
precision on a held-out fold, selects further spans. Everything about a text stays in its own row."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: (kind, strict, what a text must contain, pattern). The look-behinds start a match at the head of its
#: run, where a leftmost match starts anyway, so that long runs cost linear time; \G keeps what
#: follows a match.
GENERATORS = (
    ("email", True, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("email", False, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?@\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"),
    ("email", False, "dot", rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++\x20?[\[(]dot[\])]\x20?[A-Za-z]++"),
    ("ip", True, "0", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("ip", False, "0", r"(?<![0-9.:A-Fa-f])(?:[0-9]++(?:[.:][0-9]++){3,7}+|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){4,7}+)"),
    ("card", True, "0", r"[0-9](?:[\x20-]?[0-9])++"),
    ("card", False, "0", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{3,6}){2,4}(?![0-9])"),
    ("phone", True, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("phone", False, "0", r"(?<![0-9+])(?:00|\(?0?)[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,5}(?![0-9])"),
)
#: Trees, depth-2 each, learning rate, and the precision that a threshold must reach on its fold.
TREES, RATE, PRECISION = 16, 0.5, 0.95
#: Bound of the table that the trees are fitted on: the most frequent feature combinations.
COMBINATIONS = 20_000
#: What the trees see. Whether the strict pattern and check accept a candidate is the label, so it is not among them.
FEATURES = ("gen", "digits", "size", "seps", "dots", "before", "after", "cue")
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Exclusive running sums of an array, in blocks, so that copying stays small for long arrays."""
    zero = F.lit(0).cast("long")

    def run(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                      lambda j: F.slice(lengths, j * _BLOCK + 1, _BLOCK))
    starts = run(F.transform(cut, lambda x: F.aggregate(x, zero, lambda a, y: a + y)), zero)
    sums = F.flatten(F.zip_with(cut, F.slice(starts, 1, F.size(cut)), lambda x, s: F.slice(run(x, s), 1, F.size(x))))
    return F.when(F.size(lengths) > 0, sums).otherwise(F.array().cast("array<bigint>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _accepts(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) > 3)
                         | (F.coalesce(p.try_cast("int"), F.lit(0)) > 255))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(m))
    return n.between(9, 15)


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, and for each generator g an array c<g> of (start, end, m, left, right): code points with the
    end exclusive, the match, and the text around it."""
    text = F.coalesce("text", F.lit(""))
    parts = docs.select(*keep, text.alias("_t"), text.rlike("[0-9]").alias("_has0"))
    columns = list(keep)
    for g, (_, _, needs, pattern) in enumerate(GENERATORS):
        cond = F.col("_has0") if needs == "0" else F.col("_t").contains(needs)
        parts = parts.withColumn(f"_m{g}", F.when(cond, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
                                 .otherwise(F.array().cast("array<string>")))
    parts = parts.withColumns({f"_s{g}": F.when(F.size(f"_m{g}") > 0, F.split("_t", x[3], -1))
                               .otherwise(F.array().cast("array<string>")) for g, x in enumerate(GENERATORS)})
    parts = parts.withColumns({f"_r{g}": _running(F.zip_with(f"_m{g}", F.slice(f"_s{g}", 1, F.size(f"_m{g}")),
                                                             lambda m, s: (F.length(m) + F.length(s)).cast("long")))
                               for g in range(len(GENERATORS))})

    def struct(g: int):
        def make(m: Column, i: Column) -> Column:
            start = F.get(f"_r{g}", i) + F.length(F.get(f"_s{g}", i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"),
                            F.lower(F.right(F.get(f"_s{g}", i), F.lit(24))).alias("left"),
                            F.left(F.get(f"_s{g}", i + 1), F.lit(2)).alias("right"))
        return make

    return parts.select(*columns, *[F.transform(f"_m{g}", struct(g)).alias(f"c{g}") for g in range(len(GENERATORS))])


def _side(x: Column) -> Column:
    return (F.when(x.isNull() | (x == "") | x.rlike(r"^\s"), 0).when(x.rlike(r"^\p{L}"), 1).when(x.rlike("^[0-9]"), 2)
            .otherwise(3))


def _features(g: int, c: Column) -> dict[str, Column]:
    """Small integers about one candidate: its generator, format and surroundings."""
    m, left = c["m"], c["left"]
    digits, seps = F.length(_digits(m)), F.length(F.regexp_replace(m, r"[^\x20()_/:-]", ""))
    cue = (F.when(left.rlike("mail|contact"), 1).when(left.rlike(r"tel|phone|call|fax|mob"), 2)
           .when(left.rlike("card|visa|credit|karte|carte"), 3).when(left.rlike(r"\bip|host|server|addr"), 4)
           .when(left.rlike(r"version|order|invoice|isbn|\bid\b|\bno\b|#"), 5).otherwise(0))
    return {"gen": F.lit(g), "digits": F.least(digits, F.lit(20)), "size": F.least(F.floor(F.length(m) / 6), F.lit(5)),
            "seps": F.least(seps, F.lit(4)), "dots": F.least(F.length(F.regexp_replace(m, r"[^.]", "")), F.lit(4)),
            "before": _side(F.right(left, F.lit(1))), "after": _side(F.left(c["right"], F.lit(1))), "cue": cue}


def _strict(kind: str) -> str:
    return next(p for k, strict, _, p in GENERATORS if k == kind and strict)


def _label(g: int, m: Column) -> Column:
    """1 if the strict pattern and the check of the kind accept the whole match."""
    kind = GENERATORS[g][0]
    return (_accepts(kind, m) & m.rlike(f"^(?:{_strict(kind)})$")).cast("int").alias("label")


def _described(g: int, labelled: bool = False) -> Column:
    """The candidates of one generator with their features, and with their label for training."""
    def make(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"),
                        *[v.cast("int").alias(k) for k, v in _features(g, c).items()],
                        *([_label(g, c["m"])] if labelled else []))
    return F.transform(f"c{g}", make)


@dataclass
class Model:
    bias: float
    trees: list[tuple]             # (feature, limit, feature, limit, values of the four leaves)
    thresholds: dict[str, float]

    def score(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for fa, ta, (fl, tl), (fr, tr), leaves in self.trees:
            total = total + (F.when(c[fa] <= ta, F.when(c[fl] <= tl, leaves[0]).otherwise(leaves[1]))
                             .otherwise(F.when(c[fr] <= tr, leaves[2]).otherwise(leaves[3])))
        return 1 / (1 + F.exp(-total))


def _split(rows: list[tuple], grads: list[float], hess: list[float], members: list[int]) -> tuple[str, int]:
    """Best (feature, limit) by second-order gain."""
    best, choice = -1.0, (FEATURES[0], 1 << 20)
    for f, name in enumerate(FEATURES):
        sums: dict[int, list[float]] = {}
        for i in members:
            s = sums.setdefault(rows[i][f], [0.0, 0.0])
            s[0] += grads[i]
            s[1] += hess[i]
        g_all, h_all = sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values())
        g = h = 0.0
        for value in sorted(sums)[:-1]:
            g, h = g + sums[value][0], h + sums[value][1]
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1)
            if gain > best:
                best, choice = gain, (name, value)
    return choice


def fit(counts: list[tuple[tuple, int, int, int]]) -> Model:
    """counts: (features, label, fold, number). Fold 0 sets the thresholds, the others grow the trees."""
    grown = [c for c in counts if c[2]] or counts
    positive = sum(n for _, y, _, n in grown if y)
    everything = sum(n for *_, n in grown)
    bias = math.log((positive + 0.5) / (everything - positive + 0.5))
    model = Model(bias, [], {k: 2.0 for k in KINDS})
    rows, position = [c[0] for c in grown], {name: i for i, name in enumerate(FEATURES)}
    logits = [bias] * len(rows)

    def side(i: int, split: tuple[str, int]) -> bool:
        return rows[i][position[split[0]]] <= split[1]

    for _ in range(TREES if rows else 0):
        p = [1 / (1 + math.exp(-x)) for x in logits]
        grads = [c[3] * (c[1] - q) for c, q in zip(grown, p, strict=True)]
        hess = [c[3] * q * (1 - q) for c, q in zip(grown, p, strict=True)]
        root = _split(rows, grads, hess, list(range(len(rows))))
        halves = [[i for i in range(len(rows)) if side(i, root) is first] for first in (True, False)]
        splits = [_split(rows, grads, hess, half) for half in halves]
        leaves = []
        for half, split in zip(halves, splits, strict=True):
            for first in (True, False):
                leaf = [i for i in half if side(i, split) is first]
                value = RATE * sum(grads[i] for i in leaf) / (sum(hess[i] for i in leaf) + 1)
                value = max(-4.0, min(4.0, value))
                leaves.append(value)
                for i in leaf:
                    logits[i] += value
        model.trees.append((*root, *splits, leaves))

    def score(x: tuple) -> float:
        total = model.bias
        for fa, ta, (fl, tl), (fr, tr), leaves in model.trees:
            if x[position[fa]] <= ta:
                total += leaves[0] if x[position[fl]] <= tl else leaves[1]
            else:
                total += leaves[2] if x[position[fr]] <= tr else leaves[3]
        return 1 / (1 + math.exp(-total))

    for kind in KINDS:
        held = sorted(((score(x), y, n) for x, y, fold, n in counts
                       if not fold and GENERATORS[x[0]][0] == kind), reverse=True)
        right = seen = 0
        for i, (s, y, n) in enumerate(held):
            right, seen = right + n * y, seen + n
            if (i + 1 == len(held) or held[i + 1][0] < s) and right >= PRECISION * seen:
                model.thresholds[kind] = max(s, 0.5)
    return model


def train(docs: DataFrame) -> Model:
    """Fit on the candidates of all docs: a candidate counts as personal data if the strict pattern and
    check of its kind accept it as a whole. The trees learn it from format and surroundings alone, so
    that they also judge candidates that the strict pattern does not reach."""
    found = candidates(docs, "doc_id")
    every = F.flatten(F.array(*[_described(g, labelled=True) for g in range(len(GENERATORS))]))
    rows = found.select(F.when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, 0).otherwise(1).alias("fold"),
                        F.explode(every).alias("c"))
    counts = rows.groupBy("fold", F.col("c.label").alias("label"), *[F.col(f"c.{f}").alias(f) for f in FEATURES]).count()
    kept = counts.orderBy(F.desc("count"), *FEATURES, "label", "fold").limit(COMBINATIONS).collect()
    return fit([(tuple(r[f] for f in FEATURES), r["label"], r["fold"], r["count"]) for r in kept])


def find(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep, and for each kind base_<kind> and all_<kind>: arrays of (start, end) in order. A null or
    empty text has none. Rows are judged each by itself, so repeated rows give repeated results."""
    found = candidates(docs, *keep)
    pair = "array<struct<start:bigint,end:bigint>>"

    def place(c: Column) -> Column:
        return F.struct(c["start"].cast("long").alias("start"), c["end"].cast("long").alias("end"))

    def accepts(kind: str):
        return lambda c: _accepts(kind, c["m"])

    def chosen(kind: str):
        return lambda c: model.score(c) >= model.thresholds[kind]

    base, more = {}, {}
    for kind in KINDS:
        strict = next(g for g, x in enumerate(GENERATORS) if x[0] == kind and x[1])
        base[kind] = F.transform(F.filter(f"c{strict}", accepts(kind)), place).cast(pair)
        picked = [F.transform(F.filter(_described(g), chosen(kind)), place).cast(pair)
                  for g, x in enumerate(GENERATORS) if x[0] == kind]
        more[kind] = F.concat(*picked)
    found = found.select(*keep, *[base[k].alias(f"base_{k}") for k in KINDS], *[more[k].alias(f"_more_{k}") for k in KINDS])
    return found.select(*keep, *[f"base_{k}" for k in KINDS],
                        *[F.array_sort(F.array_distinct(F.concat(f"base_{k}", f"_more_{k}"))).alias(f"all_{k}") for k in KINDS])


def _listed(prefix: str) -> Column:
    def named(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.concat(*[F.transform(f"{prefix}_{k}", named(k)) for k in KINDS]), ",")


def summary(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs(doc_id, text): the number of base spans by kind, their checksum, and
    all spans as kind:start:end."""
    found = find(docs, model, "doc_id")
    return found.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, every span of the text replaced by its kind in brackets; overlapping spans
    become one, named by the first. n_chars, if there, is counted anew for texts that change."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["text"].alias("text"))
    found = find(packed, model, "_row")

    def tagged(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag"))

    spans = F.array_sort(F.concat(*[F.transform(f"all_{k}", tagged(k)) for k in KINDS]))
    found = found.select("_row", spans.alias("_spans"))
    text = F.col("_row.text")
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")), s["tag"])
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"),
                        F.when(s["start"] >= a["pos"], F.concat(a["parts"], F.array(piece))).otherwise(a["parts"]).alias("parts"))

    folded = F.aggregate("_spans", start, step, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substring(text, (a["pos"] + 1).cast("int"), F.lit(2 ** 31 - 1))))
    changed = F.size("_spans") > 0
    out = found.select("_row", F.when(changed, folded).otherwise(text).alias("_text"), changed.alias("_changed"))
    columns = []
    for c in names:
        value = F.col("_row").getField(c)
        if c == "text":
            value = F.col("_text")
        elif c == "n_chars":
            value = F.when(F.col("_changed"), F.length("_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)
