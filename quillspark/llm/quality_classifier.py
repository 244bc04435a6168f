"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages,
each passage is encoded, gated attention learned from document labels alone weighs the passages,
and the weighted sum of their encodings is scored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField

from quillspark.llm.common import label_sample, map_blocks
from quillspark.llm.rolling import LEAD, LOWER, SPACE, Block, covered, grams, mix, repeated, totals

PASSAGE_WORDS = 64
#: Bound of the training sample in documents, and of the passages that a document may bring to it.
SAMPLE, SAMPLE_PASSAGES = 3000, 256
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 8, 60, 64, 0.01, 1e-4, 7
THRESHOLD = 0.3
_HASHED = 24


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


CLASSES = [_class(bytes(range(97, 123))), _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#*$%&|<>=_~^\\/@"),
           _class(b"!?"), _class(b".,;:"), _class(b"\"'()[]{}-+"), _class(b"\n"), _class(bytes(range(128, 256)))]
WIDTH = len(CLASSES) + 7 + _HASHED


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (PASSAGE_WORDS words of the whole text), and for each text the index
    of its first one. A text without words has no passage."""
    starts, ends, bounds = block.words(~SPACE)
    n_words = np.diff(bounds)
    counts = -(-n_words // PASSAGE_WORDS)
    first = np.concatenate([[0], np.cumsum(counts)])
    if not first[-1]:
        return np.zeros((0, WIDTH), np.float32), first
    within = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    lo = np.repeat(bounds[:-1], counts) + within * PASSAGE_WORDS
    hi = np.minimum(lo + PASSAGE_WORDS, np.repeat(bounds[1:], counts))
    word_edges = np.append(lo, bounds[-1])
    left = starts[lo]
    right = np.where(hi < np.repeat(bounds[1:], counts), starts[np.minimum(hi, len(starts) - 1)],
                     np.repeat(block.offsets[1:], counts))
    size = np.maximum(right - left, 1)
    out = np.empty((first[-1], WIDTH), np.float32)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return (sums[right] - sums[left]) / size

    for k, members in enumerate(CLASSES):
        out[:, k] = np.sqrt(share(members[block.data]))
    k = len(CLASSES)
    lead = np.zeros(len(block.data) + 1, np.int32)
    np.cumsum(LEAD[block.data], out=lead[1:])
    length = (lead[ends] - lead[starts]).astype(np.int64)
    hashes = block.prefix(LOWER[block.data]).hash(starts, ends)
    words = np.maximum(hi - lo, 1)
    out[:, k] = totals(length, word_edges) / words / 10
    out[:, k + 1] = np.sqrt(totals(length * length, word_edges) / words) / 10
    out[:, k + 2] = np.log1p(words) / 4
    upper = CLASSES[1][block.data[starts]] & CLASSES[1][block.data[ends - 1]] & (length > 1)
    out[:, k + 3] = totals(upper, word_edges) / words
    for i, n in enumerate((2, 5)):
        values, grams_first = grams(hashes, bounds, n)
        inside = covered(repeated(values, grams_first), grams_first, bounds, n)
        out[:, k + 4 + i] = totals(inside, word_edges) / words
    out[:, k + 6] = np.log1p(np.repeat(n_words, counts)) / 8
    bucket = (mix(hashes) % np.uint64(_HASHED)).astype(np.int64)
    owner = np.repeat(np.arange(first[-1]), hi - lo)
    hist = np.bincount(owner * _HASHED + bucket, minlength=first[-1] * _HASHED).reshape(-1, _HASHED)
    out[:, k + 7:] = np.sqrt(hist / words[:, None])
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    attend: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    head: np.ndarray
    head_bias: float
    empty: float  # score of a text without words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: Model, x: np.ndarray, first: np.ndarray):
    """Bags must not be empty."""
    h = np.tanh(x @ m.encode + m.encode_bias)
    t, g = np.tanh(h @ m.attend), _sigmoid(h @ m.gate)
    raw = (t * g) @ m.weigh
    counts = np.diff(first)
    e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first[:-1]), counts))
    a = e / np.repeat(np.add.reduceat(e, first[:-1]), counts)
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    return h, t, g, a, z, _sigmoid(z @ m.head + m.head_bias)


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the log loss of the documents. Bags without passages set the score of empty texts."""
    rng = np.random.default_rng(SEED)
    full = [i for i, b in enumerate(bags) if len(b)]
    bare = [labels[i] for i in range(len(bags)) if not len(bags[i])]
    rate = float((labels.sum() + 1) / (len(labels) + 2))
    everything = np.concatenate([bags[i] for i in full]) if full else np.zeros((1, WIDTH))
    m = Model(everything.mean(0), everything.std(0) + 1e-3, rng.normal(0, WIDTH ** -0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 0.3, (HIDDEN, ATTENTION)), rng.normal(0, 0.3, (HIDDEN, ATTENTION)), rng.normal(0, 0.3, ATTENTION),
              rng.normal(0, 0.3, HIDDEN), float(np.log(rate / (1 - rate))), (sum(bare) + rate) / (len(bare) + 1))
    names = ["encode", "encode_bias", "attend", "gate", "weigh", "head", "head_bias"]
    moment = {k: [0.0, 0.0] for k in names}
    step = 0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(full), max(1, len(full) // BATCH)):
            if not len(part):
                continue
            step += 1
            counts = np.array([len(bags[i]) for i in part])
            x = (np.concatenate([bags[i] for i in part]) - m.mean) / m.scale
            first = np.concatenate([[0], np.cumsum(counts)])
            h, t, g, a, z, p = _forward(m, x, first)
            err = (p - labels[part]) / len(part)
            dz = np.repeat(err[:, None] * m.head, counts, 0)
            da = (dz * h).sum(1)
            draw = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), counts))
            dt, dg = draw[:, None] * m.weigh * g * (1 - t * t), draw[:, None] * m.weigh * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ m.attend.T + dg @ m.gate.T) * (1 - h * h)
            grad = {"encode": x.T @ dh + DECAY * m.encode, "encode_bias": dh.sum(0), "attend": h.T @ dt, "gate": h.T @ dg,
                    "weigh": (t * g).T @ draw, "head": z.T @ err + DECAY * m.head, "head_bias": err.sum()}
            pace = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k in names:
                u, v = moment[k]
                moment[k] = [0.9 * u + 0.1 * grad[k], 0.999 * v + 0.001 * grad[k] ** 2]
                setattr(m, k, getattr(m, k) - pace * moment[k][0] / (np.sqrt(moment[k][1]) + 1e-8))
    return m


def train(docs: DataFrame, labels: DataFrame, trainable, limit: int = SAMPLE) -> Model | None:
    """Fit on at most limit labelled documents picked by a hash of the id; of a document of more than
    SAMPLE_PASSAGES passages, that many evenly spread ones. The model is the same however the table is laid out.
    None without labelled rows."""
    picked = F.broadcast(label_sample(labels, "quality", trainable, limit))

    def make():
        def bag(block: Block) -> list:
            x, first = passages(block)
            spread = [x[f:t][np.linspace(0, t - f - 1, min(t - f, SAMPLE_PASSAGES)).astype(int)] if t > f else x[:0]
                      for f, t in zip(first[:-1], first[1:], strict=True)]
            return [[b.ravel() for b in spread]]
        return bag

    # In order of id and text, so that the fit does not follow the layout of the table.
    known = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(picked, "doc_id")
    rows = map_blocks(known, ["doc_id", "text_hash", "label"], [StructField("x", ArrayType(FloatType()))], make)
    rows = rows.toArrow().sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
    if not rows.num_rows:
        return None
    bags = [np.asarray(x.values, dtype=np.float64).reshape(-1, WIDTH) for x in rows["x"]]
    return fit(bags, rows["label"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs(doc_id, text): score (0 to 1, higher: better), predicted, and the
    number of passages. Null and empty texts get the score that labelled ones without words had, or
    the share of good documents. Without a model every score is 0.5. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def score(block: Block) -> list:
            x, first = passages(block)
            counts = np.diff(first)
            out = np.full(block.n, 0.5 if m is None else m.empty)
            has = counts > 0
            if m is not None and has.any():
                out[has] = _forward(m, (x - m.mean) / m.scale, np.append(first[:-1][has], first[-1]))[-1]
            return [out, counts.astype(np.int32)]
        return score

    scored = map_blocks(docs, ["doc_id"], [StructField("score", DoubleType()), StructField("n_passages", IntegerType())], make)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
