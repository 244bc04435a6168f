"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams. Rates are
kept per coordinate, and the L1 term leaves few non-zero weights, which are cheap to broadcast.
Besides itself, a word enters by its first few bytes, so that inflected forms share a weight."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from quillspark.llm.common import label_sample, map_blocks
from quillspark.llm.rolling import ALNUM, LOWER, Block, grams, mix

BITS = 20
#: Bound of the training sample in documents.
SAMPLE = 6000
#: Rate and sparsity were chosen by three-fold cross-validation over training rows alone.
ALPHA, BETA, L1, L2, EPOCHS, SEED = 1.0, 1.0, 5.0, 0.0, 8, 5
#: Bytes of the stems, and the least number of sampled documents that a feature must occur in.
STEMS, LEAST = (4, 5, 6), 4
THRESHOLD = 0.7


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, stems, word pairs and pairs around one skipped word of every text, with the text's index."""
    starts, ends, bounds = block.words(ALNUM)
    prefix = block.prefix(LOWER[block.data])
    words = prefix.hash(starts, ends)
    owner = np.repeat(np.arange(block.n), np.diff(bounds))
    pairs, pairs_first = grams(words, bounds, 2)
    counts = np.maximum(np.diff(bounds) - 2, 0)
    at = np.arange(counts.sum()) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    skips = mix(words[at] + np.uint64(3) * mix(words[at + 2])) if len(at) else words[:0]
    stems, stem_owners = [], []
    for n in STEMS:
        longer = ends - starts > n
        stems.append(mix(prefix.hash(starts[longer], starts[longer] + n) + np.uint64(n)))
        stem_owners.append(owner[longer])
    values = np.concatenate([mix(words), *stems, pairs, skips]) >> np.uint64(64 - BITS)
    owners = np.concatenate([owner, *stem_owners, np.repeat(np.arange(block.n), np.diff(pairs_first)),
                             np.repeat(np.arange(block.n), counts)])
    return values.astype(np.int64), owners


@dataclass
class Model:
    index: np.ndarray   # features with a weight, in order
    weight: np.ndarray
    bias: float


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """FTRL-proximal over documents as sets of features, in a fixed shuffled order."""
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=1 << BITS)
    rows = [r[seen[r] >= LEAST] for r in rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(SEED)

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f = rows[i]
            w, b = solve(z[f], n[f], L1), float(solve(np.float64(bias_z), np.float64(bias_n), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[i]
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA * w
            n[f] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += g * g
    w = solve(z, n, L1)
    index = np.flatnonzero(w)
    return Model(index, w[index], float(solve(np.float64(bias_z), np.float64(bias_n), 0.0)))


def train(docs: DataFrame, labels: DataFrame, trainable, limit: int = SAMPLE) -> Model | None:
    """Fit on at most limit labelled documents, whole texts, picked by a hash of the id. None without
    labelled rows."""
    picked = F.broadcast(label_sample(labels, "toxic", trainable, limit))

    def make():
        def sets(block: Block) -> list:
            values, owners = features(block)
            keyed = np.unique(owners << BITS | values)
            cuts = np.searchsorted(keyed, np.arange(1, block.n) << BITS)
            return [[(x & ((1 << BITS) - 1)).astype(np.int32) for x in np.split(keyed, cuts)]]
        return sets

    rows = map_blocks(docs.join(picked, "doc_id"), ["doc_id", "label"],
                      [StructField("f", ArrayType(IntegerType()))], make).orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return None
    return fit([np.asarray(x.values, dtype=np.int64) for x in rows["f"]], rows["label"].to_numpy().astype(np.float64))


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs(doc_id, text): score (0 to 1, higher: more toxic) and predicted. A null
    or empty text has no features and gets the score of the bias alone; without a model every score
    is 0. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        dense = np.zeros(1 << BITS)
        if m is not None:
            dense[m.index] = m.weight

        def score(block: Block) -> list:
            if m is None:
                return [np.zeros(block.n)]
            values, owners = features(block)
            used = dense[values] != 0
            keyed = np.unique(owners[used] << BITS | values[used])
            logit = m.bias + np.bincount(keyed >> BITS, dense[keyed & ((1 << BITS) - 1)], block.n)
            return [1 / (1 + np.exp(-np.clip(logit, -35, 35)))]
        return score

    scored = map_blocks(docs, ["doc_id"], [StructField("score", DoubleType())], make)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
