"""Language identification by string kernels: blended-spectrum n-gram presence kernels, Nyström
landmarks, one-versus-rest kernel ridge regression, scored by batched matrix products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from quillspark.llm.common import map_blocks
from quillspark.llm.rolling import LOWER, Block, blocks

UNDETERMINED = "und"
#: n-gram lengths in bytes and the size of the space they are hashed into.
LENGTHS, BITS = (1, 2, 3, 4), 14
#: Bound of the training sample, and of the landmarks within it, per language.
PER_LANGUAGE, LANDMARKS = 400, 24
RIDGE = 1e-3
_TILE = 64


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # hashed n-grams x landmarks, each landmark divided by its norm
    weights: np.ndarray    # landmarks x languages: Nyström whitening times ridge coefficients
    offset: np.ndarray


def presence(block: Block, i: int, j: int) -> np.ndarray:
    """Texts i to j of the block x hashed n-grams: 1 where the text has the n-gram."""
    low, high = block.offsets[i], block.offsets[j]
    data = LOWER[block.data[low:high]]
    row = np.repeat(np.arange(j - i) << BITS, np.diff(block.offsets[i:j + 1]))
    left = np.repeat(block.offsets[i + 1:j + 1] - low, np.diff(block.offsets[i:j + 1])) - np.arange(high - low)
    out = np.zeros((j - i) << BITS, np.uint8)
    value = np.zeros(high - low, np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        m = max(high - low - n + 1, 0)
        value = value[:m] * np.uint32(257) + data[n - 1:n - 1 + m] + np.uint32(1)
        if n in LENGTHS and m:
            mixed = (value * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            fits = left[:m] >= n
            out[row[:m][fits] + (mixed >> np.uint32(32 - BITS))[fits]] = 1
    return out.reshape(j - i, 1 << BITS)


def _features(block: Block, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel values: texts x landmarks."""
    out = np.zeros((block.n, landmarks.shape[1]), np.float32)
    for i in range(0, block.n, _TILE):
        j = min(i + _TILE, block.n)
        seen = presence(block, i, j)
        size = np.sqrt(np.maximum(seen.sum(1, dtype=np.int64), 1))[:, None]
        out[i:j] = seen.astype(np.float32) @ landmarks / size
    return out


def train(docs: DataFrame, trainable, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on about per_language rows of each language (a bounded sample picked by a hash of the id,
    cut at twice that bound in all). None without labelled rows. docs: doc_id, text, lang."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & trainable)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, per_language / counts[k])])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    picked = known.where(chance < shares[F.col("lang")]).select("doc_id", "lang", "text")
    rows = picked.orderBy(chance, "doc_id").limit(2 * per_language * len(languages)).select("lang", "text").toArrow()
    label = np.array([languages.index(x) for x in rows["lang"].to_pylist()])
    seen = [presence(b, i, i + 1)[0] for b in blocks(rows["text"]) for i in range(b.n)]
    if not seen:  # the hash picked no row of a tiny table
        rows = known.limit(per_language).select("lang", "text").toArrow()
        label = np.array([languages.index(x) for x in rows["lang"].to_pylist()])
        seen = [presence(b, i, i + 1)[0] for b in blocks(rows["text"]) for i in range(b.n)]
    x = np.stack(seen).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    marks = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(languages))])
    base = x[marks]
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ base.T).astype(np.float64) @ whiten
    target = (label[:, None] == np.arange(len(languages))).astype(np.float64)
    weight = 1 / np.maximum(np.bincount(label, minlength=len(languages)), 1)[label]
    weight /= weight.sum()
    mean, offset = weight @ phi, weight @ target
    centred = phi - mean
    gram = (centred * weight[:, None]).T @ centred + RIDGE * np.eye(phi.shape[1]) / len(phi)
    beta = np.linalg.solve(gram, (centred * weight[:, None]).T @ (target - offset))
    return Model(languages, np.ascontiguousarray(base.T), (whiten @ beta).astype(np.float32),
                 (offset - mean @ beta).astype(np.float32))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """A row for each row of docs(doc_id, text): lang_pred and score (0 to 1).

    A null text, or one without a letter, is 'und' with score 0; so is every text without a model.
    Ties go to the first language in order. Other columns are ignored."""
    letters = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    if model is None:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def score(block: Block) -> list:
            raw = _features(block, m.landmarks) @ m.weights + m.offset
            best = raw.argmax(1)
            exped = np.exp(8 * (raw - raw.max(1, keepdims=True)))
            return [pa.array([m.languages[k] for k in best], pa.string()),
                    (exped[np.arange(len(best)), best] / exped.sum(1)).astype(np.float64)]
        return score

    found = map_blocks(docs.withColumn("_letters", letters), ["doc_id", "_letters"],
                       [StructField("lang_pred", StringType()), StructField("score", DoubleType())], make)
    return found.select("doc_id", F.when(F.col("_letters"), F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
                        F.when(F.col("_letters"), F.col("score")).otherwise(0.0).alias("score"))
