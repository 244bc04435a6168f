"""Quality rules by repetition coverage: how much of a text lies inside repeated n-grams and lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from quillspark.llm.common import map_blocks
from quillspark.llm.rolling import LEAD, SPACE, Block, covered, grams, repeated, totals

#: Largest share of a text's word characters inside repeated n-grams, by n (published thresholds).
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters inside repeated lines, and of symbols per word.
LINE_LIMIT, SYMBOL_LIMIT = 0.20, 0.50
BASE_WINDOW, BASE_WORDS, BASE_PERCENT = 5, 10, 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure(block: Block) -> list:
    starts, ends, bounds = block.words(~SPACE)
    prefix = block.prefix()
    hashes = prefix.hash(starts, ends)
    lead = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(LEAD[block.data], out=lead[1:])
    chars = lead[ends] - lead[starts]
    word_chars = totals(chars, bounds)

    newline = np.flatnonzero(block.data == 10)
    owner = np.searchsorted(block.offsets, newline, "right") - 1
    line_starts = np.sort(np.concatenate([block.offsets[:-1], newline + 1]))
    line_ends = np.sort(np.concatenate([block.offsets[1:], newline]))
    line_bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=block.n) + 1)])
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_of = np.repeat(np.arange(block.n), np.diff(line_bounds))[worded]
    line_first = np.concatenate([[0], np.cumsum(np.bincount(line_of, minlength=block.n))])
    line_hash = prefix.hash(line_starts[worded], line_ends[worded])
    # A stable sort keeps the first of equal lines in front of its copies.
    order = np.lexsort((line_hash, line_of))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (line_of[order[1:]] == line_of[order[:-1]])
    line_chars = lead[line_ends[worded]] - lead[line_starts[worded]]

    shares = []
    n_repeat = None
    for n in GRAM_LIMITS:
        values, first = grams(hashes, bounds, n)
        inside = covered(repeated(values, first), first, bounds, n)
        if n == BASE_WINDOW:
            n_repeat = totals(inside, bounds)
        shares.append(totals(chars * inside, bounds) / np.maximum(word_chars, 1))
    return [np.diff(bounds), word_chars, totals(_SYMBOL[block.data], block.offsets), totals(later, line_first), n_repeat,
            totals(line_chars * later, line_first) / np.maximum(np.diff(lead[block.offsets]), 1), *shares]


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text): the counts of repeated, symbol and word characters,
    the share of characters inside repeated n-grams and lines, base_failed and kept.

    Words are runs of other than ASCII white space. A null or empty text has no words, so it fails.
    Repeated rows are judged each by itself; other columns are ignored."""
    fields = [StructField(c, LongType()) for c in
              ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    shares = ["dup_line_share", *(f"dup_{n}gram_share" for n in GRAM_LIMITS)]
    counts = map_blocks(docs, ["doc_id"], fields + [StructField(c, DoubleType()) for c in shares], lambda: _measure)
    failed = ((F.col("n_words") < BASE_WORDS)
              | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words")))
    passes = (F.col("dup_line_share") <= LINE_LIMIT) & (F.col("n_symbols") <= SYMBOL_LIMIT * F.col("n_words"))
    for n, most in GRAM_LIMITS.items():
        passes &= F.col(f"dup_{n}gram_share") <= most
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & passes)
