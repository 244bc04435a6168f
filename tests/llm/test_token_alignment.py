"""Alignment of two tokenizers against a plain version, whole and in fragments."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import token_alignment as ta
from quillspark.llm.queries import piece_path, tokenizer_path

RNG = random.Random(3)
WORDS = ["the", "unbelievable", "x1", "don't", "<|endoftext|>", "<s>", "naïve", "日本語", "12345", "a\tb", "\n\n", "🙂", "ﬁ", "...", "  "]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


TEXTS = [None, "", " ", "a", "\n", "The unbelievable thing.", "  two  spaces ", "日本語 テキスト", "<|endoftext|>", "</s><unk>", "▁x ▁", " x",
         "é", "x" * 700, "\x00 a", prose(300), prose(40), prose(40), "🙂" * 60, "the " * 200]
ROWS = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(16, TEXTS[16])]


def plain():
    """Tokens, groups and overlapping pairs by the contract, by trying every pair of a text."""
    a_model, b_model = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=piece_path())
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    rows, total = [], Counter()
    for doc, text in ROWS:
        found = None
        if text:
            a_ids, b_ids = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_bytes = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a_ids]
            b_bytes = []
            for i in b_ids:
                p = b_model.id_to_piece(i)
                b_bytes.append(bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode())
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
                groups, ga, gb = [], [], []
                common = sorted(set(ends[0]) & set(ends[1]))
                for low, high in zip([0, *common], common):
                    ga = [str(i) for i, e in zip(a_ids, ends[0]) if low < e <= high]
                    gb = [str(i) for i, e in zip(b_ids, ends[1]) if low < e <= high]
                    groups.append(",".join(ga) + "|" + ",".join(gb))
                pairs = [(i, j) for i, e, n in zip(a_ids, ends[0], map(len, a_bytes)) for j, f, m in zip(b_ids, ends[1], map(len, b_bytes))
                         if e - n < f and f - m < e]
                total.update(pairs)
                found = len(a_ids), len(b_ids), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append((doc, found))
    best = {}
    for (_, j), n in total.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((d, *f[:3], len(f[3]), sum(total[p] == best[p[1]] for p in f[3]), sum(total[p] for p in f[3]), f[4]) if f else
                   (d, 0, 0, 0, 0, 0, 0, "") for d, f in rows), key=str)


@pytest.mark.parametrize("limits", [{}, {"chunk": 40, "fan": 2}, {"chunk": 300, "fan": 3, "max_pairs": 0}])
def test_token_alignment(spark, limits):
    """Whole texts; texts in fragments under a tree of joins; with the counts joined by shuffle."""
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in ROWS], "doc_id long, text string, n_a long, groups string").repartition(3)
    got = ta.token_alignment(docs, tokenizer_path(), piece_path(), **limits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain()
    assert ta.token_alignment(docs.limit(0), tokenizer_path(), piece_path(), **limits).count() == 0


def test_groups_are_kept_where_asked(spark):
    docs = spark.createDataFrame([(1, "The unbelievable thing."), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ta.alignments(docs, tokenizer_path(), piece_path()).collect()}
    assert rows[1]["groups"].count(";") + 1 == rows[1]["n_groups"] and rows[2]["groups"] == ""
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"]


def test_joining_is_associative():
    """Any tree of joins of any cut gives what the whole text gives."""
    names, rng = ta.Names(100), np.random.default_rng(1)
    for _ in range(60):
        size = int(rng.integers(1, 60))
        ends = [np.append(np.flatnonzero(rng.random(size - 1) < .4) + 1, size) for _ in range(2)]
        tokens = ta.Open(rng.integers(0, 100, len(ends[0])), ends[0], rng.integers(0, 100, len(ends[1])), ends[1])
        want = ta.whole(tokens, names)
        cuts = sorted({0, size, *rng.integers(0, size + 1, 5).tolist()})
        parts = []
        for low, high in zip(cuts, cuts[1:]):
            inside = [slice(*np.searchsorted(e, [low, high], "right")) for e in ends]
            parts.append(ta.fragment(tokens.cut(*inside), names))
        while len(parts) > 1:
            at = int(rng.integers(0, len(parts) - 1))
            parts[at:at + 2] = [ta.join(parts[at:at + 2], names)]
        got = ta.finished(parts[0], names)
        assert (got.groups, got.n_groups, got.n_links) == (want.groups, want.n_groups, want.n_links)
        assert [x.tolist() for x in got.pairs] == [x.tolist() for x in want.pairs]
