"""Token ids by public vocabulary files, for one task at a time: loaded when first needed and dropped with it."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Characters encoded at a time; longer texts are cut where no token of either kind can cross.
PART = 1 << 16
_SAFE = re.compile("[0-9A-Za-z] (?=[A-Za-z])")

# Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def parts(text: str, size: int = PART) -> Iterator[str]:
    """text in parts of about size characters; each but the first begins with the space of ` word`, before which
    both kinds of tokens end. Without such a place a part is longer."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


class ByteLevel:
    """Ids of a byte-level BPE file of the tokenizers library. Texts of Latin letters, where the Unicode tables
    of both libraries agree, are encoded by tiktoken from the same vocabulary, which is several times
    faster; tokenizers itself is loaded only for others. Control strings inside texts are tokens of
    their own unless plain is set."""

    _other = re.compile("[^\u0000-ɏ]")

    def __init__(self, path: str, plain: bool = False) -> None:
        import tiktoken

        self.path, self.plain = path, plain
        self._exact = None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes[i] = token
        self._fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._allowed = set() if plain else "all"

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._exact = Tokenizer.from_file(self.path)
            self._exact.encode_special_tokens = self.plain
        return self._exact

    def _part(self, text: str) -> np.ndarray:
        if self._other.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self._fast.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=())

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return self._part(text)
        return np.concatenate([self._part(part) for part in parts(text)])


class Pieces:
    """Ids of a sentencepiece BPE file. bytes: each piece in UTF-8, its space mark as a space, a byte piece as
    its byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]
        #: Whether no piece goes on over a space, so that texts can be cut before ` word`.
        self._cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= PART or not self._cuts:
            return np.array(self._model.encode(text), dtype=np.uint32)
        out = [self._model.encode(part[1:] if i else part) for i, part in enumerate(parts(text))]
        return np.concatenate([np.array(x, dtype=np.uint32) for x in out])
