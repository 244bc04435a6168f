"""Scalar text functions. Every function takes and returns Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Patterns that decide what counts as a header, sentence end or acronym.
MARKDOWN_HEADER = r"(?U)^(#{1,6})\s+(.+)$"
TITLE_LINE = r"(?U)^([0-9]+\.?\s+)?([A-ZĚŠČŘŽÝÁÍÉ][A-Za-zěščřžýáíéůú\s]+)[:.]?\s*$"
TITLE_MAX_LENGTH = 80
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"
ACRONYM = r"\b([A-Z][A-Z0-9_:-]{2,})\b"
UPLOAD_PREFIX = r"^[^_]+_[0-9a-fA-F-]{36}_"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_unicode(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def collapse_spaces(col: Column | str) -> Column:
    """Whitespace runs to one blank, then trim."""
    return F.trim(F.regexp_replace(_c(col), r"(?U)\s+", " "))


@lru_cache(maxsize=2)
def _accent_map(lower_only: bool) -> tuple[str, str]:
    """Characters whose canonical decomposition is one ASCII character plus marks, and
    the marks themselves (which translate() drops, having no counterpart)."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        if 0x300 <= code <= 0x36F or (lower_only and char.lower() != char):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base.isascii():
            source.append(char)
            target.append(base)
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(source) + marks, "".join(target)


def strip_accents(col: Column | str) -> Column:
    """Remove combining marks, composed or not; case is kept."""
    return F.translate(_c(col), *_accent_map(False))


@lru_cache(maxsize=1)
def _long_capitals() -> tuple[str, str]:
    """Characters whose capital form is several characters, and the one character each stands for alone."""
    source, target = [], []
    for char in map(chr, range(0x80, 0x10000)):
        if len(char.upper()) > 1:
            title = char.title()
            source.append(char)
            target.append("\u1e9e" if char == "\u00df" else title if len(title) == 1 else char)
    return "".join(source), "".join(target)


def upper_single(col: Column | str) -> Column:
    """Upper case, one character for one as in SQL: a sharp s becomes its capital, not 'SS', and a character
    without a capital of its own stays. upper() runs only over what it does not lengthen."""
    value, (source, target) = _c(col), _long_capitals()
    single = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(
        c.rlike(f"[{source}]"), F.translate(c, source, target)).otherwise(F.upper(c))), "")
    return F.when(value.rlike(f"[{source}]"), single).otherwise(F.upper(value))


def normalize_match(col: Column | str) -> Column:
    """Lower case, accents removed, everything but [a-z0-9] becomes one blank."""
    plain = F.translate(F.lower(_c(col)), *_accent_map(True))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def tokenize_match(col: Column | str, min_length: int = 3) -> Column:
    return F.regexp_extract_all(normalize_match(col), F.lit(f"([a-z0-9]{{{min_length},}})"), 1)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def normalize_term(col: Column | str) -> Column:
    """NFKC, lower, trim, then blank out everything that is not a letter, digit, blank, '_', ':' or
    '-'. The trim comes first, so an edge blank may remain. NFKC leaves ASCII as it is, so only
    other rows cross into Python, as Arrow batches; the rest are NULL there."""
    beyond = _c(col).rlike(r"[^\x00-\x7F]")
    folded = F.when(beyond, _nfkc(F.when(beyond, _c(col)))).otherwise(_c(col))
    return _clean_term(folded)


def _clean_term(col: Column) -> Column:
    """normalize_term without the folding, for text that needs none."""
    trimmed = trim_unicode(F.lower(col))
    return F.regexp_replace(F.regexp_replace(trimmed, r"(?U)[^\p{L}\p{N}\s_:-]", " "), r"(?U)\s+", " ")


def normalize_query(col: Column | str) -> Column:
    return F.regexp_replace(trim_unicode(F.lower(_c(col))), r"(?U)\s+", " ")


def normalize_namespace(col: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(trim_unicode(F.lower(_c(col))), r"(?U)\s+", "-"), F.lit(""))


def query_hash(col: Column | str, namespace: str | Column | None = None) -> Column:
    query = normalize_query(col)
    if namespace is None:
        return F.sha2(query, 256)
    space = normalize_namespace(F.lit(namespace) if isinstance(namespace, str) else namespace)
    return F.sha2(F.when(space == "", query).otherwise(F.concat(space, F.lit("::"), query)), 256)


def words(col: Column | str) -> Column:
    return F.array_remove(F.split(_c(col), r"(?U)\s+"), "")


def estimate_tokens(col: Column | str) -> Column:
    return F.ceil(F.size(words(col)) * F.lit(1.5)).cast("int")


def estimate_api_tokens(col: Column | str) -> Column:
    return F.ceil(F.length(_c(col)) / F.lit(4.0)).cast("int")


def detect_header(col: Column | str) -> Column:
    """struct(level, text), or NULL when the line is no header."""
    line = _c(col)
    hashes = F.regexp_extract(line, MARKDOWN_HEADER, 1)
    title = (F.length(line) < TITLE_MAX_LENGTH) & line.rlike(TITLE_LINE)
    shape = "struct<level:int,text:string>"
    return (F.when(hashes != "", F.struct(F.length(hashes).alias("level"),
                                          trim_unicode(F.regexp_extract(line, MARKDOWN_HEADER, 2)).alias("text")))
            .when(title, F.struct(F.lit(2).alias("level"), trim_unicode(line).alias("text")))
            .cast(shape))


def split_sentences(col: Column | str) -> Column:
    return F.split(_c(col), SENTENCE_BREAK)


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def candidate_terms(col: Column | str, max_words: int = 3) -> Column:
    """Distinct 1..max_words-grams of the normalised query plus its acronyms."""
    query = _c(col)

    def grams(tokens: Column) -> Column:
        return F.concat(*[
            F.transform(
                F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))),
                         lambda i: i + F.lit(n - 1) <= F.size(tokens)),
                lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
            for n in range(1, max_words + 1)])
    spoken = bind(F.array_remove(F.split(normalize_term(query), " "), ""), grams)
    acronyms = F.transform(F.regexp_extract_all(query, F.lit(ACRONYM), 1), _clean_term)  # acronyms are ASCII
    return F.filter(F.array_distinct(F.concat(spoken, acronyms)), lambda t: F.length(t) > 1)


def display_filename(col: Column | str) -> Column:
    base = F.regexp_extract(_c(col), r"([^/\\]*)$", 1)
    return F.regexp_replace(F.when(base == "", _c(col)).otherwise(base), UPLOAD_PREFIX, "")


def sanitize_filename(col: Column | str) -> Column:
    return F.regexp_replace(strip_accents(col), "[^a-zA-Z0-9._-]", "_")


def chat_title(col: Column | str, length: int = 50) -> Column:
    return F.substring(_c(col), 1, length)


def snippet(col: Column | str, length: int = 200) -> Column:
    return F.concat(F.substring(_c(col), 1, length), F.lit("..."))


def parse_effective_at(col: Column | str, as_of: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(_c(col)), as_of)
