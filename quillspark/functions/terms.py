"""Term vectors, text ranks and trigram similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
COVER_SPAN = 16.0


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(_c(text)), TOKEN_BREAK), "")


def distinct_terms(text: Column | str, stop_words: list[str] | None = None) -> Column:
    terms = F.array_distinct(tokens(text))
    return F.array_except(terms, F.array(*[F.lit(w) for w in stop_words])) if stop_words else terms


def run_starts(ordered: str, key: str | None = None) -> Column:
    """Where runs of equal elements (of a field of theirs) begin in a sorted array column."""
    def of(i: Column) -> Column:
        return F.get(F.col(ordered), i)[key] if key else F.get(F.col(ordered), i)
    every = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (i == 0) | (of(i) != of(i - 1)))


def run_lengths(ordered: str, starts: str, each) -> Column:
    """each(start, length) of every run."""
    return F.transform(starts, lambda b, j: each(b, F.coalesce(F.get(F.col(starts), j + 1), F.size(ordered)) - b))


def match_all(chunk_terms: Column | str, query_terms: Column | str) -> Column:
    """AND match; an empty query matches nothing."""
    return (F.size(_c(query_terms)) > 0) & (F.size(F.array_except(_c(query_terms), _c(chunk_terms))) == 0)


def squash(score: Column) -> Column:
    return score / (F.lit(1.0) + score)


def tf_weight(tf: Column, length: Column) -> Column:
    return F.log1p(tf.cast("double")) / (F.lit(1.0) + F.log(F.greatest(length, F.lit(1)).cast("double")))


def tf_rank(chunk_tokens: Column | str, query_terms: Column | str) -> Column:
    """Length-normalised log term frequency of the query terms, in [0, 1)."""
    def score(doc: Column) -> Column:
        total = F.aggregate(
            _c(query_terms), F.lit(0.0),
            lambda s, q: s + F.log1p(F.size(F.filter(doc, lambda t: t == q)).cast("double")))
        return squash(total / (F.lit(1.0) + F.log(F.greatest(F.size(doc), F.lit(1)).cast("double"))))
    return bind(_c(chunk_tokens), score)


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of each lower-cased word padded with two leading blanks and one trailing."""
    toks = tokens(text)
    lines = F.concat(F.lit("  "), F.array_join(toks, " \n  "), F.lit(" "))
    grams = F.regexp_extract_all(lines, F.lit(r"(?=([^\n]{3}))"), 1)
    return F.when(F.size(toks) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigram_overlap(a: Column | str, b: Column | str) -> Column:
    """Shared over united trigrams of two trigram sets, 0 when either is empty."""
    left, right = _c(a), _c(b)
    shared = F.size(F.array_intersect(left, right))
    united = F.size(left) + F.size(right) - shared
    return (F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
            .otherwise(shared.cast("double") / united))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return trigram_overlap(trigrams(a), trigrams(b))
