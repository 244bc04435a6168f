"""Citations, embedded JSON and error messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import collapse_spaces

CONTEXT_LIMIT, LEFT_LIMIT, RIGHT_LIMIT = 320, 220, 140
CITATION = r"\[(\d+)\]"

# Message fragments that mark an error as transient.
UPSTREAM_FRAGMENTS = [
    "llm call timed out", "etimedout", "econnreset", "status code 429", " too many requests",
    "status: 429", "status 429", "status code 500", "status code 502", "status code 503",
    "status code 504", "status: 500", "status: 502", "status: 503", "status: 504",
]
DATABASE_FRAGMENTS = [
    "connection terminated", "connection timeout", "connection timed out", "timeout expired",
    "remaining connection slots are reserved", "sorry, too many clients already",
]
OCR_CODES = ["ocr_timeout", "ocr_missing_api_key", "ocr_parse_error", "ocr_tesseract_unavailable"]
OCR_WARNINGS = {
    "ocr_timeout": "ocr_rescue_timeout",
    "ocr_missing_api_key": "ocr_rescue_missing_api_key",
    "ocr_tesseract_unavailable": "ocr_rescue_tesseract_unavailable",
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def citation_ids(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(CITATION), 1)


def citation_context(content: Column | str, marker: Column | str) -> Column:
    """The sentence around the first occurrence of a marker such as '[1]'."""
    content, marker = _c(content), _c(marker)
    at = F.instr(content, marker)
    before = F.substring(content, F.lit(1), at - 1)
    after = F.substring(content, at + F.length(marker), F.length(content))
    left = F.trim(F.regexp_extract(before, r"(?s)([^\n.!?]*)$", 1))
    left = F.substring(left, F.greatest(F.length(left) - (LEFT_LIMIT - 1), F.lit(1)), F.lit(LEFT_LIMIT))
    bounded = after.rlike(r"[\n.!?]")
    right = F.when(bounded, F.regexp_extract(after, r"(?s)^([^\n.!?]*)", 1)).otherwise(
        F.substring(after, 1, RIGHT_LIMIT))
    right = F.substring(F.trim(right), 1, RIGHT_LIMIT)
    joined = F.substring(collapse_spaces(F.concat(left, F.lit(" "), right)), 1, CONTEXT_LIMIT)
    whole = F.substring(collapse_spaces(content), 1, CONTEXT_LIMIT)
    return F.when((at > 0) & (joined != ""), joined).otherwise(whole)


def footer_context(content: Column | str, marker: Column | str, highlight_text: Column | str) -> Column:
    preferred = F.substring(collapse_spaces(F.coalesce(_c(highlight_text), F.lit(""))), 1, CONTEXT_LIMIT)
    return F.when(preferred != "", preferred).otherwise(citation_context(content, marker))


def extract_json_object(text: Column | str, schema: str) -> Column:
    """First '{' to last '}', parsed; NULL when there is none or it does not parse."""
    found = F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.from_json(found, schema, {"mode": "PERMISSIVE"}))


def _any_fragment(message: Column, fragments: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(message, f))


def classify_error(message: Column | str) -> Column:
    """struct(code, stage, retryable, http_status); the first matching rule wins."""
    text = F.lower(F.coalesce(_c(message), F.lit("")))

    def verdict(code: str, stage: str, retryable: bool, status: int) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"),
                        F.lit(retryable).alias("retryable"), F.lit(status).alias("http_status"))
    return (F.when(_any_fragment(text, UPSTREAM_FRAGMENTS),
                   verdict("CHAT_UPSTREAM_TRANSIENT", "upstream", True, 503))
            .when(_any_fragment(text, DATABASE_FRAGMENTS),
                  verdict("CHAT_DB_TRANSIENT", "database", True, 503))
            .otherwise(verdict("CHAT_UNEXPECTED", "unknown", False, 500)))


def ocr_failure_code(message: Column | str) -> Column:
    message = _c(message)
    return F.when(message.isin(*OCR_CODES), message).otherwise(F.lit("ocr_error"))


def ocr_warning(message: Column | str) -> Column:
    code = ocr_failure_code(message)
    out = None
    for known, warning in OCR_WARNINGS.items():
        out = F.when(code == known, warning) if out is None else out.when(code == known, warning)
    return out.otherwise("ocr_rescue_error")
