"""Text, hashing and scoring functions, as Column expressions.

White space is Unicode's, as Python's str.strip() and \\s have it. An empty string counts as missing wherever a default
applies.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import STOPWORDS

WS = r"[\t-\r\x1C-\x20\x85\xA0  -     　]"
#: Where Python's str.splitlines() breaks.
BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"
TERM = "[a-z0-9][a-z0-9-]{2,}"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def default(c: Column | str, value: Column | str) -> Column:
    """c unless it is null or empty."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(value) if isinstance(value, str) else value)


def blank(c: Column | str) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), rf"\A{WS}+|{WS}+\z", "")


def normalize_for_hash(c: Column | str) -> Column:
    # Runs become one space each first, so that what is left at the ends needs no pattern.
    return F.lower(F.trim(F.regexp_replace(blank(c), f"{WS}+", " ")))


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.encode(normalize_for_hash(c), "UTF-8"), 256)


def slugify(c: Column | str, fallback: str = "chunk") -> Column:
    slug = F.regexp_replace(F.lower(strip(blank(c))), "[^a-zA-Z0-9._-]+", "-")
    return default(F.substring(F.regexp_replace(slug, r"\A-+|-+\z", ""), 1, 80), fallback)


def chunk_id(url: Column, heading: Column, index: Column, text: Column) -> Column:
    """slug-index-digest; the index has four digits at least."""
    digits = index.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    seed = F.concat_ws("|", blank(url), blank(heading), digits, F.substring(blank(text), 1, 200))
    return F.concat_ws("-", slugify(default(heading, "intro"), "intro"), padded, F.substring(F.sha1(F.encode(seed, "UTF-8")), 1, 12))


def document_id(url: Column, title: Column) -> Column:
    return F.concat_ws("-", slugify(default(title, blank(url)), "document"), F.right(slugify(url, "page"), F.lit(12)))


def query_terms(c: Column | str, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Distinct terms in order of first occurrence."""
    found = F.regexp_extract_all(F.lower(blank(c)), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.array_except(found, F.array(*map(F.lit, stopwords))))


def keywords(c: Column | str, stopwords: Iterable[str], limit: int = 8) -> Column:
    return F.slice(query_terms(c, stopwords), 1, limit)


def term_hits(text: Column | str, terms: Column | str) -> Column:
    """How many terms are substrings of the lower-cased text."""
    # As a lambda's variable the text is lowered once and not for each term.
    return F.element_at(F.transform(F.array(F.lower(blank(text))), lambda low: F.size(F.filter(_c(terms), lambda t: F.contains(low, t)))), 1)


def relevance(distance: Column | str) -> Column:
    d = _c(distance)
    return F.when(d.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - d.cast("double"))))


def authorized(access: Column | str) -> Column:
    """A missing access passes."""
    return F.lower(strip(default(access, "authenticated"))).isin("authenticated", "authorized")


def count_tokens(c: Column | str) -> Column:
    """About four code points a token."""
    n = F.length(blank(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.floor((n + 3) / 4)).cast("int")


def truncate_to_tokens(c: Column | str, tokens: int) -> Column:
    c = _c(c)
    return F.when(count_tokens(c) <= tokens, c).otherwise(F.substring(c, 1, tokens * 4))


def overlap_suffix(c: Column | str, tokens: int) -> Column:
    return F.right(blank(c), F.lit(tokens * 4)) if tokens > 0 else F.lit("")


def normalize_whitespace(c: Column | str) -> Column:
    """Stripped lines with at most one blank line between them."""
    t = F.regexp_replace(blank(c), " ", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    lines = F.transform(F.split(t, BREAK), lambda x: strip(x))
    t = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return strip(t)


#: Phrases of page footers.
FOOTER_PHRASES = ("copyright", "all rights reserved", "privacy policy", "terms of use", "cookie settings", "follow us")


def is_footer_boilerplate(c: Column | str) -> Column:
    t = strip(F.lower(blank(c)))
    phrase = F.lit(False)
    for p in FOOTER_PHRASES:
        phrase = phrase | F.contains(t, F.lit(p))
    return (t == "") | ((F.length(t) < 120) & phrase) | t.rlike(r"\A(©|\(c\))[^\n]*\z")


def markdown_links(c: Column | str) -> Column:
    """array<struct<text, url>> of [text](http...) in order."""
    pattern = F.lit(r"\[([^\]]+)\]\((https?://[^)]+)\)")
    texts, urls = (F.regexp_extract_all(blank(c), pattern, F.lit(k)) for k in (1, 2))
    return F.zip_with(texts, urls, lambda t, u: F.struct(t.alias("text"), u.alias("url")))


# Patterns of secrets in logs and in errors.
LOG_SECRET = r"(?i)(cookie|set-cookie|authorization|bearer|password|passwd|secret|token|mfa|otp)\s*[=:]\s*\S+"
ERROR_SECRET = r"(?i)(api[_-]?key|password|secret|token)\s*[=:]\s*\S+"
BEARER = r"(?i)\bbearer\s+\S+"
KEY = r"\bsk-[A-Za-z0-9_-]{8,}"


def redact(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(blank(c), LOG_SECRET, "$1=***"), BEARER, "bearer ***")


def safe_error(kind: Column | str, message: Column | str) -> Column:
    """`Kind: message` without secrets; a blank message is the kind."""
    kind = _c(kind)
    t = default(strip(blank(message)), kind)
    t = F.regexp_replace(F.regexp_replace(t, ERROR_SECRET, "$1=***"), BEARER, "bearer ***")
    return F.concat(kind, F.lit(": "), F.regexp_replace(t, KEY, "***"))


def configured(c: Column | str) -> Column:
    """Not blank and not a placeholder."""
    t = strip(blank(c))
    return (t != "") & ~F.contains(F.upper(t), F.lit("REPLACE_WITH"))
