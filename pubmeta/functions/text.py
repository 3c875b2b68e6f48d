"""Text functions: Column in, Column out, all evaluated inside the JVM.

Whitespace means the full Unicode set, so every function trims with
``WHITESPACE`` instead of the one-character default of ``trim``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubmeta.functions.blank import WHITESPACE, is_blank, trim_all
from pubmeta.functions.collections import distinct_ignore_case

# What the OCR side strips (adds the four ASCII separators).
OCR_WHITESPACE = WHITESPACE + "\x1c\x1d\x1e\x1f"

# Prefixes removed from a DOI, in this order.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")

# Patterns. (?i) ignore case, (?U) Unicode character classes,
# (?d) only \n ends a line.
DOI_PATTERN = r"(?iU)(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
ACM_PROCEEDINGS_PATTERN = (
    r"(?iU)(?:In\s+)?(?:Proceedings\s+of\s+the\s+)?"
    r"(\d{1,2}(?:st|nd|rd|th)\s+ACM\s+International\s+Conference\s+on\s+[^()]+?)\s*\(([^)]+)\)"
)
ACM_PUBLISHER_PATTERN = r"(?iU)\b(ACM|Association for Computing Machinery|ACM Reference Format)\b"
ACRONYM_BOUNDARY_PATTERN = r"(?U)(?<=[a-z])\s+(?=[A-Z]{2,}\b)"
MARKUP_PATTERN = r"(?d)<.*?>"


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_spaces(c: Column) -> Column:
    """Whitespace runs become one space; blank becomes NULL."""
    return _null_if_empty(trim_all(F.regexp_replace(c, r"(?U)\s+", " ")))


def null_if_blank(c: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return _null_if_empty(trim_all(c))


def join_non_empty(*parts: Column) -> Column:
    """Trimmed non-blank parts joined by one space; none gives NULL."""
    return _null_if_empty(F.concat_ws(" ", *[null_if_blank(p) for p in parts]))


def normalize_doi(c: Column) -> Column:
    """Bare DOI, or NULL when what is left does not start with ``10.``."""
    doi = trim_all(c)
    for prefix in DOI_PREFIXES:
        doi = F.regexp_replace(doi, r"(?i)\Q" + prefix + r"\E", "")
    doi = F.rtrim(trim_all(doi), F.lit(".,;"))
    return F.when(doi.startswith("10."), doi)


def extract_doi(text: Column) -> Column:
    """First DOI found anywhere in running text."""
    return _null_if_empty(F.regexp_extract(text, DOI_PATTERN, 1))


def normalize_arxiv(c: Column) -> Column:
    """Drop the ``arXiv:`` label and everything from the first bracket on."""
    bare = trim_all(F.regexp_replace(trim_all(c), r"(?i)arXiv:", ""))
    return null_if_blank(F.substring_index(bare, "[", 1))


def parse_year(when_attr: Column, text: Column) -> Column:
    """First four characters as INT. A present but empty attribute hides the text."""
    head = F.left(F.coalesce(when_attr, text), F.lit(4))
    return F.when(head.rlike(r"^\s*[+-]?[0-9]+\s*$"), head.try_cast("int"))


def acm_conference(text: Column) -> Column:
    return normalize_spaces(F.regexp_extract(text, ACM_PROCEEDINGS_PATTERN, 1))


def acm_venue(text: Column) -> Column:
    return normalize_spaces(F.regexp_extract(text, ACM_PROCEEDINGS_PATTERN, 2))


def mentions_acm(text: Column) -> Column:
    return F.coalesce(text.rlike(ACM_PUBLISHER_PATTERN), F.lit(False))


def split_keywords(terms: Column) -> Column:
    """Split terms at commas and before acronyms; first spelling of each keyword wins."""
    by_comma = F.flatten(F.transform(F.filter(terms, lambda t: t.isNotNull()), lambda t: F.split(t, ",")))
    pieces = F.flatten(F.transform(by_comma, lambda p: F.split(trim_all(p), ACRONYM_BOUNDARY_PATTERN)))
    cleaned = F.filter(F.transform(pieces, normalize_spaces), lambda k: k.isNotNull())
    return distinct_ignore_case(cleaned)


def strip_markup(c: Column) -> Column:
    """Remove tags and trim. Blank input gives NULL, markup-only input gives ``''``."""
    return F.when(~is_blank(c), trim_all(F.regexp_replace(c, MARKUP_PATTERN, "")))


def normalize_email(c: Column) -> Column:
    return F.lower(trim_all(c))


def normalize_role_name(c: Column) -> Column:
    """Upper case with underscores; blank gives NULL (the caller reports it)."""
    return F.regexp_replace(F.upper(null_if_blank(c)), " +", "_")


def format_pages(text: Column, first: Column, last: Column) -> Column:
    """Page text, else ``first-last``, else ``first``; ``last`` alone is not enough."""
    both = ~is_blank(first) & ~is_blank(last)
    return F.coalesce(
        F.when(~is_blank(text), text),
        F.when(both, F.concat(first, F.lit("-"), last)),
        null_if_blank(first),
    )


def attr_equals(attr: Column, value: str) -> Column:
    return F.lower(attr) == value.lower()


def strip_ocr(c: Column) -> Column:
    return trim_all(c, OCR_WHITESPACE)


def collapse_blank_lines(c: Column) -> Column:
    """Three or more newlines become two; ends stripped."""
    return strip_ocr(F.regexp_replace(c, "\n{3,}", "\n\n"))


def file_stem(name: Column) -> Column:
    """File name without its directory and its last extension."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*\z", "")


def safe_file_name(name: Column) -> Column:
    """Path separators and NUL become ``_``; empty pieces vanish."""
    return F.array_join(F.filter(F.split(name, "[/\x00]"), lambda p: p != ""), "_")
