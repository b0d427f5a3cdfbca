"""Text functions: issue keys, module names, tokens, and match and rank on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how trackers write issue keys.
ISSUE_KEY = r"\b([A-Z][A-Z0-9]+-\d+)\b"

# English function words that full-text search leaves out; a choice of this library.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
              "the", "this", "to", "was", "with")


def issue_keys(text: Column) -> Column:
    """Distinct issue keys in a text, without leading zeros, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(ISSUE_KEY), F.lit(1))
    return F.array_distinct(F.transform(found, lambda k: F.regexp_replace(k, "-0+([0-9])", "-$1")))


def module_name(path: Column) -> Column:
    """The first two segments of a path; shorter paths are their own module."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) <= 2, path).otherwise(F.array_join(F.slice(parts, 1, 2), "/"))


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric words without stop words, in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def query_terms(query: str) -> list[str]:
    import re

    return sorted({w for w in re.split("[^a-z0-9]+", query.lower()) if w and w not in STOP_WORDS})


def matches(text: Column, query: str) -> Column:
    """Whether a text has all terms of a query; a query without terms matches nothing."""
    terms = query_terms(query)
    words = tokens(text)
    return F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) == len(terms) if terms else F.lit(False)


def rank(text: Column, query: str) -> Column:
    """Share of a text's words that are terms of the query."""
    terms = query_terms(query)
    words = tokens(text)
    hits = F.size(F.filter(words, lambda w: w.isin(*terms))) if terms else F.lit(0)
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def has(column: str, part: str) -> Column:
    """Whether a column holds a part, in any case; % and _ in the part stay wildcards."""
    return F.col(column).ilike(f"%{part}%")
