"""A gate that lets only reading statements through."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ROW_LIMIT = 1000

# Statements that may begin a query, and words that no query may hold.
READING = ("SELECT", "EXPLAIN", "SHOW", "DESCRIBE", "DESC", "WITH")
WRITING = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "CALL",
           "MERGE", "UPSERT", "REPLACE", "LOCK", "UNLOCK")


class Rejected(ValueError):
    """A statement that is not a single reading one."""


def _without_parentheses(sql: str) -> str:
    """sql with everything in parentheses left out."""
    depth, kept = 0, []
    for c in sql:
        depth += c == "("
        if not depth:
            kept.append(c)
        depth -= c == ")" and depth > 0
    return "".join(kept)


def check(sql: str) -> str:
    """sql without a closing semicolon, or Rejected."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise Rejected("empty statement")
    first = re.match(r"\w*", text)[0].upper()
    if first not in READING:
        raise Rejected(f"a statement may not begin with {first or text[0]}")
    if ";" in text:
        raise Rejected("only one statement at a time")
    for word in WRITING:
        if re.search(rf"\b{word}\b", text, re.IGNORECASE):
            raise Rejected(f"{word} is not allowed")
    if first == "WITH" and not re.search(r"\bSELECT\b", _without_parentheses(text), re.IGNORECASE):
        raise Rejected("WITH must lead to a SELECT")
    return text


def run(spark: SparkSession, sql: str, limit: int = ROW_LIMIT, **args) -> DataFrame:
    """At most limit rows of a checked statement."""
    return spark.sql(check(sql), args=args or None).limit(limit)
