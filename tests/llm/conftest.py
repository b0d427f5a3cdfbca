import pytest

CLASHES = ["keep", "score", "tokens", "target", "copies", "draw", "kept", "n_lines", "_text", "_keep", "source_size", "cut", "whole", "rep", "_rest",
           "_range", "shard", "size", "base", "spans", "ids", "_did", "salt", "bucket"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)

ODD = [None, "", " \t\r\n", "\n\n", "one", "two words", "a b c d e f g", "Ünïcode — 中文 words and more of them here", "x" * 3000, "a " * 2000,
       "The same line of more than twenty chars\nsecond", "the same line of more than twenty chars  \nthird", "  THE SAME LINE OF MORE THAN TWENTY CHARS",
       "mail me at jo.do@mail.example.com or 10.0.0.1", "a b c d e f g", "a b c d e f g", "mail a@b.com or 1.2.3.\u00b2 and +1 555 010 0000",
       "0" * 5000 + ".1.2.3 and 10.0.0.1", "9 " * 3000 + "4111 1111 1111 1111", "@" * 500 + "1." * 500, "a\x1cb\x85c\u2003d"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, copies, repeated rows, a null id and clashing column names."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, *CLASHES) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[7], (None, "null id text of some words", *[None] * (3 + len(CLASHES)))], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
