import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions.rich_text import document_of, from_markdown, markdown_of, to_markdown

TEXTS = ["# Title", "plain **bold** *slanted* `code` [link](http://x.y) end", "- a\n- b", "1. a\n2. b", "> quoted", "---", "```py\nx = 1\n\ny\n```",
         "| a | b |\n| --- | --- |\n| 1 | 2 |", "one\n\ntwo"]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    assert to_markdown(from_markdown(text)) == text


def doc(*content):
    return json.dumps({"type": "doc", "version": 1, "content": list(content)})


def test_blocks():
    p = lambda t: {"type": "paragraph", "content": [{"type": "text", "text": t}]}
    item = lambda *c, **a: {"type": "listItem", "content": list(c), "attrs": a}
    assert to_markdown(doc({"type": "bulletList", "content": [item(p("a"), {"type": "bulletList", "content": [item(p("b"))]})]})) == "- a\n  - b"
    assert to_markdown(doc({"type": "taskList", "content": [item(p("a"), state="DONE"), item(p("b"))]})) == "- [x] a\n- [ ] b"
    assert to_markdown(doc({"type": "orderedList", "attrs": {"order": 3}, "content": [item(p("a")), item()]})) == "3. a\n4."
    assert to_markdown(doc({"type": "blockquote", "content": [p("a"), p("b")]})) == "> a\n>\n> b"
    assert to_markdown(doc({"type": "panel", "content": [p("a")]}, {"type": "mediaSingle"}, {"type": "rule"})) == "a\n\n---"
    assert to_markdown(doc({"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "inlineCard", "attrs": {"url": "u"}}]})) == "a\nu"


def test_other_texts_stay():
    for text in ("plain", '{"type":"other"}', "{broken", "", None):
        assert to_markdown(text) == text
    assert json.loads(from_markdown(""))["content"] == [{"type": "paragraph", "content": [{"type": "text", "text": ""}]}]


def test_columns(spark):
    rows = spark.createDataFrame([("# A",), (None,)], "t string").select(markdown_of(document_of(F.col("t"))).alias("t")).collect()
    assert [r.t for r in rows] == ["# A", None]
