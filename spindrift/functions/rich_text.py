"""Trackers' rich-text documents (JSON) to Markdown and back, as Arrow UDFs over columns."""

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WRAPS = {"strong": "**{}**", "em": "*{}*", "code": "`{}`"}


def _attr(node: dict, name: str, kind: type, default):
    value = (node.get("attrs") or {}).get(name)
    return value if isinstance(value, kind) else default


def _span(node: dict) -> str:
    kind = node.get("type")
    if kind == "text":
        out = node.get("text") or ""
        for mark in node.get("marks") or []:
            name = mark.get("type")
            out = f"[{out}]({_attr(mark, 'href', str, '')})" if name == "link" else WRAPS.get(name, "{}").format(out)
        return out
    return {"hardBreak": "\n", "inlineCard": _attr(node, "url", str, "")}.get(kind, _spans(node))


def _spans(node: dict) -> str:
    return "".join(map(_span, node.get("content") or []))


def _item(node: dict, indent: str) -> str:
    """A list item's first block on the marker's line, further blocks below it."""
    blocks = node.get("content") or []
    if not blocks:
        return ""
    lead = blocks[0] if blocks[0].get("type") in ("paragraph", "heading") else node
    below = [b for b in blocks[1:] if b.get("type") != "text"]
    return _spans(lead) + ("\n" + _blocks(below, indent) if below else "")


def _list(node: dict, indent: str) -> str:
    first = _attr(node, "order", int, 1)
    lines = []
    for i, item in enumerate(node.get("content") or []):
        if node["type"] == "orderedList":
            marker, deeper = f"{first + i}. ", "   "
        else:
            box = "[x] " if _attr(item, "state", str, "") == "DONE" else "[ ] "
            marker, deeper = "- " + box * (node["type"] == "taskList"), "  "
        lines.append(indent + marker + _item(item, indent + deeper))
    return "\n".join(lines)


def _table(node: dict) -> str:
    grid = [[_spans((c.get("content") or [{}])[0]) for c in row.get("content") or []] for row in node.get("content") or []]
    if grid:
        grid.insert(1, ["---"] * len(grid[0]))
    return "\n".join(f"| {' | '.join(row)} |" for row in grid)


def _block(node: dict, indent: str) -> str | None:
    kind = node.get("type")
    if kind == "paragraph":
        return indent + _spans(node)
    if kind == "heading":
        return "#" * _attr(node, "level", int, 1) + " " + _spans(node)
    if kind in ("bulletList", "orderedList", "taskList"):
        return _list(node, indent)
    if kind == "codeBlock":
        return f"```{_attr(node, 'language', str, '')}\n{_spans(node)}\n```"
    if kind == "blockquote":
        return "\n".join(f"> {line}" if line else ">" for line in _blocks(node.get("content") or [], "").split("\n"))
    if kind == "table":
        return _table(node)
    if kind == "rule":
        return "---"
    return _blocks(node["content"], indent) if node.get("content") else None


def _blocks(nodes: list[dict], indent: str) -> str:
    return "\n\n".join(b for b in (_block(n, indent) for n in nodes) if b is not None)


def to_markdown(text: str | None) -> str | None:
    """Markdown of a rich-text document; any other text stays as it is."""
    try:
        doc = json.loads(text) if text else None
    except ValueError:
        return text
    if not isinstance(doc, dict) or doc.get("type") != "doc" or not isinstance(doc.get("content"), list):
        return text
    return _blocks(doc["content"], "").strip()


INLINE = re.compile(r"\*\*(?P<strong>.+?)\*\*|\*(?P<em>.+?)\*|_(?P<em2>.+?)_|`(?P<code>.+?)`|\[(?P<link>[^\]]+)\]\((?P<href>[^)]+)\)")


def _inline(text: str) -> list[dict]:
    out, at = [], 0
    for m in INLINE.finditer(text):
        if m.start() > at:
            out.append({"type": "text", "text": text[at:m.start()]})
        kind = m.lastgroup.rstrip("2") if m.lastgroup != "href" else "link"
        mark = {"type": kind} | ({"attrs": {"href": m["href"]}} if kind == "link" else {})
        out.append({"type": "text", "text": m["link"] if kind == "link" else m[m.lastgroup], "marks": [mark]})
        at = m.end()
    if at < len(text) or not out:
        out.append({"type": "text", "text": text[at:]})
    return out


def _node(kind: str, content: list | None = None, **attrs) -> dict:
    return {"type": kind} | ({"attrs": attrs} if attrs else {}) | ({} if content is None else {"content": content})


def _paragraph(text: str) -> dict:
    return _node("paragraph", _inline(text))


def _grid(lines: list[str]) -> list[dict]:
    rows = [[c.strip() for c in line[1:-1].split("|")] for line in lines]
    rows = [r for r in rows if not all(re.fullmatch("[-:]+", c) for c in r)]
    made = [_node("tableRow", [_node("tableCell" if i else "tableHeader", [_paragraph(c)]) for c in r]) for i, r in enumerate(rows)]
    return [_node("table", made, isNumberColumnEnabled=False, layout="default")] if made else []


def _items(kind: str, pattern: str, **attrs):
    return lambda lines: [_node(kind, [_node("listItem", [_paragraph(re.sub(pattern, "", x))]) for x in lines], **attrs)]


#: Runs of lines that make one block: how its first line and its further lines look, and what becomes of them.
RUNS = (
    (r"\|(.*\|)?$", r"\|(.*\|)?$", _grid),
    (r">\s", r">\s?", lambda lines: [_node("blockquote", [_paragraph(" ".join(re.sub(r"^>\s?", "", x) for x in lines))])]),
    (r"[-*]\s", r"[-*]\s", _items("bulletList", r"^[-*]\s+")),
    (r"\d+\.\s", r"\d+\.\s", _items("orderedList", r"^\d+\.\s+", order=1)),
)


def _parsed(lines: list[str]):
    i = 0
    while i < len(lines):
        line, begun = lines[i], i
        if line.startswith("```"):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].startswith("```")), len(lines))
            language = line[3:].strip()
            yield _node("codeBlock", [{"type": "text", "text": "\n".join(lines[i + 1:end])}], **({"language": language} if language else {}))
            i = end + 1
            continue
        for first, further, make in RUNS:
            if re.match(first, line):
                while i < len(lines) and re.match(further, lines[i]):
                    i += 1
                yield from make(lines[begun:i])
                break
        else:
            i += 1
            if heading := re.fullmatch(r"(#{1,6})\s+(.+)", line):
                yield _node("heading", _inline(heading[2]), level=len(heading[1]))
            elif re.fullmatch("---+", line.strip()):
                yield _node("rule")
            elif line.strip():
                yield _paragraph(line)


def from_markdown(text: str | None) -> str | None:
    """A rich-text document of a Markdown text, as JSON."""
    if text is None:
        return None
    return json.dumps({"type": "doc", "version": 1, "content": list(_parsed(text.split("\n"))) or [_paragraph("")]}, ensure_ascii=False)


def markdown_of(column: Column) -> Column:
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(to_markdown)

    return F.pandas_udf(convert, StringType())(column)


def document_of(column: Column) -> Column:
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(from_markdown)

    return F.pandas_udf(convert, StringType())(column)
