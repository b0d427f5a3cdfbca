"""A sink for the front matter of Markdown files: one file a row, its body's bytes kept.

    spark.dataSource.register(front_matter.FrontMatter)
    updates.write.format("front_matter").option("path", folder).mode("append").save()

Rows have md_path, below the folder, and a column for each key. A null leaves its key as it is; other values
replace it where it stands or follow the others. Files are written to a hidden folder of the job and moved to their
places when all tasks have ended well, so a failed job changes none; that folder goes in either case.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FRONT = re.compile(rb"\A---[ \t]*\r?\n(.*?\r?\n)??---[ \t]*(?:\r?\n|\Z)", re.S)
KEY = re.compile(r"([\w-]+):")


def rewritten(content: bytes, updates: dict[str, str]) -> bytes:
    """A file with some keys set."""
    found = FRONT.match(content)
    lines = (found[1] or b"").decode().splitlines() if found else []
    left = {k: re.sub(r"[\r\n]+", " ", v) for k, v in updates.items() if v is not None}
    out = []
    for line in lines:
        key = KEY.match(line)
        out.append(f"{key[1]}: {left.pop(key[1])}" if key and key[1] in left else line)
    out += [f"{k}: {v}" for k, v in left.items()]
    body = content[found.end():] if found else content
    return "".join(f"{line}\n" for line in ("---", *out, "---")).encode() + body


@dataclass
class Written(WriterCommitMessage):
    """Pairs of a written file and its place."""

    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file:")
        self.staging = os.path.join(self.folder, f".staging-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Written:
        files: list[tuple[str, str]] = []
        os.makedirs(self.staging, exist_ok=True)
        for row in rows:
            values = row.asDict()
            name = os.path.normpath(values.pop("md_path"))
            if name.startswith(("..", "/")):
                raise ValueError(f"{name} is outside the folder")
            path, old = os.path.join(self.folder, name), b""
            if os.path.exists(path):
                with open(path, "rb") as f:
                    old = f.read()
            staged = os.path.join(self.staging, uuid.uuid4().hex)
            with open(staged, "wb") as f:
                f.write(rewritten(old, {k: None if v is None else str(v) for k, v in values.items()}))
            files.append((staged, path))
        return Written(files)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if len({place for _, place in files}) < len(files):
            raise ValueError("two rows name one file")
        for staged, place in files:
            os.makedirs(os.path.dirname(place), exist_ok=True)
            os.replace(staged, place)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FrontMatter(DataSource):
    @classmethod
    def name(cls) -> str:
        return "front_matter"

    def writer(self, schema, overwrite: bool) -> Writer:
        if "md_path" not in schema.names:
            raise ValueError("rows need md_path")
        return Writer(self.options["path"])
