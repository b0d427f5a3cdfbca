"""Dumps that grow at their ends, as a streaming and a batch source.

    spark.dataSource.register(appended.AppendedRecords)
    spark.readStream.format("appended_records").option("path", folder).option("separator", "\\x1e").option("begins", "true").load()

A row is a record (value) with its file. The offset is the number of bytes taken of each file, so a stream
goes on where its checkpoint ended and never reads a byte range twice. A batch's new bytes are split
into parts of bounded size; a record belongs to the part that its first byte lies in, and is read to its end by that task.

Records end with the separator, or begin with it. Of those that end with it an unfinished last one waits; those
that begin with it are taken to the end of the file, so writers append them whole. Files must be readable on all
executors, by any address that Arrow's file systems know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 32 << 20
WINDOW = 1 << 20


@dataclass
class Part(InputPartition):
    """Bytes from start to stop of a file; records that begin there may run on to end. first: whether a record begins at start."""

    file: str
    start: int
    stop: int
    end: int
    first: bool


def _system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Reader:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.mark = options.get("separator", "\n").encode()
        self.begins = str(options.get("begins", "false")).lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        if len(self.mark) != 1:
            raise ValueError("the separator is one byte")

    def sizes(self, since: dict) -> dict[str, int]:
        """Bytes of whole records by file."""
        from pyarrow import fs

        system, path = _system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        out = {}
        for f in found:
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                before = since.get(f.path, 0)
                out[f.path] = max(before, f.size if self.begins else self._last_end(system, f.path, before, f.size))
        return out

    def _last_end(self, system, path: str, low: int, high: int) -> int:
        """The place behind the last separator between low and high."""
        with system.open_input_file(path) as file:
            while high > low:
                start = max(low, high - WINDOW)
                file.seek(start)
                at = file.read(high - start).rfind(self.mark)
                if at >= 0:
                    return start + at + 1
                high = start
        return low

    def parts(self, start: dict, end: dict) -> list[Part]:
        return [Part(file, at, min(at + self.split, stop), stop, at == begun)
                for file, stop in sorted(end.items()) for begun in [start.get(file, 0)] for at in range(begun, stop, self.split)]

    def records(self, part: Part) -> Iterator[tuple[str, str]]:
        system, _ = _system(self.path)
        with system.open_input_file(part.file) as file:
            # from one byte before, as a separator there means that a record begins here
            at = part.start if part.first or self.begins else part.start - 1
            file.seek(at)
            held, here, inside = b"", at, part.first and not self.begins
            begun = at  # where the record in held begins
            while True:
                window = file.read(min(WINDOW, part.end - here))
                if not window:
                    break
                here += len(window)
                pieces = (held + window).split(self.mark)
                for piece in pieces[:-1]:
                    if inside:
                        yield piece.decode("utf-8", "replace"), part.file
                    # the next record's first byte: its separator, or what follows it
                    begun += len(piece) + 1
                    if (begun - 1 if self.begins else begun) >= part.stop:
                        return
                    inside = True
                held = pieces[-1]
            if inside and self.begins:
                yield held.decode("utf-8", "replace"), part.file


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.reader = Reader(options)
        self.seen: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = self.reader.sizes(self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.reader.parts(start, end)

    def read(self, partition: Part) -> Iterator[tuple[str, str]]:
        return self.reader.records(partition)


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.reader = Reader(options)

    def partitions(self) -> list[Part]:
        return self.reader.parts({}, self.reader.sizes({}))

    def read(self, partition: Part) -> Iterator[tuple[str, str]]:
        return self.reader.records(partition)


class AppendedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_records"

    def schema(self) -> str:
        return "value string, file string"

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
