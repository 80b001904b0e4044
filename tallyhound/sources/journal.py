"""Exported journals (one JSON object a line) as a stream that resumes by the journal's own cursors.

A file is known by the cursor of its first entry, not by its name: a rotated file goes on where it was left, and one that
was cut and begun anew is a new one. An offset holds, for each known file, how many bytes of whole lines have been read and
the cursor of the last of them, which is looked at again before reading on. The driver reads only the first line and the
end of each file; tasks read the parts between. Paths are folders that all executors see, or any URI that Arrow can open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME, SCHEMA = "journal_export", "value string, cursor string"
#: Bytes that one task reads, and that are looked through from a file's end for its last whole line.
PART, TAIL = 64 << 20, 1 << 16


def cursor_of(line: bytes) -> str | None:
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return found.get("__CURSOR") if isinstance(found, dict) else None


@dataclass
class Part(InputPartition):
    path: str
    start: int  # of a line
    end: int  # of a line, or within one that is then read to its end
    first: bool  # whether a line starts at start, or the one that is under way belongs to the part before
    known: str  # cursor of the entry before start, "" for none


class Files:
    """The files of a folder by the cursor of their first entry."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def _first(self, path: str, size: int) -> bytes | None:
        with self.fs.open_input_file(path) as f:
            head, step = b"", TAIL
            while b"\n" not in head and len(head) < size:
                head += f.read(step)
        return head.partition(b"\n")[0] if b"\n" in head else None

    def _last(self, path: str, size: int) -> tuple[int, str]:
        """(end of the last whole line, its cursor)."""
        with self.fs.open_input_file(path) as f:
            step = TAIL
            while True:
                begin = max(0, size - step)
                f.seek(begin)
                tail = f.read(size - begin)
                end = tail.rfind(b"\n") + 1
                line = tail[:end].rstrip(b"\n").rpartition(b"\n")
                if begin == 0 or line[1]:
                    return begin + end, cursor_of(line[2]) or ""
                step *= 4

    def known(self) -> dict[str, tuple[str, int, str]]:
        """first cursor: (path, end, last cursor); of two files that begin alike the longer one."""
        out: dict[str, tuple[str, int, str]] = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.root)):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")) or not info.size:
                continue
            line = self._first(info.path, info.size)
            name = line is not None and cursor_of(line)
            if name:
                end, last = self._last(info.path, info.size)
                if name not in out or out[name][1] < end:
                    out[name] = (info.path, end, last)
        return out


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, part: int):
        self.path, self.part = path, part

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": {name: {"end": end, "last": last} for name, (_, end, last) in sorted(Files(self.path).known().items())}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        there, out = Files(self.path).known(), []
        for name, to in end["files"].items():
            was = start["files"].get(name, {"end": 0, "last": ""})
            if to["end"] <= was["end"]:
                continue
            if name not in there:
                raise FileNotFoundError(f"the file that begins with {name} is gone from {self.path} and has not been read to its end")
            for at in range(was["end"], to["end"], self.part):
                out.append(Part(there[name][0], at, min(at + self.part, to["end"]), at == was["end"], was["last"] if at == was["end"] else ""))
        return out

    def read(self, partition: Part) -> Iterator[tuple[str, str]]:
        files = Files(self.path).fs
        with files.open_input_file(partition.path) as f:
            if partition.known:
                back = max(0, partition.start - TAIL)
                f.seek(back)
                before = f.read(partition.start - back).rstrip(b"\n").rpartition(b"\n")[2]
                if back == 0 or b"\n" in before or cursor_of(before):
                    if cursor_of(before) != partition.known:
                        raise ValueError(f"{partition.path} no longer has {partition.known} before byte {partition.start}")
            at, rest = partition.start, b""
            skip = not partition.first
            if skip:  # the byte before tells whether a line starts here
                f.seek(at - 1)
                skip = f.read(1) != b"\n"
            f.seek(at)
            while at < partition.end:
                block = f.read(min(1 << 20, partition.end - at) if rest or at < partition.end else 1 << 16)
                if not block:
                    break
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif line.strip():
                        yield line.decode("utf-8", "replace"), cursor_of(line) or ""
            while rest and not skip:  # a line that began here
                block = f.read(1 << 16)
                line, cut, _ = block.partition(b"\n")
                rest += line
                if cut or not block:
                    if rest.strip():
                        yield rest.decode("utf-8", "replace"), cursor_of(rest) or ""
                    break

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Journal(DataSource):
    """spark.dataSource.register(Journal); spark.readStream.format("journal_export").option("path", FOLDER).load(): value and cursor of each entry."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # noqa: ANN001, N802
        return Reader(self.options["path"], int(self.options.get("part", PART)))
