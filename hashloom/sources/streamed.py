"""Data sources in Python for files of any size: digests of instance files, lines of tool output.

Tasks open the files themselves and hold one block of a file at a time.  Paths must carry the scheme of a
store that all machines reach (``session.qualified`` adds it); pyarrow opens them.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hashloom.functions.tokens import TokenDigest

#: Bytes of one block, of one task, and of one split of a file of lines.
BLOCK, TASK, SPLIT = 8 << 20, 128 << 20, 64 << 20
#: Lines, or digests, of one Arrow batch.
BATCH = 4_096

_OPENERS = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open, ".lzma": lzma.open}

# The line ends of a tool's output, as bytes of UTF-8.
_LINE_END = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
_LONGEST_END = 3


def store(path: str):
    """The file system of a path and the path in it; one without scheme is a path of this machine."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (fs.LocalFileSystem(), path)


def shown(path: str, root: str) -> str:
    """A path of a listing as Spark's sources show it: with the scheme of the root, local ones without."""
    found = re.match(r"(\w+://[^/]*)", root)
    return f"{found[1]}/{path.lstrip('/')}" if found and not root.startswith("file:") else path


def listed(root: str, suffixes: list[str]) -> list[tuple[str, int]]:
    """Paths and sizes of the files below a folder, or of one file, without hidden ones."""
    from pyarrow import fs

    system, inside = store(root)
    info = system.get_file_info(inside)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    below = [f for f in files if f.type == fs.FileType.File]
    hidden = [f for f in below if any(part[:1] in "._" for part in f.path[len(inside) :].split("/") if part)]
    kept = [f for f in below if f not in hidden and f.path.endswith(tuple(suffixes))]
    return sorted((f.path, f.size) for f in kept)


def blocks(system, path: str, size: int = BLOCK) -> Iterator[bytes]:
    """The content of a file, unpacked by its suffix, in blocks of at most ``size`` bytes."""
    opener = _OPENERS.get("." + path.rsplit(".", 1)[-1])
    with system.open_input_file(path) as raw:
        with opener(raw) if opener else raw as source:
            while block := source.read(size):
                yield block


@dataclass
class Files(InputPartition):
    """The files of one task."""

    paths: list


@dataclass
class Split(InputPartition):
    """The lines of a file that start in [start, end)."""

    path: str
    start: int
    end: int


class InstanceDigests(DataSource):
    """``instance_digests``: one row per file below ``path`` with one of the ``suffixes`` (comma-separated).

    ``bytes`` counts the unpacked content, ``hash``, ``clauses`` and ``variables`` are those of its canonical tokens.  A
    file that can't be read has these null and its ``error``; it doesn't end the scan.
    """

    @classmethod
    def name(cls) -> str:
        return "instance_digests"

    def schema(self) -> str:
        return "path string, length long, bytes long, hash string, clauses long, variables long, error string"

    def reader(self, schema) -> DataSourceReader:
        return InstanceReader(self.options)


class InstanceReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.suffixes = options["path"], options.get("suffixes", "").split(",")
        self.block, self.task = int(options.get("block", BLOCK)), int(options.get("task", TASK))

    def partitions(self) -> list[Files]:
        """Files in the order of their names, gathered to tasks of about ``task`` bytes."""
        tasks: list[Files] = []
        held = 0
        for path, size in listed(self.root, self.suffixes):
            if not tasks or held + size > self.task:
                tasks.append(Files([]))
                held = 0
            tasks[-1].paths.append((path, size))
            held += size
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = store(self.root)
        for path, size in partition.paths:
            digest = TokenDigest()
            try:
                for block in blocks(system, path, self.block):
                    digest.update(block)
                found = (digest.bytes, digest.finish(), digest.clauses, digest.variables, None)
            except (OSError, EOFError, lzma.LZMAError, ValueError) as error:
                found = (None, None, None, None, f"{type(error).__name__}: {error}"[:500])
            yield (shown(path, self.root), size, *found)


class ToolLines(DataSource):
    """``tool_lines``: the lines of the files below ``path`` with the byte at which each starts.

    A file is read in splits of ``split`` bytes by different tasks.  A split has the lines that start in it, read to their
    ends; which these are depends on the bytes of the file only, so any number of splits gives the same
    rows.  A line is one value.  Bytes that are no UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "tool_lines"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.suffixes = options["path"], options.get("suffixes", "").split(",")
        self.block, self.split = int(options.get("block", BLOCK)), int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        found = [
            Split(path, start, min(start + self.split, size))
            for path, size in listed(self.root, self.suffixes)
            for start in range(0, size, self.split)
        ]
        return found or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.end == partition.start:
            return
        system, _ = store(self.root)
        path, offsets, lines, held = shown(partition.path, self.root), [], [], 0
        with system.open_input_file(partition.path) as source:
            for offset, line in lines_from(source, partition.start, partition.end, self.block):
                offsets.append(offset)
                lines.append(line.decode("utf-8", "replace"))
                held += len(line)
                if len(lines) >= BATCH or held >= self.block:
                    yield _line_batch(path, offsets, lines)
                    offsets, lines, held = [], [], 0
        if lines:
            yield _line_batch(path, offsets, lines)


def _line_batch(path: str, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
    arrays = [pa.array([path] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "offset", "line"])


def lines_from(source, start: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """The lines of an open file that start in [start, end), with their offsets, without line ends.

    Reading begins a line end before the start, so a line end across it is seen whole; bytes of line ends
    never occur inside another character of UTF-8.
    """
    at = max(0, start - _LONGEST_END)  # of the first byte of ``held``
    source.seek(at)
    held, line = b"", 0 if start == 0 else None  # the offset of the line being read, None before the first
    searched = 0  # bytes of ``held`` known to hold no line end
    while True:
        more = source.read(block)
        held += more
        position = 0
        for found in _LINE_END.finditer(held, searched):
            if more and found[0] == b"\r" and found.end() == len(held):
                break  # a line feed may follow
            if line is not None and line >= start:
                yield line, held[line - at : found.start()]
            line, position = at + found.end(), found.end()
            if line >= end:
                return
        if not more:
            if line is not None and start <= line < at + len(held):
                yield line, held[line - at :]
            return
        cut = position if line is not None and line == at + position else 0
        if line is None:
            cut = max(0, len(held) - _LONGEST_END)
        held, at = held[cut:], at + cut
        searched = max(0, len(held) - _LONGEST_END + 1)
