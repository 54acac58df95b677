"""Parts of large files as Spark partitions: paragraphs or lines of texts, and rows of arrays, by byte ranges.

A paragraph or line belongs to the range that its first byte lies in, whose task reads on to its end; so each is read once and
whole, wherever ranges end, and a task holds a range and the paragraph it ends in.  The text reader of Spark itself gives paragraphs twice now
and then where a range ends between two line ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of a read.
RANGE, BLOCK = 64_000_000, 1_000_000
_WHITE = b" \t\n\x0b\x0c\r"
_BETWEEN = re.compile(rb"\n[ \t\n\x0b\x0c\r]*\n")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str = "") -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a path, in their order: itself, or those below it that are no marks or drafts."""
    files, base = opened(path)
    info = files.get_file_info(base)
    if info.type == fs.FileType.File:
        return files, [info]
    below = files.get_file_info(fs.FileSelector(base, recursive=True))
    return files, sorted((f for f in below if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(ending)), key=lambda f: f.path)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, offset: int = 0) -> None:
        self.path, self.start, self.end, self.offset = path, start, end, offset


def _first_paragraph(file: pa.NativeFile, at: int) -> int:
    """Where the first paragraph starts that does not start before at: behind the white space with two line ends that holds at or comes next."""
    size, low = file.size(), at
    while low:  # back over the white space before at
        step = min(BLOCK, low)
        file.seek(low - step)
        block = file.read(step)
        kept = len(block.rstrip(_WHITE))
        low -= step - kept
        if kept:
            break
    file.seek(low)
    held = b""
    while low + len(held) < size:
        held += file.read(BLOCK)
        for m in _BETWEEN.finditer(held):
            end = m.end() + len(held[m.end() :]) - len(held[m.end() :].lstrip(_WHITE)) if m.end() < len(held) else m.end()
            if low + end >= at and (end < len(held) or low + len(held) >= size):
                return low + end
        if len(held) > 64 * BLOCK:  # one paragraph: only its end matters
            low, held = low + len(held) - BLOCK, held[-BLOCK:]
    return size


def paragraphs(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of the paragraphs that start in the range."""
    size = file.size()
    at = _first_paragraph(file, start) if start else 0
    file.seek(at)
    held = b""
    while at < min(end, size):
        more = file.read(BLOCK)
        held += more
        last = 0
        for m in _BETWEEN.finditer(held):
            stop = len(held) - len(held[m.end() :].lstrip(_WHITE))
            if stop == len(held) and more:
                break  # the white space may go on
            if at + last >= end:
                return
            if m.start() > last:
                yield at + last, held[last : m.start()]
            last = max(m.end(), stop)
        at, held = at + last, held[last:]
        if not more:
            if held.strip(_WHITE) and at < end:
                yield at, held
            return


def lines(file: pa.NativeFile, start: int, end: int) -> tuple[int, bytes]:
    """Start and bytes of the whole lines that start in the range."""
    size = file.size()

    def behind(at: int) -> int:
        """The first line's start that is at or behind at."""
        if not at or at >= size:
            return min(at, size)
        file.seek(at - 1)
        at -= 1
        while block := file.read(BLOCK):
            if (found := block.find(b"\n")) >= 0:
                return at + found + 1
            at += len(block)
        return size

    first, last = behind(start), behind(end)
    file.seek(first)
    return first, file.read(last - first)


class _TextReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._path, self._unit, self._size = options["path"], options.get("unit", "paragraphs"), int(options.get("bytes", RANGE))

    def partitions(self) -> list[Range]:
        _, found = listed(self._path)
        return [Range(f.path, at, min(at + self._size, f.size)) for f in found for at in range(0, f.size, self._size)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        files, _ = opened(self._path)
        with files.open_input_file(part.path) as file:
            found = paragraphs(file, part.start, part.end) if self._unit == "paragraphs" else [lines(file, part.start, part.end)]
            out, held = [], 0
            for at, text in found:
                if text:
                    out.append((at, text.decode("utf-8", "replace")))
                    held += len(text)
                if held >= BLOCK:
                    yield _batch(part.path, out)
                    out, held = [], 0
            if out:
                yield _batch(part.path, out)


def _batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["path", "start", "text"])


class TextRanges(DataSource):
    """path, start, text. Options: path; unit, paragraphs or lines (all whole lines of a range as one text); bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return "path string, start long, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return _TextReader(dict(self.options))


def _header(file: pa.NativeFile) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, kind and offset of an array file's values."""
    version = np.lib.format.read_magic(file)
    shape, columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return shape, columns, kind, file.tell()


class _ArrayReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._path, self._size = options["path"], int(options.get("bytes", RANGE))

    def partitions(self) -> list[Range]:
        files, found = listed(self._path, ".npy")
        out = []
        for f in found:
            with files.open_input_file(f.path) as file:
                shape, columns, kind, offset = _header(file)
            rows = shape[0] if len(shape) > 1 else 1
            width = max(1, int(np.prod(shape[1:] if len(shape) > 1 else shape)) * kind.itemsize)
            step = rows if columns else max(1, self._size // width)  # columns first: a row lies all over the file
            out += [Range(f.path, at, min(at + step, rows), offset) for at in range(0, rows, max(step, 1))]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        files, _ = opened(self._path)
        with files.open_input_file(part.path) as file:
            shape, columns, kind, offset = _header(file)
            if len(shape) < 2:
                shape = (1, int(np.prod(shape)))
            width = int(np.prod(shape[1:]))
            if columns:
                whole = np.frombuffer(file.read(), kind).reshape(shape, order="F").reshape(shape[0], width)
            step = max(1, BLOCK // max(1, width * kind.itemsize))
            for at in range(part.start, part.end, step):
                n = min(step, part.end - at)
                if columns:
                    values = whole[at : at + n]
                else:
                    file.seek(offset + at * width * kind.itemsize)
                    values = np.frombuffer(file.read(n * width * kind.itemsize), kind).reshape(n, width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width) if width else np.zeros(n + 1), pa.int32()), pa.array(values.astype(np.float64).ravel()))
                yield pa.record_batch([pa.array([part.path] * n, pa.string()), pa.array(np.arange(at, at + n)), lists], names=["path", "row", "vector"])


class ArrayRanges(DataSource):
    """path, row, vector of the rows of .npy files. Options: path; bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "array_ranges"

    def schema(self) -> str:
        return "path string, row long, vector array<double>"

    def reader(self, schema: object) -> DataSourceReader:
        return _ArrayReader(dict(self.options))


def read(spark: SparkSession, source: type[DataSource], path: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=path, **options).load()
