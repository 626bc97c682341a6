"""Logical records of a malformed CSV export, read by byte range.

A record begins at a line that opens with a quoted six-digit number; whatever follows up to the next
such line belongs to it. As that mark can be recognised at any line, a file is cut anywhere: a split
owns the records whose first line starts inside it and reads past its end to finish the last one.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.parse_lines import N_FIELDS

# The mark of a record's first line, and positions in it.
RECORD_START = re.compile(r'\s*"?=?"{1,4}[0-9]{6}"{1,4}\s*,')
PREFIX_FIELDS, ABSTRACT, CLAIM = 27, 28, 29
MODES = ("prefix", "full", "buffered", "joined")
SCHEMA = "file string, byte_offset bigint, fields array<string>"
_BLOCK = 1 << 20

csv.field_size_limit(sys.maxsize)


def parse_csv(lines: list[str]) -> tuple[list[str], int]:
    """The first CSV record of ``lines`` and how many of them it took; a plain split if it is unreadable."""
    reader = csv.reader(iter(lines), strict=False)
    try:
        return next(reader, []), reader.line_num
    except csv.Error:
        return "".join(lines).split(","), len(lines)


def _padded(row: list[str]) -> list[str]:
    return row + [""] * (N_FIELDS - len(row))


def _first_reaching(lines: list[str], wanted: int) -> tuple[list[str] | None, int]:
    """The shortest run of lines whose record has ``wanted`` fields, and its length; None if there is none.

    More lines change the record only while a quote is open and only if they hold a quote.
    """
    try:
        row = next(csv.reader([lines[0].rstrip("\r\n")], strict=False), [])
    except csv.Error:
        row = []
    if len(row) >= wanted:
        return row, 1
    for k in range(2, len(lines) + 1):
        if '"' not in lines[k - 1]:
            continue
        row, used = parse_csv(lines[:k])
        if len(row) >= wanted:
            return row, k
        if used < k:
            return None, k
    return None, len(lines)


def read_group(lines: list[str], mode: str) -> list[str]:
    """The fields of one record given its physical lines, endings kept.

    prefix: as soon as 27 fields parse, later lines are dropped; padded to 31; unpadded if never
    reached. full: 31 fields are needed, further lines go to the abstract, or to the claim if there is
    no abstract. buffered: one parse of all lines, padded. joined: lines joined without their breaks,
    one parse, not padded.
    """
    if mode == "buffered":
        return _padded(parse_csv(lines)[0])
    if mode == "joined":
        return parse_csv(["".join(line.rstrip("\r\n") for line in lines)])[0]
    row, used = _first_reaching(lines, PREFIX_FIELDS if mode == "prefix" else N_FIELDS)
    if row is None:
        row = parse_csv(lines)[0]
        return row if mode == "prefix" else _padded(row)
    row = _padded(row)
    if mode == "full":
        for line in lines[used:]:
            at = ABSTRACT if row[ABSTRACT].strip() else CLAIM
            row[at] = f"{row[at]}\n{line.rstrip(chr(13) + chr(10))}".strip()
    return row


def physical_lines(handle, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Lines from the first one starting at or after ``start``: offset and bytes with ending (\\n, \\r\\n or \\r)."""
    at = max(0, start - 1)
    handle.seek(at)
    pending = b""
    skip = start > 0
    ended = False
    while not ended or pending:
        block = b"" if ended else handle.read(_BLOCK)
        ended = ended or not block
        pending += block
        cut = 0
        for m in re.finditer(rb"\r\n|\n|\r", pending):
            if m.end() == len(pending) and m.group() == b"\r" and not ended:
                break
            if not (skip and cut == 0):
                yield at + cut, pending[cut : m.end()]
            skip = False
            cut = m.end()
        at += cut
        pending = pending[cut:]
        if ended:
            if pending and not skip:
                yield at, pending
            return


def records_of(handle, start: int, end: int, size: int, mode: str) -> Iterator[tuple[int, list[str]]]:
    """Records whose first line starts in [start, end)."""
    group: list[str] = []
    opened = 0
    for offset, raw in physical_lines(handle, start, size):
        text = raw.decode("utf-8", errors="replace")
        if offset == 0:
            text = text.removeprefix("﻿")
        if RECORD_START.match(text):
            if group:
                yield opened, read_group(group, mode)
                group = []
            if offset >= end:
                return
            group, opened = [text], offset
        elif group:
            group.append(text)
        elif offset >= end:
            return
    if group:
        yield opened, read_group(group, mode)


class _Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int) -> None:
        self.path, self.start, self.end, self.size = path, start, end, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.mode = options["path"], options.get("mode", "full")
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")

    def _open(self, path: str):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return system, inner

    def partitions(self) -> list[_Split]:
        from pyarrow import fs

        system, inner = self._open(self.path)
        info = system.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        prefix = self.path[: len(self.path) - len(inner)] if "://" in self.path else ""
        return [_Split(prefix + f.path, a, min(a + self.split, f.size), f.size) for f in files for a in range(0, f.size, self.split)] or []

    def read(self, partition: _Split) -> Iterator[tuple]:
        system, inner = self._open(partition.path)
        with system.open_input_file(inner) as handle:
            for offset, fields in records_of(handle, partition.start, partition.end, partition.size, self.mode):
                yield partition.path, offset, fields


class LogicalCsv(DataSource):
    """``spark.read.format("logical_csv").option("mode", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "logical_csv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_logical(spark: SparkSession, path: str, mode: str = "full", split_bytes: int = 64 << 20) -> DataFrame:
    """``file``, ``byte_offset`` (the record's place, hence its order) and ``fields``."""
    spark.dataSource.register(LogicalCsv)
    return spark.read.format("logical_csv").option("mode", mode).option("splitBytes", split_bytes).load(path)


# Labels by which the code columns are found in a header.
ALL_LABELS, MAIN_LABELS = ("ipc分类号", "ipc分类"), ("ipc主分类号", "ipc主分类")


def header_indices(spark: SparkSession, path: str) -> tuple[int, int]:
    """Positions of the all-codes and main-code columns by their header, else 25 and 26."""
    first = spark.read.text(path).limit(1).collect()
    names = [n.strip().lower() for n in parse_csv([first[0][0].removeprefix("﻿")])[0]] if first else []
    find = lambda labels, default: next((i for i, n in enumerate(names) if any(x in n for x in labels)), default)
    return find(ALL_LABELS, 25), find(MAIN_LABELS, 26)
