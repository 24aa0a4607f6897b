"""Data source ``zip_lines``: the lines of archive members, numbered.

Options: ``path`` (an archive, or a folder of archives), ``members`` (names separated by ``|``; each may
list alternatives separated by ``;``, the first present wins, by exact name, else by base name without
case), ``quarter``-like constants are added by the caller. Columns: archive, member, line_no, line.

One partition per (archive, member), since a deflated member cannot be split; only the wanted members
are read. Lines end at ``\\n``; one ``\\r`` before it is dropped, a byte-order mark is dropped from the first
line, bytes that are no UTF-8 become the replacement character, and a last line without an end counts.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
BATCH = 8192


class Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


def find_member(names: list[str], wanted: str) -> str | None:
    """The first alternative that is there: by exact name, else by base name without case."""
    options = wanted.split(";")
    for option in options:
        if option in names:
            return option
    by_base = {os.path.basename(n).lower(): n for n in names if not n.endswith("/")}
    return next((by_base[b] for o in options if (b := os.path.basename(o).lower()) in by_base), None)


def member_lines(archive: str, member: str) -> Iterator[tuple[int, str]]:
    """(line_no, line) of a member, held in memory a chunk at a time; a line longer than a chunk is put together once."""
    with zipfile.ZipFile(archive) as z:
        if z.getinfo(member).compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{member} in {archive} is neither stored nor deflated")
        with z.open(member) as stream:
            number, rest = 0, []
            while chunk := stream.read(CHUNK):
                first, *more = chunk.split(b"\n")
                rest.append(first)
                if more:
                    *whole, last = [b"".join(rest), *more]
                    for raw in whole:
                        number += 1
                        yield number, _text(raw, number)
                    rest = [last] if last else []
            if tail := b"".join(rest):
                yield number + 1, _text(tail, number + 1)


def _text(raw: bytes, number: int) -> str:
    if number == 1 and raw.startswith(b"\xef\xbb\xbf"):
        raw = raw[3:]
    return raw.removesuffix(b"\r").decode("utf-8", "replace")


class ZipLinesReader(DataSourceReader):
    def __init__(self, path: str, members: list[str]):
        self.path, self.members = path, members

    def archives(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.lower().endswith(".zip"))
        return [self.path]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for archive in self.archives():
            with zipfile.ZipFile(archive) as z:
                names = z.namelist()
            wanted = [find_member(names, w) for w in self.members] if self.members else [n for n in names if not n.endswith("/")]
            out += [Member(archive, m) for m in wanted if m]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        lines = member_lines(partition.archive, partition.member)
        while batch := list(islice(lines, BATCH)):
            numbers, texts = zip(*batch)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([partition.archive] * n), pa.array([partition.member] * n), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["archive", "member", "line_no", "line"])


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "archive string, member string, line_no bigint, line string"

    def reader(self, schema) -> ZipLinesReader:
        members = self.options.get("members", "")
        return ZipLinesReader(self.options["path"], [m for m in members.split("|") if m])
