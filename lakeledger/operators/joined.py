"""Parquet files of many tasks joined to one: their bytes one after the other, then one footer that names all their row groups.

Nothing is decoded.  On a disk that the executors share every part is copied by a task of its own, to its own place in
the file; elsewhere, where a file can't be written in several places, the driver streams the parts.
"""
from __future__ import annotations

import shutil
import struct

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..sources.storage import Location

#: parts begin at multiples of this, so that no two tasks write to one page of a shared disk
PAGE = 4096
#: bytes copied at once
CHUNK = 4 << 20
_MAGIC = b"PAR1"

# -- Thrift's compact protocol, in which footers are written: a struct is {field id: (type, value)}

_TRUE, _FALSE, _BYTE, _I16, _I32, _I64, _DOUBLE, _BINARY, _LIST, _SET, _MAP, _STRUCT = range(1, 13)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    def integer(self) -> int:
        return (n := self.varint()) >> 1 ^ -(n & 1)

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n:self.at]

    def value(self, kind: int, inside: bool = False):
        """``inside``: of a list, where a boolean has a byte of its own."""
        if kind in (_TRUE, _FALSE):
            return self.byte() if inside else kind
        if kind == _BYTE:
            return self.byte()
        if kind in (_I16, _I32, _I64):
            return self.integer()
        if kind == _DOUBLE:
            return self.raw(8)
        if kind == _BINARY:
            return self.raw(self.varint())
        if kind in (_LIST, _SET):
            of, n = (b := self.byte()) & 15, b >> 4
            return of, [self.value(of, True) for _ in range(self.varint() if n == 15 else n)]
        if kind == _STRUCT:
            return self.struct()
        raise ValueError(f"type {kind} in a footer")

    def struct(self) -> dict:
        out, field = {}, 0
        while b := self.byte():
            field = field + (b >> 4) if b >> 4 else self.integer()
            out[field] = (b & 15, self.value(b & 15))
        return out


def _integer(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _encoded(kind: int, value, inside: bool = False) -> bytes:
    if kind in (_TRUE, _FALSE):
        return bytes([value]) if inside else b""
    if kind == _BYTE:
        return bytes([value])
    if kind in (_I16, _I32, _I64):
        return _integer(value)
    if kind == _DOUBLE:
        return value
    if kind == _BINARY:
        return _varint(len(value)) + value
    if kind in (_LIST, _SET):
        of, items = value
        n = len(items)
        return (bytes([n << 4 | of]) if n < 15 else bytes([0xF0 | of]) + _varint(n)) + b"".join(_encoded(of, x, True) for x in items)
    out, last = bytearray(), 0
    for field, (of, x) in sorted(value.items()):
        step = field - last
        out += (bytes([step << 4 | of]) if 0 < step < 16 else bytes([of]) + _integer(field)) + _encoded(of, x)
        last = field
    return bytes(out + b"\0")


# -- footers; the numbers are field ids of parquet.thrift

_ROWS, _GROUPS = 3, 4


def _later(fields: dict, shift: int, *ids: int) -> None:
    """Moves the offsets among ``fields``; 0 stands for none."""
    for i in ids:
        if i in fields and fields[i][1] > 0:
            fields[i] = (fields[i][0], fields[i][1] + shift)


def _moved(f, group: dict, shift: int) -> list[bytes]:
    """Turns a row group into what it is ``shift`` bytes further on; returns its columns' offset indexes, which hold places too."""
    _later(group, shift, 5)
    group.pop(7, None)  # its number in its own file
    indexes = []
    for column in group[1][1][1]:
        if 1 in column or 8 in column:
            raise ValueError("columns in other files, or encrypted ones, can't be joined")
        index = b""
        if 4 in column:
            f.seek(column[4][1])
            pages = _Reader(f.read(column[5][1])).struct()
            for page in pages[1][1][1]:
                _later(page, shift, 1)
            index = _encoded(_STRUCT, pages)
        indexes.append(index)
        _later(column, shift, 2, 6)
        _later(column[3][1], shift, 9, 10, 11, 14)
    return indexes


def _footer(f, size: int) -> dict:
    f.seek(size - 8)
    length, magic = struct.unpack("<I4s", f.read(8))
    if magic != _MAGIC:
        raise ValueError("no plain Parquet file")
    f.seek(size - 8 - length)
    return _Reader(f.read(length)).struct()


def _described(f, size: int, shift: int) -> tuple[dict, list[list[bytes]]]:
    """A part's footer as it is ``shift`` bytes further on, and the offset indexes of its row groups."""
    footer = _footer(f, size)
    return footer, [_moved(f, g, shift) for g in footer[_GROUPS][1][1]]


def _closing(parts: list[tuple[dict, list[list[bytes]]]], at: int) -> bytes:
    """The joined file from ``at`` on: offset indexes, footer and end."""
    rest = lambda footer: {k: v for k, v in footer.items() if k not in (_ROWS, _GROUPS)}
    if any(rest(footer) != rest(parts[0][0]) for footer, _ in parts):
        raise ValueError("files of different schemas can't be joined")
    out, groups = bytearray(), []
    for footer, indexes in parts:
        for group, own in zip(footer[_GROUPS][1][1], indexes):
            for column, index in zip(group[1][1][1], own):
                if index:
                    column |= {4: (_I64, at + len(out)), 5: (_I32, len(index))}
                    out += index
            groups.append(group)
    footer = rest(parts[0][0]) | {_ROWS: (_I64, sum(footer[_ROWS][1] for footer, _ in parts)), _GROUPS: (_LIST, (_STRUCT, groups))}
    footer = _encoded(_STRUCT, footer)
    return bytes(out + footer + struct.pack("<I", len(footer)) + _MAGIC)


def _put(part: tuple[str, int, int], to: str) -> tuple[dict, list[list[bytes]]]:
    """Copies a part to its place; done twice, it writes the same bytes once more."""
    path, size, at = part
    with open(path, "rb") as f, open(to, "r+b") as out:
        out.seek(at)
        shutil.copyfileobj(f, out, CHUNK)
        return _described(f, size, at)


def _streamed(spark: SparkSession, files: list[tuple[str, int, int]], to: Location) -> None:
    jvm, described, at = spark._jvm, [], 0
    out = to._fs().create(to._path(), False)
    try:
        for url, size, _ in files:
            source = to._fs().open(to._path(url))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, CHUNK, False)
            finally:
                source.close()
            fs, path = pafs.FileSystem.from_uri(url)
            with fs.open_input_file(path) as f:
                described.append(_described(f, size, at))
            at += size
        out.write(bytearray(_closing(described, at)))
    finally:
        out.close()


def join_files(spark: SparkSession, files: list[tuple[str, int, int]], to: Location) -> None:
    """Writes the rows of ``files``, (url, size, modified) each, to the new file ``to``, in this order."""
    if not to.local:
        return _streamed(spark, files, to)
    parts, at = [], 0
    for url, size, _ in files:
        parts.append((url[5:], size, at))
        at += -(-size // PAGE) * PAGE
    target = to.local
    open(target, "xb").close()
    described = spark.sparkContext.parallelize(parts, len(parts)).map(lambda p: _put(p, target)).collect()
    with open(target, "r+b") as out:
        out.seek(at)
        out.write(_closing(described, at))
