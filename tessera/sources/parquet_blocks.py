"""Joining Parquet files by copying their encoded column blocks, without decoding a page.

The body of each input is copied as it is; only the footer is written anew, with every offset moved by the distance that
its block moved. Page indexes and Bloom filters come along: column indexes hold no offsets, offset indexes are rewritten.
Footers are read and written through a small reader and writer of Thrift's compact protocol that keeps fields it does not
know. What readers go by when they take values (schema, column orders, the writer's name, and the keys of ``READER_KEYS``) has
to be equal in all inputs and so holds for every block of the output; other key-value pairs are kept if all inputs have them.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from typing import Any, BinaryIO

MAGIC = b"PAR1"
CHUNK = 8 << 20

# Types of Thrift's compact protocol.
TRUE, FALSE, I8, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)

#: A struct: [field id, type, value] in order. A list: (element type, values). A map: (key type, value type, pairs).
Struct = list[list[Any]]


class IncompatibleFiles(ValueError):
    """Files whose blocks can't stand in one file."""


def _read_varint(b: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n, at
        shift += 7


def _signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _read_value(b: memoryview, at: int, kind: int) -> tuple[Any, int]:
    if kind in (TRUE, FALSE):  # as an element of a list
        return b[at] == TRUE, at + 1
    if kind == I8:
        return b[at], at + 1
    if kind in (I16, I32, I64):
        n, at = _read_varint(b, at)
        return _signed(n), at
    if kind == DOUBLE:
        return bytes(b[at : at + 8]), at + 8
    if kind == BINARY:
        n, at = _read_varint(b, at)
        return bytes(b[at : at + n]), at + n
    if kind in (LIST, SET):
        head = b[at]
        at += 1
        n, of = head >> 4, head & 0x0F
        if n == 15:
            n, at = _read_varint(b, at)
        values = []
        for _ in range(n):
            v, at = _read_value(b, at, of)
            values.append(v)
        return (of, values), at
    if kind == MAP:
        n, at = _read_varint(b, at)
        if not n:
            return (0, 0, []), at
        kinds = b[at]
        at += 1
        pairs = []
        for _ in range(n):
            k, at = _read_value(b, at, kinds >> 4)
            v, at = _read_value(b, at, kinds & 0x0F)
            pairs.append((k, v))
        return (kinds >> 4, kinds & 0x0F, pairs), at
    if kind == STRUCT:
        return read_struct(b, at)
    raise IncompatibleFiles(f"unknown Thrift type {kind}")


def read_struct(b: memoryview, at: int = 0) -> tuple[Struct, int]:
    """A struct that begins at ``at``, and where it ends."""
    fields: Struct = []
    last = 0
    while True:
        head = b[at]
        at += 1
        if not head:
            return fields, at
        kind = head & 0x0F
        if head >> 4:
            last += head >> 4
        else:
            n, at = _read_varint(b, at)
            last = _signed(n)
        if kind in (TRUE, FALSE):
            fields.append([last, kind, kind == TRUE])
            continue
        v, at = _read_value(b, at, kind)
        fields.append([last, kind, v])


def _varint(out: bytearray, n: int) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _zigzag(out: bytearray, n: int) -> None:
    _varint(out, n << 1 if n >= 0 else (-n << 1) - 1)


def _write_value(out: bytearray, kind: int, v: Any) -> None:
    if kind in (TRUE, FALSE):
        out.append(TRUE if v else FALSE)
    elif kind == I8:
        out.append(v)
    elif kind in (I16, I32, I64):
        _zigzag(out, v)
    elif kind == DOUBLE:
        out += v
    elif kind == BINARY:
        _varint(out, len(v))
        out += v
    elif kind in (LIST, SET):
        of, values = v
        if len(values) < 15:
            out.append(len(values) << 4 | of)
        else:
            out.append(0xF0 | of)
            _varint(out, len(values))
        for x in values:
            _write_value(out, of, x)
    elif kind == MAP:
        key, value, pairs = v
        _varint(out, len(pairs))
        if pairs:
            out.append(key << 4 | value)
            for k, x in pairs:
                _write_value(out, key, k)
                _write_value(out, value, x)
    else:
        write_struct(out, v)


def write_struct(out: bytearray, fields: Struct) -> None:
    """Append a struct."""
    last = 0
    for n, kind, v in fields:
        code = (TRUE if v else FALSE) if kind in (TRUE, FALSE) else kind
        if 0 < n - last < 16:
            out.append((n - last) << 4 | code)
        else:
            out.append(code)
            _zigzag(out, n)
        last = n
        if kind not in (TRUE, FALSE):
            _write_value(out, kind, v)
    out.append(0)


def field(s: Struct, n: int) -> Any:
    """The value of a field, or None."""
    return next((f[2] for f in s if f[0] == n), None)


def put(s: Struct, n: int, kind: int, v: Any) -> None:
    """Set a field; None removes it."""
    for f in s:
        if f[0] == n:
            if v is None:
                s.remove(f)
            else:
                f[2] = v
            return
    if v is not None:
        s.append([n, kind, v])
        s.sort(key=lambda f: f[0])


# Field numbers of Parquet's footer (fixed values of the format).
META_SCHEMA, META_ROWS, META_GROUPS, META_PAIRS, META_WRITER, META_ORDERS, META_ENCRYPTION = 2, 3, 4, 5, 6, 7, 8
PAIR_KEY, PAIR_VALUE = 1, 2
GROUP_COLUMNS, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 3, 5, 7
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META, CHUNK_OFFSET_INDEX, CHUNK_OFFSET_INDEX_LENGTH, CHUNK_COLUMN_INDEX, CHUNK_COLUMN_INDEX_LENGTH = 1, 2, 3, 4, 5, 6, 7
COLUMN_DATA, COLUMN_INDEX_PAGE, COLUMN_DICTIONARY, COLUMN_BLOOM, COLUMN_BLOOM_LENGTH = 9, 10, 11, 14, 15
COLUMN_SIZE = 7


def read_footer(f: BinaryIO, size: int) -> tuple[Struct, int]:
    """The footer of an open file of ``size`` bytes, and the offset at which it begins."""
    if size < 12:
        raise IncompatibleFiles("too short for a Parquet file")
    f.seek(size - 8)
    tail = f.read(8)
    if tail[4:] != MAGIC:
        raise IncompatibleFiles("no Parquet footer (or an encrypted one)")
    (length,) = struct.unpack("<I", tail[:4])
    f.seek(size - 8 - length)
    meta, _ = read_struct(memoryview(f.read(length)))
    if field(meta, META_ENCRYPTION) is not None:
        raise IncompatibleFiles("encrypted columns")
    return meta, size - 8 - length


#: Beginnings of the keys by which readers decide how values are to be taken (calendar of old dates and of INT96, time zone, types
#: that the schema can't state). Fixed values of the writers.
READER_KEYS = (b"org.apache.spark.", b"ARROW:", b"parquet.", b"writer.", b"iceberg.")


def _pairs(meta: Struct) -> list[tuple[bytes, bytes | None]]:
    """Key-value pairs of a footer, by key."""
    got = field(meta, META_PAIRS)
    return sorted(((field(p, PAIR_KEY), field(p, PAIR_VALUE)) for p in got[1]), key=lambda p: (p[0], p[1] or b"")) if got else []


def signature(meta: Struct) -> bytes:
    """Files of equal signature (schema, column orders, writer, keys that readers go by) may be joined."""
    out = bytearray()
    write_struct(out, [f for f in meta if f[0] in (META_SCHEMA, META_WRITER, META_ORDERS)])
    for k, v in _pairs(meta):
        if k.startswith(READER_KEYS):
            out += struct.pack("<IB", len(k), v is not None) + k + struct.pack("<I", len(v or b"")) + (v or b"")
    return bytes(out)


def _copy(src: BinaryIO, start: int, end: int, dst: BinaryIO) -> None:
    src.seek(start)
    left = end - start
    while left:
        x = src.read(min(CHUNK, left))
        if not x:
            raise IncompatibleFiles("a file ends before its footer says so")
        dst.write(x)
        left -= len(x)


class Joiner:
    """Writes one output out of several inputs of one signature, one after the other."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.at = out, 4
        self.meta: Struct | None = None
        self.sig = b""
        self.pairs: set[tuple[bytes, bytes | None]] = set()
        self.groups: list[Struct] = []
        self.indexes: list[tuple[Struct, bytes | None, Struct | None]] = []
        self.rows = self.files = 0
        out.write(MAGIC)

    def add(self, src: BinaryIO, size: int) -> None:
        """Copy one file's blocks. Raises IncompatibleFiles before anything is written if they don't fit."""
        meta, end = read_footer(src, size)
        sig = signature(meta)
        if self.meta is None:
            self.meta, self.sig, self.pairs = meta, sig, set(_pairs(meta))
        elif sig != self.sig:
            raise IncompatibleFiles("another schema, writer or way of taking values")
        else:
            self.pairs &= set(_pairs(meta))
        groups = field(meta, META_GROUPS)[1]
        if sum(field(g, GROUP_ROWS) for g in groups) != field(meta, META_ROWS):
            raise IncompatibleFiles("row groups don't add up to the file's rows")
        chunks = [c for g in groups for c in field(g, GROUP_COLUMNS)[1]]
        stop = 4
        for c in chunks:
            m = field(c, CHUNK_META)
            if m is None or field(c, CHUNK_PATH) is not None:
                raise IncompatibleFiles("column blocks outside the file")
            begin = min(x for x in (field(m, COLUMN_DATA), field(m, COLUMN_DICTIONARY)) if x)
            stop = max(stop, begin + field(m, COLUMN_SIZE))
        if stop > end:
            raise IncompatibleFiles("blocks reach into the footer")
        move = self.at - 4
        _copy(src, 4, stop, self.out)
        self.at += stop - 4
        for g in groups:
            if field(g, GROUP_OFFSET) is not None:
                put(g, GROUP_OFFSET, I64, field(g, GROUP_OFFSET) + move)
            put(g, GROUP_ORDINAL, I16, None)
            for c in field(g, GROUP_COLUMNS)[1]:
                m = field(c, CHUNK_META)
                if field(c, CHUNK_OFFSET):
                    put(c, CHUNK_OFFSET, I64, field(c, CHUNK_OFFSET) + move)
                for n in (COLUMN_DATA, COLUMN_INDEX_PAGE, COLUMN_DICTIONARY):
                    if field(m, n):
                        put(m, n, I64, field(m, n) + move)
                self._bloom(src, m, stop, move)
                self._page_indexes(src, c, move)
            self.groups.append(g)
        self.rows += field(meta, META_ROWS)
        self.files += 1

    def _bloom(self, src: BinaryIO, m: Struct, stop: int, move: int) -> None:
        at, length = field(m, COLUMN_BLOOM), field(m, COLUMN_BLOOM_LENGTH)
        if not at:
            return
        if at < stop:
            put(m, COLUMN_BLOOM, I64, at + move)
        elif length:
            _copy(src, at, at + length, self.out)
            put(m, COLUMN_BLOOM, I64, self.at)
            self.at += length
        else:  # its length is unknown, and it is no more than an aid to skipping
            put(m, COLUMN_BLOOM, I64, None)

    def _page_indexes(self, src: BinaryIO, c: Struct, move: int) -> None:
        def read(at: int, length: int) -> bytes | None:
            if not field(c, at) or not field(c, length):
                return None
            src.seek(field(c, at))
            return src.read(field(c, length))

        columns, offsets = read(CHUNK_COLUMN_INDEX, CHUNK_COLUMN_INDEX_LENGTH), read(CHUNK_OFFSET_INDEX, CHUNK_OFFSET_INDEX_LENGTH)
        moved = None
        if offsets is not None:
            moved, _ = read_struct(memoryview(offsets))
            for page in field(moved, 1)[1]:
                put(page, 1, I64, field(page, 1) + move)
        self.indexes.append((c, columns, moved))

    def close(self) -> dict[str, int]:
        """Write indexes and footer; the numbers of files, row groups, rows and bytes."""
        if self.meta is None:
            raise IncompatibleFiles("no input")
        for c, columns, _ in self.indexes:
            if columns is not None:
                self.out.write(columns)
                put(c, CHUNK_COLUMN_INDEX, I64, self.at)
                self.at += len(columns)
        for c, _, offsets in self.indexes:
            if offsets is not None:
                b = bytearray()
                write_struct(b, offsets)
                self.out.write(b)
                put(c, CHUNK_OFFSET_INDEX, I64, self.at)
                put(c, CHUNK_OFFSET_INDEX_LENGTH, I32, len(b))
                self.at += len(b)
        if len(self.groups) < 1 << 15:
            for n, g in enumerate(self.groups):
                put(g, GROUP_ORDINAL, I16, n)
        if field(self.meta, META_PAIRS):
            kept = [p for p in field(self.meta, META_PAIRS)[1] if (field(p, PAIR_KEY), field(p, PAIR_VALUE)) in self.pairs]
            put(self.meta, META_PAIRS, LIST, (STRUCT, kept) if kept else None)
        put(self.meta, META_ROWS, I64, self.rows)
        put(self.meta, META_GROUPS, LIST, (STRUCT, self.groups))
        b = bytearray()
        write_struct(b, self.meta)
        self.out.write(bytes(b) + struct.pack("<I", len(b)) + MAGIC)
        return {"files": self.files, "row_groups": len(self.groups), "rows": self.rows, "bytes": self.at + len(b) + 8}


def join_files(inputs: Sequence[tuple[BinaryIO, int]], out: BinaryIO) -> dict[str, int]:
    """Join open files, given with their sizes."""
    j = Joiner(out)
    for f, size in inputs:
        j.add(f, size)
    return j.close()
