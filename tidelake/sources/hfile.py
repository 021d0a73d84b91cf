"""Index files of sorted key-value blocks (HFile, version 3), as the metadata table has them; lookups decode only the blocks they need."""

from __future__ import annotations

import functools
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

from ..errors import CorruptFileError, UnsupportedError

# Fixed values of the format: block magics, lengths, field numbers of the trailer and ids of codecs.
DATA, FILE_INFO, TRAILER, INFO_MAGIC = b"DATABLK*", b"FILEINF2", b'TRABLK"$', b"PBUF"
ROOT_INDEX, INNER_INDEX, LEAF_INDEX = b"IDXROOT2", b"IDXINTE2", b"IDXLEAF2"
HEADER = struct.Struct(">8siiqbii")
TRAILER_SIZE, VERSION = 4096, 3
INFO_OFFSET, INDEX_OFFSET, INDEX_COUNT, ENTRIES, LEVELS, FIRST_DATA, LAST_DATA, CODEC = 1, 2, 5, 7, 8, 9, 10, 12
GZIP, NONE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 0x80:
            return n, at


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        n, at = _varint(data, at)
        if tag & 7 == 2:
            yield tag >> 3, data[at : at + n]
            at += n
        elif tag & 7 == 0:
            yield tag >> 3, n
        else:
            raise CorruptFileError(f"wire type {tag & 7} in an index file")


def _delimited(data: bytes, at: int) -> bytes:
    n, at = _varint(data, at)
    return data[at : at + n]


def _index_length(data: bytes, at: int) -> tuple[int, int]:
    """A length as index entries spell it: one byte up to 127, else a byte that tells how many follow."""
    first = data[at] - 256 if data[at] > 127 else data[at]
    if first >= -112:
        return first, at + 1
    n = -112 - first
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def _name(key: bytes) -> str:
    """The content of a key: two bytes of length go before it, other parts follow."""
    return key[2 : 2 + int.from_bytes(key[:2], "big")].decode()


class IndexFile:
    """The records of one file, in key order (that of their UTF-8 bytes, which is that of Python's strings)."""

    def __init__(self, data: bytes) -> None:
        self.data, at = data, len(data) - TRAILER_SIZE
        if at < 0 or data[at : at + 8] != TRAILER:
            raise CorruptFileError("an index file without a trailer")
        if (major := struct.unpack(">I", data[-4:])[0] & 0xFFFFFF) != VERSION:
            raise UnsupportedError(f"version {major} of an index file")
        self.trailer = dict(_message(_delimited(data, at + 8)))
        if self.trailer.get(CODEC, NONE) not in (GZIP, NONE):
            raise UnsupportedError(f"codec {self.trailer[CODEC]} of an index file")

    def _block(self, at: int) -> tuple[bytes, bytes, int]:
        """The block's magic and content, and where the next one begins. Checksums follow the content."""
        try:
            magic, stored, plain, _, _, _, with_header = HEADER.unpack_from(self.data, at)
        except struct.error as e:
            raise CorruptFileError("an index file ends within a block") from e
        content = self.data[at + HEADER.size : at + with_header]
        if self.trailer.get(CODEC, NONE) == GZIP and content:
            content = zlib.decompress(content, 31)
        if len(content) < plain:
            raise CorruptFileError("an index file ends within a block")
        return magic, content[:plain], at + HEADER.size + stored

    def info(self) -> dict[str, bytes]:
        magic, content, _ = self._block(self.trailer[INFO_OFFSET])
        if magic != FILE_INFO or content[:4] != INFO_MAGIC:
            raise CorruptFileError("an index file without file info")
        pairs = (dict(_message(p)) for _, p in _message(_delimited(content, 4)))
        return {p[1].decode(): p.get(2, b"") for p in pairs}

    def _entries(self, content: bytes, count: int | None) -> Iterator[tuple[str, int]]:
        """(first key, offset) of an index block's entries; only blocks below the root say how many there are."""
        at = 0
        if count is None:
            (count,) = struct.unpack_from(">i", content)
            at = 4 + 4 * (count + 1)
        for _ in range(count):
            (offset,) = struct.unpack_from(">q", content, at)
            n, at = _index_length(content, at + 12)
            yield _name(content[at : at + n]), offset
            at += n

    @functools.cached_property
    def index(self) -> tuple[list[str], list[int]]:
        """First keys and offsets of the data blocks, by the block index, whatever its levels."""
        if not self.trailer.get(ENTRIES, 0):
            return [], []
        magic, content, _ = self._block(self.trailer.get(INDEX_OFFSET, 0))
        if magic != ROOT_INDEX:
            raise CorruptFileError("an index file without a block index")
        found = list(self._entries(content, self.trailer.get(INDEX_COUNT, 0)))
        for _ in range(self.trailer.get(LEVELS, 1) - 1):
            found = [e for _, at in found for e in self._entries(self._block(at)[1], None)]
        return [k for k, _ in found], [at for _, at in found]

    def _records(self, at: int) -> Iterator[tuple[str, bytes]]:
        magic, content, _ = self._block(at)
        here = 0
        while magic == DATA and here < len(content):
            key, value = struct.unpack_from(">ii", content, here)
            here += 8
            yield _name(content[here : here + key]), content[here + key : here + key + value]
            here += key + value + 1  # a version byte ends each record

    def __iter__(self) -> Iterator[tuple[str, bytes]]:
        for at in self.index[1]:
            yield from self._records(at)

    def lookup(self, keys: Iterable[str]) -> dict[str, bytes]:
        """The values of those ``keys`` that are there; each block that may hold some is decoded once."""
        firsts, offsets = self.index
        by_block: dict[int, set[str]] = {}
        for k in keys:
            if (i := bisect_right(firsts, k) - 1) >= 0:
                by_block.setdefault(i, set()).add(k)
        return {k: v for i, wanted in sorted(by_block.items()) for k, v in self._records(offsets[i]) if k in wanted}

    def prefixed(self, prefix: str) -> dict[str, bytes]:
        """The records whose keys begin with ``prefix``: from the block that may hold it to the first greater key."""
        firsts, offsets = self.index
        out = {}
        for at in offsets[max(0, bisect_right(firsts, prefix) - 1) :]:
            for k, v in self._records(at):
                if k.startswith(prefix):
                    out[k] = v
                elif k > prefix:
                    return out
        return out


def build(records: dict[str, bytes], info: dict[str, bytes], gzip: bool = False, per_block: int = 2, per_leaf: int = 0) -> bytes:
    """A file's bytes (for tests and fixtures); ``per_leaf``: so many data blocks in each leaf of a two-level index."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n >= 0x80:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    def part(number: int, body: bytes) -> bytes:
        return varint(number << 3 | 2) + varint(len(body)) + body

    def block(magic: bytes, content: bytes) -> bytes:
        squeeze = zlib.compressobj(wbits=31)
        stored = squeeze.compress(content) + squeeze.flush() if gzip else content
        return HEADER.pack(magic, len(stored) + 4, len(content), -1, 1, 16384, HEADER.size + len(stored)) + stored + b"\0" * 4

    def length(n: int) -> bytes:
        body = n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")
        return bytes([n]) if n < 128 else bytes([256 - 112 - len(body)]) + body

    def entry(name: str, at: int, size: int) -> bytes:
        key = struct.pack(">H", len(name.encode())) + name.encode() + b"\0" * 10
        return struct.pack(">qi", at, size) + length(len(key)) + key

    items, out, last, index = sorted(records.items()), b"", 0, []
    for i in range(0, len(items), per_block):
        last = len(out)
        index.append((items[i][0], last))
        rows = ((struct.pack(">H", len(k.encode())) + k.encode() + b"\0" * 10, v) for k, v in items[i : i + per_block])
        out += block(DATA, b"".join(struct.pack(">ii", len(k), len(v)) + k + v + b"\0" for k, v in rows))
    levels = 1
    if per_leaf:
        levels, leaves = 2, []
        for i in range(0, len(index), per_leaf):
            entries = [entry(k, a, 0) for k, a in index[i : i + per_leaf]]
            ends = [0]
            for e in entries:
                ends.append(ends[-1] + len(e))
            leaves.append((index[i][0], len(out)))
            out += block(LEAF_INDEX, struct.pack(">i", len(entries)) + b"".join(struct.pack(">i", e) for e in ends) + b"".join(entries))
        index = leaves
    root = len(out)
    out += block(ROOT_INDEX, b"".join(entry(k, a, 0) for k, a in index))
    at = len(out)
    pairs = b"".join(part(1, part(1, k.encode()) + part(2, v)) for k, v in info.items())
    out += block(FILE_INFO, INFO_MAGIC + varint(len(pairs)) + pairs)
    fields = {INFO_OFFSET: at, INDEX_OFFSET: root, INDEX_COUNT: len(index), ENTRIES: len(items), LEVELS: levels, FIRST_DATA: 0, LAST_DATA: last, CODEC: GZIP if gzip else NONE}
    body = b"".join(varint(k << 3) + varint(v) for k, v in fields.items())
    trailer = TRAILER + varint(len(body)) + body
    return out + trailer.ljust(TRAILER_SIZE - 4, b"\0") + struct.pack(">I", VERSION)
