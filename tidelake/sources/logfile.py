"""Log files of framed blocks: data (Avro or Parquet), deletes and commands.

A block: magic, length, version, type, header, content length, content, footer, total length; big-endian.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq

from ..errors import CorruptFileError, UnsupportedError
from ..functions.timestamps import widen
from .avro import Decoder

# Fixed values of the format.
MAGIC = b"#HUDI#"
COMMAND, DELETE, CORRUPT, AVRO_DATA, HFILE_DATA, PARQUET_DATA, CDC_DATA = range(7)
INSTANT_TIME, TARGET_INSTANT_TIME, SCHEMA, COMMAND_TYPE = 0, 1, 2, 3
CONTENT_VERSION, ROLLBACK = 3, "0"
#: The types that a deleted record's ordering value may have, in order.
ORDERING_TYPES = ["null", "int", "long", "float", "double", "bytes", "string", {"type": "bytes", "logicalType": "decimal", "precision": 30, "scale": 15}, {"type": "int", "logicalType": "date"}, {"type": "int", "logicalType": "time-millis"}, {"type": "long", "logicalType": "time-micros"}, {"type": "long", "logicalType": "timestamp-millis"}, {"type": "long", "logicalType": "timestamp-micros"}]


#: Bytes read at once for a block's header; more follow if it is longer.
HEAD_BYTES = 1 << 16


@dataclass(frozen=True)
class Block:
    """A block without its content, which stands at ``offset`` of ``file`` (any seekable file)."""

    kind: int
    header: dict[int, str]
    file: Any
    offset: int
    length: int

    @property
    def instant(self) -> str:
        return self.header.get(INSTANT_TIME, "")

    @property
    def content(self) -> bytes:
        self.file.seek(self.offset)
        data = self.file.read(self.length)
        if len(data) < self.length:
            raise CorruptFileError("a log file ends within a block")
        return data


def _map(data: bytes, at: int) -> tuple[dict[int, str], int]:
    (n,) = struct.unpack_from(">I", data, at)
    at, out = at + 4, {}
    for _ in range(n):
        key, size = struct.unpack_from(">II", data, at)
        if at + 8 + size > len(data):
            raise struct.error("more to read")
        out[key] = data[at + 8 : at + 8 + size].decode()
        at += 8 + size
    return out, at


def blocks(file: Any) -> Iterator[Block]:
    """The blocks of a log file (bytes, or a seekable file); only headers are read."""
    file = io.BytesIO(file) if isinstance(file, bytes) else file
    end = file.seek(0, 2)
    end, at = file.tell() if end is None else end, 0
    while at < end:
        need = HEAD_BYTES
        while True:
            file.seek(at)
            data = file.read(need)
            if data[:6] != MAGIC:
                raise CorruptFileError(f"no block at byte {at} of a log file")
            try:
                (size,) = struct.unpack_from(">Q", data, 6)
                _, kind = struct.unpack_from(">II", data, 14)
                header, here = _map(data, 22)
                (length,) = struct.unpack_from(">Q", data, here)
                break
            except struct.error as e:
                if at + need >= end:
                    raise CorruptFileError("a log file ends within a block") from e
                need *= 4
        if at + here + 8 + length > end:
            raise CorruptFileError("a log file ends within a block")
        yield Block(kind, header, file, at + here + 8, length)
        at += 14 + size


def frame(kind: int, header: dict[int, str], content: bytes) -> bytes:
    """A block's bytes (for tests and fixtures)."""
    maps = lambda m: struct.pack(">I", len(m)) + b"".join(struct.pack(">II", k, len(v.encode())) + v.encode() for k, v in m.items())
    body = struct.pack(">II", 1, kind) + maps(header) + struct.pack(">Q", len(content)) + content + maps({})
    size = len(body) + 8
    return MAGIC + struct.pack(">Q", size) + body + struct.pack(">Q", len(MAGIC) + 8 + len(body))


def batches(block: Block, columns: list[str], size: int = 4096) -> Iterator[dict[str, Any]]:
    """The ``columns`` of a data block's records, some at a time: Arrow arrays of a Parquet block, lists of values of an Avro one."""
    content = block.content
    if block.kind == PARQUET_DATA:
        source = pq.ParquetFile(io.BytesIO(content))
        for b in source.iter_batches(size, columns=[c for c in columns if c in source.schema_arrow.names]):
            yield dict(zip(b.schema.names, b.columns, strict=True)) | {"": b.num_rows}
        return
    if block.kind != AVRO_DATA:
        raise UnsupportedError(f"data of log block type {block.kind}")
    version, n = struct.unpack_from(">II", content)
    if version != CONTENT_VERSION:
        raise UnsupportedError(f"content version {version} of a log block")
    at, held, decoder = 8, [], Decoder(json.loads(block.header[SCHEMA]))
    for i in range(n):
        (length,) = struct.unpack_from(">I", content, at)
        held.append(decoder.decode(content[at + 4 : at + 4 + length])[0])
        at += 4 + length
        if len(held) == size or i == n - 1:
            yield {c: [r.get(c) for r in held] for c in columns} | {"": len(held)}
            held = []


#: The record of a delete block: a list of key, partition and ordering value (fixed by the format).
def delete_schema() -> dict:
    """The list of deleted records: key, partition and an ordering value of any of several types."""
    record = {"type": "record", "name": "HoodieDeleteRecord", "fields": [{"name": "recordKey", "type": ["null", "string"]}, {"name": "partitionPath", "type": ["null", "string"]}, {"name": "orderingVal", "type": ORDERING_TYPES}]}
    return {"type": "record", "name": "HoodieDeleteRecordList", "fields": [{"name": "deleteRecordList", "type": {"type": "array", "items": record}}]}


def deletes(block: Block) -> list[tuple[str, Any]]:
    """(record key, ordering value) of a delete block."""
    content = block.content
    version, size = struct.unpack_from(">II", content)
    if version != CONTENT_VERSION:
        raise UnsupportedError(f"content version {version} of a delete block")
    got = Decoder(delete_schema()).decode(content[8 : 8 + size])[0]["deleteRecordList"]
    value = lambda v: next((x for x in v.values() if x is not None), None) if isinstance(v, dict) else v
    return [(r["recordKey"], value(r["orderingVal"])) for r in got]


def rolled_back(every: list[Block]) -> set[str]:
    """Instants that rollback commands of a slice's log files take back."""
    return {b.header.get(TARGET_INSTANT_TIME, "") for b in every if b.kind == COMMAND and b.header.get(COMMAND_TYPE, ROLLBACK) == ROLLBACK}


def live(files: list[Any], low: str, high: str) -> Iterator[Block]:
    """The blocks of a slice's log files, in order, whose instants are in (low, high] and weren't rolled back."""
    every = [b for f in files for b in blocks(f)]
    undone = rolled_back(every)
    for b in every:
        if b.kind != COMMAND and b.instant not in undone and low < widen(b.instant) <= high:
            yield b


def arrow_batches(files: list[Any], low: str, high: str, schema: pa.Schema, key: str, ordering: str | None, time: str, dead: str) -> Iterator[pa.RecordBatch]:
    """A slice's log records as batches of ``schema``, which ends in the flag ``dead``.

    Of a deleted record only the flag, its ``key``, its ``ordering`` value and its ``time`` (the block's instant) are set.
    """

    def batch(columns: dict[str, Any], n: int) -> pa.RecordBatch:
        return pa.record_batch([fitted(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    for b in live(files, low, high):
        if b.kind == DELETE:
            found = deletes(b)
            columns = {key: [k for k, _ in found], time: [b.instant] * len(found), dead: [True] * len(found)}
            if ordering:
                columns[ordering] = [v for _, v in found]
            if found:
                yield batch(columns, len(found))
        else:
            for columns in batches(b, [n for n in schema.names if n != dead]):
                n = columns.pop("")
                yield batch(columns | {dead: [False] * n}, n)


def fitted(values: Any, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow array of a type, without Python objects where Arrow can cast them."""
    if not isinstance(values, pa.Array | pa.ChunkedArray):
        return pa.array(values, kind)
    if values.type == kind:
        return values
    try:
        return values.cast(kind)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return pa.array(values.to_pylist(), kind)
