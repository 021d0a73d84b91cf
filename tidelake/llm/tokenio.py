"""Token ids in a compressed file format: a static range asymmetric numeral system (rANS) with interleaved lanes.

A file set is a folder of two Parquet tables, written by Spark so that any store and any lost executor is handled:

* ``model``: (symbol, frequency): one frequency table shared by all blocks; frequencies sum to 2**``SCALE_BITS``.
* ``blocks``: one row for each block of whole documents, in ascending order of (shard, block): the documents' ids,
  their places and token counts, the number of tokens, checkpoints, the coded 32-bit words, and CRC-32s.

Each block is coded for itself by ``LANES`` interleaved coders. A checkpoint every ``STEPS`` steps holds the
lanes' states and the word position, so that decoding can start there: blocks, and parts of a block, decode in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, materialise, piece_ids, scratch_path, utf8

END_ID, SCALE_BITS, LANES, STEPS, BLOCK_TOKENS = 2, 20, 512, 128, 1 << 18
LOW = 1 << 31
#: Bytes of text in a shard, one task's work; documents that share a doc_id may be in several.
SHARD_BYTES = 32 << 20
TOKENS = "shard int, row long, at long, doc_id long, n_tokens long, ids binary"
BLOCKS = "shard int, block long, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, words binary, crc32 long"


class FrequencyTable:
    """Symbol frequencies scaled to 2**SCALE_BITS, at least 1 for each symbol that occurs."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray) -> None:
        self.symbols, self.freq = symbols.astype(np.uint32), frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.number = np.full(int(self.symbols.max()) + 1 if len(symbols) else 1, -1, np.int64)
        self.number[self.symbols] = np.arange(len(self.symbols))
        self.slot = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: dict[int, int]) -> FrequencyTable:
        symbols = np.array(sorted(counts), dtype=np.int64)
        if len(symbols) >= 1 << SCALE_BITS:
            raise ValueError("more symbols than the scale has places")
        n = np.array([counts[int(s)] for s in symbols], dtype=np.float64)
        if not len(n):
            return cls(symbols, n)
        spare = (1 << SCALE_BITS) - len(n)
        share = n / n.sum() * spare
        freq = 1 + np.floor(share).astype(np.int64)
        rest = (1 << SCALE_BITS) - int(freq.sum())
        freq[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]] += 1
        return cls(symbols, freq)


def narrow(ids: bytes) -> bytes:
    """Ids of 32 bits as 16 bits each where all of them fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if len(wide) and wide.max() < 1 << 16 else ids


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.uint32)


def encode_block(ids: np.ndarray, table: FrequencyTable) -> tuple[bytes, bytes]:
    """Checkpoints and words of a block. Token t is coded by lane t % LANES at step t // LANES; coding runs backwards."""
    at = table.number[ids]
    if len(at) and at.min() < 0:
        raise ValueError("a symbol that the table lacks")
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    freq, start = table.freq[at], table.start[at]
    scale, out, marks, written = U64(SCALE_BITS), [], [], 0
    for step in range(steps - 1, -1, -1):
        f, s = freq[step * LANES : (step + 1) * LANES], start[step * LANES : (step + 1) * LANES]
        x = state[: len(f)]
        full = x >= (f << U64(63 - SCALE_BITS))
        if full.any():
            words = (x[full] & U64(0xFFFFFFFF)).astype("<u4")
            out.append(words)
            written += len(words)
            x = np.where(full, x >> U64(32), x)
        q = x // f
        state[: len(f)] = (q << scale) + (x - q * f) + s
        if step % STEPS == 0:
            marks.append((written, state.astype("<u8").tobytes()))
    checkpoints = b"".join((written - w).to_bytes(8, "little") + s for w, s in reversed(marks))
    return checkpoints, b"".join(w.tobytes() for w in reversed(out))


def decode_block(n: int, checkpoints: bytes, words: bytes, table: FrequencyTable, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint ``first`` to before checkpoint ``last`` (None: to the end) of a block of ``n`` tokens."""
    size = 8 + 8 * LANES
    have = len(checkpoints) // size
    last = have if last is None else min(last, have)
    stream, parts = np.frombuffer(words, dtype="<u4").astype(np.uint64), []
    mask, scale = U64((1 << SCALE_BITS) - 1), U64(SCALE_BITS)
    for mark in range(first, last):
        head = checkpoints[mark * size : (mark + 1) * size]
        at, state = int.from_bytes(head[:8], "little"), np.frombuffer(head[8:], dtype="<u8").astype(np.uint64)
        for step in range(mark * STEPS, min((mark + 1) * STEPS, -(-n // LANES))):
            live = min(LANES, n - step * LANES)
            x = state[:live]
            low = x & mask
            k = table.slot[low]
            x = table.freq[k] * (x >> scale) + low - table.start[k]
            need = np.flatnonzero(x < U64(LOW))
            if len(need):
                x[need] = (x[need] << U64(32)) | stream[at : at + len(need)]
                at += len(need)
            state[:live] = x
            parts.append(k)
    return table.symbols[np.concatenate(parts)] if parts else np.empty(0, np.uint32)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """All documents' ids in ascending doc_id order: the order is that of (shard, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shard, row, at = piece_ids(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            if batch.num_rows:
                data = [ids.encode((t or b"").decode("utf-8", "replace")) + end for t in batch.column(1).to_pylist()]
                n, sizes = len(data), np.array([len(d) // 4 for d in data], np.int64)
                places = at + np.cumsum(sizes) - sizes
                at = int(places[-1] + sizes[-1])
                yield pa.record_batch([pa.array([shard] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(places), batch.column(0), pa.array(sizes), pa.array(map(narrow, data), pa.binary())], names=[x.split()[0] for x in TOKENS.split(", ")])
                row += n

    rows = docs.select(F.col("doc_id").cast("long"), utf8().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = ["doc_id", F.xxhash64("text")]
    shards = rows.repartitionByRange(max(1, -(-size // SHARD_BYTES)), *order)
    return shards.sortWithinPartitions(*order, "text").mapInArrow(run, TOKENS)


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text), each with ``end_id`` appended, to a new file set at ``path``.

    Documents stand in ascending doc_id order, null first, rows that repeat a doc_id by a hash of their texts; a null text counts as
    empty, and a text longer than a block makes a block of its own. Other columns don't matter; an empty table gives a file set of no blocks. The driver gets one count for
    each symbol and one for each shard, no ids.
    """
    spark = docs.sparkSession
    tokens = materialise(tokenize(docs, tokenizer_path, end_id), "tokens")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                n = np.bincount(np.concatenate(list(map(widen, batch.column(0).to_pylist(), batch.column(1).to_pylist()))), minlength=len(total))
                n[: len(total)] += total
                total = n
        if (some := np.flatnonzero(total)).size:
            yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["symbol", "n"])

    counts = {r["symbol"]: r["n"] for r in tokens.select("ids", "n_tokens").mapInArrow(tally, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()}
    table = FrequencyTable.of_counts(counts)
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(table.symbols, table.freq, strict=True)], "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/model")
    offsets, before = {}, 0
    for r in tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        offsets[r["shard"]], before = before, before + r["n"]
    symbols, freq = table.symbols, table.freq

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows that follow one another in a shard, whichever part of it a task reads; a block is known by its first row."""
        table, size = FrequencyTable(symbols, freq), 0
        docs: list[tuple[int | None, int]] = []
        held: list[bytes] = []
        shard = first = begin = following = None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([widen(h, n) for h, (_, n) in zip(held, docs, strict=True)])
            marks, words = encode_block(ids, table)
            row = {"shard": shard, "block": first, "first_token": offsets[shard] + begin, "n_tokens": len(ids), "doc_ids": [d for d, _ in docs], "doc_tokens": [n for _, n in docs], "checkpoints": marks, "words": words, "crc32": zlib.crc32(words, zlib.crc32(marks))}
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())
            return pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            for s, row, at, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "row", "at", "doc_id", "n_tokens", "ids")), strict=True):
                if docs and ((s, row) != following or size + n > BLOCK_TOKENS):
                    yield flush()
                    size = 0
                    docs.clear()
                    held.clear()
                if not docs:
                    shard, first, begin = s, row, at
                docs.append((doc, n))
                held.append(ids)
                size, following = size + n, (s, row + 1)
        if docs:
            yield flush()

    tokens.mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian 32-bit) from a file set, checksums verified."""
    model = spark.read.parquet(f"{path}/model").orderBy("symbol").collect()
    symbols, freq = np.array([r["symbol"] for r in model], np.int64), np.array([r["frequency"] for r in model], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(symbols, freq)
        for b in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            if zlib.crc32(b["words"], zlib.crc32(b["checkpoints"])) != b["crc32"]:
                raise ValueError(f"checksum of shard {b['shard']}, block {b['block']}")
            data = decode_block(b["n_tokens"], b["checkpoints"], b["words"], table).astype("<u4").tobytes()
            ends = np.cumsum(b["doc_tokens"])
            starts = ends - b["doc_tokens"]
            ids = [data[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([pa.array(b["doc_ids"], pa.int64()), pa.array(starts + b["first_token"]), pa.array(b["doc_tokens"], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write a file set to the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "rans")
    write(docs, tokenizer_path, path, end_id)
    return read(docs.sparkSession, path)
