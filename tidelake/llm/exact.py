"""Exact deduplication through a cuckoo-filter index of live digests.

Each text's SHA-256 goes to the index bucket that its digest names. A bucket's index is a cuckoo filter of 16-bit
fingerprints beside the stored keys: a miss proves a digest new, a hit is verified against the keys stored in the two
candidate buckets, a digest can be deleted and inserted again, and when an insertion finds no place the table doubles
and is filled again from the stored keys.

A third of all rows may be copies of one text, so rows are combined by (digest, salt) before they meet in the index,
and each row gets its answer by (digest, salt) too: no task holds all the copies of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import utf8

SLOTS, MAX_KICKS, SALTS = 4, 200, 64
#: Rows that one index in memory takes in, and the rest of the last digest.
INDEX_ROWS = 200_000


class CuckooIndex:
    """Digest (bytes) to a value, by partial-key cuckoo hashing with ``SLOTS`` slots in a bucket."""

    def __init__(self, buckets: int = 64) -> None:
        self.mask = self._power(buckets) - 1
        self.fingerprints = bytearray(2 * SLOTS * (self.mask + 1))
        self.view = memoryview(self.fingerprints).cast("H")
        self.keys: list[bytes | None] = [None] * len(self.view)
        self.values: list = [None] * len(self.view)
        self.size = self.resizes = self.false_hits = 0

    @staticmethod
    def _power(n: int) -> int:
        return 1 << max(1, n - 1).bit_length()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and the two buckets; each follows from the other and the fingerprint."""
        fp = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[:8], "little") & self.mask
        return fp, one, self._other(one, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> int:
        """The slot of a live digest, or -1. Only slots whose fingerprint hits are verified against the stored key."""
        fp, one, two = self._places(key)
        for bucket in (one, two):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.view[slot] == fp:
                    if self.keys[slot] == key:
                        return slot
                    self.false_hits += 1
        return -1

    def insert(self, key: bytes, value: object) -> None:
        """Add a digest that isn't live."""
        while not self._put(key, value):
            self._resize()
        self.size += 1

    def _put(self, key: bytes, value: object) -> bool:
        fp, one, two = self._places(key)
        path: list[int] = []
        bucket = one
        for kick in range(MAX_KICKS):
            for b in (one, two) if not kick else (bucket,):
                for slot in range(SLOTS * b, SLOTS * b + SLOTS):
                    if not self.view[slot]:
                        self.view[slot], self.keys[slot], self.values[slot] = fp, key, value
                        return True
            slot = SLOTS * bucket + (kick + fp) % SLOTS
            path.append(slot)
            old = self.view[slot], self.keys[slot], self.values[slot]
            self.view[slot], self.keys[slot], self.values[slot] = fp, key, value
            fp, key, value = old
            bucket = self._other(bucket, fp)
        for slot in reversed(path):  # no place: undo, so that every live digest is stored again
            old = self.view[slot], self.keys[slot], self.values[slot]
            self.view[slot], self.keys[slot], self.values[slot] = fp, key, value
            fp, key, value = old
        return False

    def _resize(self) -> None:
        live = [(k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None]
        grown = CuckooIndex(2 * (self.mask + 1))
        for k, v in live:
            grown.insert(k, v)
        for name in ("mask", "fingerprints", "view", "keys", "values"):
            setattr(self, name, getattr(grown, name))
        self.resizes += 1 + grown.resizes

    def delete(self, key: bytes) -> bool:
        if (slot := self.find(key)) < 0:
            return False
        self.view[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def get(self, key: bytes) -> object:
        return None if (slot := self.find(key)) < 0 else self.values[slot]


def index_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index partition: (digest, salt, top, n) rows in, ordered by digest; the same rows with their group's keeper and size out.

    Of two rows of a digest, the live digest of the lesser keeper is deleted and that of the greater inserted. An index
    holds some ``INDEX_ROWS`` rows; as all rows of a digest follow one another, the next digests start a new one.
    """
    index, rows, held, last = CuckooIndex(), [], 0, None

    def answered() -> Iterator[pa.RecordBatch]:
        for part in rows:
            found = [index.get(d) for d in part.column("digest").to_pylist()]
            yield pa.record_batch([part.column("digest"), part.column("salt"), pa.array([k for k, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["digest", "salt", "keep", "size"])

    for batch in batches:
        begin = 0
        for i, (digest, top, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("digest", "top", "n")), strict=True)):
            if held >= INDEX_ROWS and digest != last:
                rows.append(batch.slice(begin, i - begin))
                yield from answered()
                index, rows, held, begin = CuckooIndex(), [], 0, i
            held, last = held + 1, digest
            slot = index.find(digest)
            if slot < 0:
                index.insert(digest, (top, n))
                continue
            keep, size = index.values[slot]
            if keep is None or (top is not None and top > keep):
                index.delete(digest)
                index.insert(digest, (top, size + n))
            else:
                index.values[slot] = keep, size + n
        rows.append(batch.slice(begin))
    yield from answered()


def _grouped(docs: DataFrame, salts: int | None) -> DataFrame:
    """Per row of ``docs`` the whole row, its id and digest, and its group's keep, size and kept."""
    # So many tasks share the copies of one text: as the cluster grows, so does the number of its shuffle partitions.
    salts = salts or max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.sha2(utf8(), 256)).alias("digest"), salt.alias("salt"), F.col("doc_id").cast("long").alias("id"))
    salted = rows.groupBy("digest", "salt").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    found = salted.repartition("digest").sortWithinPartitions("digest").mapInArrow(index_bucket, "digest binary, salt int, keep long, size long")
    one = F.row_number().over(Window.partitionBy("digest", "salt", "id").orderBy("keep")) == 1
    return rows.join(found, ["digest", "salt"]).withColumn("kept", F.col("id").eqNullSafe(F.col("keep")) & one)


def groups(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. The largest doc_id of a group stays; a null doc_id
    is less than any other. Rows that repeat doc_id and text are counted each, and one of them is kept (keep_id is null
    where no row of a group has an id). A very long text costs its digest only. Other columns don't matter; an empty
    table gives an empty result.
    """
    out = _grouped(docs.select("doc_id", "text"), salts)
    return out.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay by groups(), with all their columns, whatever their names; of rows that repeat doc_id and text one stays."""
    return _grouped(docs, salts).where("kept").select(*(F.col(f"row.`{c}`") for c in docs.columns))
