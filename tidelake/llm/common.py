"""What the corpus operators share: scratch tables, row batches, hashing and exact cached tokenisation."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Storage, shared_folder

U64 = np.uint64


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master, as in tests, may do without that setting and gets a local one.
    """
    root = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/tidelake-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing lazy reads it any more."""
    for df in tables:
        folder, _, name = df._scratch.rpartition("/")
        Storage(df.sparkSession, folder).delete(name)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def no_shuffle_files_left(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within it, each query's shuffle files go as soon as it ends, and not only when the driver collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within it, tasks hand 500 rows at a time to Python in place of 10,000: a batch is held on both sides, and whole texts or sets are long."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "500")


#: Keys that join_counted() sends to every task: the most frequent ones, each of at least ``LEAST_HOT`` rows. Any other key
#: has at most a MOST_HOT-th of all rows, so no task gets more.
MOST_HOT, LEAST_HOT = 20_000, 500


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each of its ``keys`` and says in ``count`` how many rows there are of it.

    Rows of the most frequent keys stay where they are and meet a broadcast part of the table, of MOST_HOT rows at most.
    ``rows`` is read twice, so it should be a written table.
    """
    hot = table.where(F.col(count) >= LEAST_HOT).orderBy(F.desc(count), *keys).limit(MOST_HOT)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on and run other queries' tasks."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Arrow batches of ``df`` through the function that ``make`` builds once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out
        del f
        give_back()

    return df.mapInArrow(run, schema)


def utf8(col: str = "text") -> F.Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string").cast("binary"), F.lit(b""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the shift-multiply rounds of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; starts anew beyond ``most`` words, so its memory is bounded."""

    def __init__(self, most: int = 1_000_000) -> None:
        from xxhash import xxh3_64_intdigest

        super().__init__()
        if piece_ids.cache_info().currsize:  # an earlier query's; a worker holds one large cache at a time
            piece_ids.cache_clear()
            give_back()
        self.most, self.hash = most, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.hash(word)
        return out

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: Texts of these characters only are cut into pieces here; any other goes to the tokenizer whole. Their Unicode
#: properties have been fixed for long, so regex engines agree on them, and none is changed by NFC.
PLAIN_CHARS = "".join(c for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180)]) if c not in "\xad\u0130")
PLAIN = re.compile(f"[{re.escape(PLAIN_CHARS)}]*\\Z")


def plain_class(kind: str) -> str:
    """The plain characters of a general category, for a character class."""
    return re.escape("".join(c for c in PLAIN_CHARS if unicodedata.category(c)[0] == kind))


class PieceIds(dict):
    """Tokenizer piece to its ids as little-endian 32-bit bytes.

    BPE merges never cross a pre-tokenizer piece, so the ids of a text are those of its pieces in a row. Each
    piece is encoded by the BPE model of the tokenizers library once and remembered, at most ``most`` at a time.
    """

    #: The piece patterns of the two public tokenizers (fixed values from their files).
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = 700_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normal = spec.get("pre_tokenizer") or {}, [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        patterns = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", [])]
        if pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not spec.get("normalizer"):
            pattern = self.BYTE_LEVEL
        elif patterns == [self.LOWER_WORDS, None] and normal == ["NFC", "Replace", "Lowercase"]:
            pattern = self.LOWER_WORDS
        else:
            pattern = None  # not a shape known here: every text goes to the tokenizer whole
        self.lowered = "Lowercase" in normal
        if pattern:
            pattern = pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
            letters, numbers = plain_class("L"), plain_class("N")
            pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        self.cut = pattern and re.compile(pattern).findall
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # this one remembers whole pieces already
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_chars = {b: alphabet.pre_tokenize_str(bytes([b]).decode("latin-1"))[0][0] for b in range(128)}
        for b in range(128, 256):  # a byte that is no text on its own: the last one of a two-byte or longer character
            lead = bytes([0xC2, b]) if b < 0xC0 else None
            if lead:
                self.as_chars[b] = alphabet.pre_tokenize_str(lead.decode())[0][0][1]
        for b, first in [(b, 0x80) for b in range(0xC2, 0xE0)]:
            self.as_chars[b] = alphabet.pre_tokenize_str(bytes([b, first]).decode())[0][0][0]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.as_chars))
        out = self[piece] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return out

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as the tokenizer gives them without special tokens."""
        if not self.cut or not PLAIN.match(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.cut(text.lower() if self.lowered else text)))


@functools.lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    """One cache for all the tasks that a Python worker runs after another."""
    return PieceIds(path)
