"""A small writer of tables, for tests and for queries that need one. The library itself only reads tables."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import COMMIT_SEQNO, COMMIT_TIME, FILE_NAME, META_FOLDER, PARTITION_PATH, PROPERTIES_FILE, RECORD_KEY, TIMELINE_FOLDER, VERSIONS
from . import hfile, logfile
from .storage import ARROW_SCHEMES, Storage, create_file, scheme


#: Rows for logs are written by at most so many tasks, each to a log file of its own.
LOG_FILES = 8
#: Of a metadata table's records, as far as the ``files`` partition needs it.
METADATA_SCHEMA = json.dumps({"type": "record", "name": "MetadataRecord", "fields": [{"name": "key", "type": "string"}, {"name": "type", "type": "int"}, {"name": "filesystemMetadata", "type": ["null", {"type": "map", "values": {"type": "record", "name": "FileInfo", "fields": [{"name": "size", "type": "long"}, {"name": "isDeleted", "type": "boolean"}]}}]}]})


class TableWriter:
    def __init__(self, spark: SparkSession, path: str, schema: str, **properties: str) -> None:
        """``schema``: Avro JSON of the data columns; properties by their keys without prefix, dots as ``__``."""
        self.spark, self.storage, self.schema = spark, Storage(spark, path), schema
        values = {"hoodie." + k.replace("__", "."): v for k, v in properties.items()}
        self.layout = VERSIONS[int(values["hoodie.table.version"])]
        values.setdefault("hoodie.timeline.layout.version", str(self.layout))
        self.keys = [k for k in values.get("hoodie.table.recordkey.fields", "").split(",") if k]
        self.storage.write("\n".join(f"{k}={v}" for k, v in values.items()).encode(), META_FOLDER, PROPERTIES_FILE)
        self.stats: dict[str, list[dict[str, Any]]] = {}
        self.latest: dict[tuple[str, str], tuple[str, list[str]]] = {}

    def _stat(self, partition: str, file_id: str, name: str, **more: Any) -> None:
        self.stats.setdefault(partition, []).append({"fileId": file_id, "path": f"{partition}/{name}" if partition else name, **more})

    def meta(self, df: DataFrame, partition: str, name: str, time: str) -> DataFrame:
        key = F.concat_ws(",", *(F.col(k).cast("string") for k in self.keys))
        return df.select(F.lit(time).alias(COMMIT_TIME), F.concat(F.lit(time + "_"), key).alias(COMMIT_SEQNO), key.alias(RECORD_KEY), F.lit(partition).alias(PARTITION_PATH), F.lit(name).alias(FILE_NAME), *df.columns)

    def base(self, df: DataFrame, partition: str, file_id: str, time: str, meta: bool = True) -> None:
        """A base file of all rows of ``df``."""
        name = f"{file_id}_0-0-0_{time}.parquet"
        tmp = self.storage.path(META_FOLDER, ".temp", name)
        (self.meta(df, partition, name, time) if meta else df).coalesce(1).write.parquet(tmp)
        part = next(f for f in Storage(self.spark, tmp).listing()[0] if f.name.startswith("part-"))
        self.storage.rename(part.path, f"{partition}/{name}" if partition else name)
        self.storage.delete(META_FOLDER, ".temp")
        self._stat(partition, file_id, name, fileSizeInBytes=next(f.size for f in self.storage.listing(partition)[0] if f.name == name))
        self.latest[partition, file_id] = (name, [])

    def log(self, partition: str, file_id: str, time: str, blocks: list[bytes], version: int = 1) -> None:
        """``time``: of the base file in layout 1, of the delta commit in layout 2."""
        self.storage.write(b"".join(blocks), partition, self._log_name(file_id, time, version))
        self._logged(partition, file_id, time, version)

    def logs(self, partition: str, file_id: str, time: str, rows: DataFrame, block: Callable[[pa.Table], bytes], version: int = 1) -> int:
        """Log files of ``rows`` from ``version`` on, and the next version that is free. ``block``: of the rows of one Arrow batch.

        Tasks write the files, so that no rows pass the driver; to a store that Arrow doesn't open it hands them on, a partition at a time.
        """
        if scheme(self.storage.base) not in ARROW_SCHEMES:

            def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        yield pa.record_batch([pa.array([block(pa.Table.from_batches([b]))], pa.binary())], names=["data"])

            self.storage.write_all((r.data for r in rows.mapInArrow(packed, "data binary").toLocalIterator()), partition, self._log_name(file_id, time, version))
            self._logged(partition, file_id, time, version)
            return version + 1
        paths = [self.storage.path(partition, self._log_name(file_id, time, version + n)) for n in range(LOG_FILES)]
        options = self.storage.options()

        def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, out = TaskContext.get().partitionId(), None
            for b in batches:
                if b.num_rows:
                    out = out or create_file(paths[n], options)
                    out.write(block(pa.Table.from_batches([b])))
            if out:
                out.close()
                yield pa.record_batch([pa.array([n], pa.int32())], names=["n"])

        self.storage.make(partition)
        done = sorted(r.n for r in rows.coalesce(LOG_FILES).mapInArrow(written, "n int").collect())
        for n in done:
            self._logged(partition, file_id, time, version + n)
        return version + max(done, default=-1) + 1

    @staticmethod
    def _log_name(file_id: str, time: str, version: int) -> str:
        return f".{file_id}_{time}.log.{version}_0-0-0"

    def _logged(self, partition: str, file_id: str, time: str, version: int) -> None:
        name = self._log_name(file_id, time, version)
        base, logs = self.latest.get((partition, file_id), ("", []))
        logs.append(name)
        self._stat(partition, file_id, name, **({"baseFile": base, "logFiles": [*logs]} if base else {}))

    @staticmethod
    def data_block(rows: pa.Table, instant: str) -> bytes:
        buffer = io.BytesIO()
        pq.write_table(rows, buffer)
        return logfile.frame(logfile.PARQUET_DATA, {logfile.INSTANT_TIME: instant}, buffer.getvalue())

    @staticmethod
    def avro_block(rows: pa.Table, instant: str) -> bytes:
        """The same in Avro; columns of strings, 64-bit integers and doubles, each of which may be null."""
        kinds = {c.name: "string" if pa.types.is_string(c.type) else "double" if pa.types.is_floating(c.type) else "long" for c in rows.schema}
        schema = json.dumps({"type": "record", "name": "row", "fields": [{"name": c, "type": ["null", k]} for c, k in kinds.items()]})
        put = {"string": text, "double": lambda v: struct.pack("<d", v), "long": zigzag}
        records = [b"".join(zigzag(0) if r[c] is None else zigzag(1) + put[k](r[c]) for c, k in kinds.items()) for r in rows.to_pylist()]
        body = struct.pack(">II", logfile.CONTENT_VERSION, len(records)) + b"".join(struct.pack(">I", len(r)) + r for r in records)
        return logfile.frame(logfile.AVRO_DATA, {logfile.INSTANT_TIME: instant, logfile.SCHEMA: schema}, body)

    @staticmethod
    def delete_block(keys: list[tuple[str, int | None]], instant: str) -> bytes:
        """Deletes of (record key, long ordering value)."""
        body = zigzag(len(keys)) + b"".join(zigzag(1) + text(k) + zigzag(0) + (zigzag(0) if v is None else zigzag(2) + zigzag(v)) for k, v in keys) + zigzag(0) if keys else zigzag(0)
        return logfile.frame(logfile.DELETE, {logfile.INSTANT_TIME: instant}, struct.pack(">II", logfile.CONTENT_VERSION, len(body)) + body)

    @staticmethod
    def rollback_block(target: str, instant: str) -> bytes:
        return logfile.frame(logfile.COMMAND, {logfile.INSTANT_TIME: instant, logfile.TARGET_INSTANT_TIME: target, logfile.COMMAND_TYPE: logfile.ROLLBACK}, b"")

    def commit(self, time: str, action: str = "commit", completion: str | None = None, replaced: dict[str, list[str]] | None = None, operation: str = "upsert") -> None:
        """Complete an instant with the files written since the last one."""
        body = {"partitionToWriteStats": self.stats, "extraMetadata": {"schema": self.schema}, "operationType": operation, "partitionToReplaceFileIds": replaced or {}}
        name = f"{time}_{completion or time}.{action}" if self.layout == 2 else f"{time}.{action}"
        self.storage.write(json.dumps(body).encode(), TIMELINE_FOLDER if self.layout == 2 else META_FOLDER, name)
        self.stats = {}

    def archive(self, time: str, action: str = "commit") -> None:
        """Take a completed instant out of the active timeline: to the archive folder (layout 1) or the history (layout 2)."""
        folder = TIMELINE_FOLDER if self.layout == 2 else META_FOLDER
        name = next(f.name for f in self.storage.listing(folder)[0] if f.name.startswith(time) and f.name.endswith("." + action))
        body = self.storage.read(folder, name)
        if self.layout == 2:
            buffer = io.BytesIO()
            pq.write_table(pa.table({"instantTime": [time], "completionTime": [name[len(time) + 1 :].partition(".")[0]], "action": [action], "metadata": [body], "plan": [b""]}), buffer)
            file = f"{time}_{time}_0.parquet"
            self.storage.write(buffer.getvalue(), folder, "history", file)
            self.storage.write(json.dumps({"files": [{"fileName": file, "fileLen": len(buffer.getvalue())}]}).encode(), folder, "history", "manifest_1")
            self.storage.write(b"1", folder, "history", "_version_")
        else:
            self.storage.write(body, folder, "archived", name)
        self.storage.delete(folder, name)

    def metadata_table(self, base: dict[str, dict[str, tuple[int, bool]]], time: str, changes: tuple = (), gzip: bool = False) -> None:
        """A metadata table: (size, deleted) by partition and file name in its base file, then log blocks of (instant, the same)."""
        m = TableWriter(self.spark, self.storage.path(META_FOLDER, "metadata"), "{}", table__name="metadata", table__type="MERGE_ON_READ", table__version="8", table__partition__fields="partition", table__base__file__format="HFILE")

        def index(files: dict[str, dict[str, tuple[int, bool]]], info: dict[str, bytes]) -> bytes:
            return hfile.build({p or ".": metadata_record(p or ".", f) for p, f in files.items()}, info, gzip)

        every = {"__all_partitions__": {p or ".": (0, False) for p in base}}
        m.storage.write(index(base | every, {"schema": METADATA_SCHEMA.encode()}), "files", f"files-0000-0_0-0-0_{time}.hfile")
        m.commit(time, "deltacommit")
        for instant, files in changes:
            m.log("files", "files-0000-0", instant, [logfile.frame(logfile.HFILE_DATA, {logfile.INSTANT_TIME: instant, logfile.SCHEMA: METADATA_SCHEMA}, index(files, {}))])
            m.commit(instant, "deltacommit")


def metadata_record(key: str, files: dict[str, tuple[int, bool]]) -> bytes:
    body = b"".join(text(n) + zigzag(size) + bytes([gone]) for n, (size, gone) in files.items())
    return text(key) + zigzag(2) + zigzag(1) + (zigzag(len(files)) + body if files else b"") + zigzag(0)


def zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def text(s: str) -> bytes:
    return zigzag(len(s.encode())) + s.encode()
