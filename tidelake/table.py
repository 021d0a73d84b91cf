"""Tables: planned on the driver from timeline and listing, read as DataFrames."""

from __future__ import annotations

import contextlib
import io
import logging
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .errors import ConfigError, SchemaError, TableError, UnsupportedError
from .functions.timestamps import widen
from .operators.filters import Filter, as_filter, as_filters, field_type
from .operators.merge import DEAD, SLICE, merge
from .operators.prune import PartitionPruner, file_may_hold, path_field, row_group_ranges
from .plans import groups as plan
from .plans import metadata
from .plans.config import COMMIT_TIME, MERGE_ON_READ, META_FIELDS, META_FOLDER, NOT_PARTITIONS, PROPERTIES_FILE, RECORD_KEY, ReadOptions, TableConfig, parse_properties
from .plans.timeline import Timeline
from .sources import logfile
from .sources.avro import table_schema
from .sources.storage import ARROW_SCHEMES, ArrowStorage, FileInfo, Files, Storage, open_file, scheme, shared_folder

#: Of more base files than this the footers are read by tasks, so many in each.
FOOTERS_HERE = 256
#: Log files are read in as many tasks as there are slices, up to so many.
MOST_LOG_TASKS = 10_000
#: A file's folder and file id: the scope of a merge. Schemes and leading slashes differ between readers.
FOLDER = r"^(?:[A-Za-z0-9+.-]+:)?/*(.*)/[^/]*$"


class TableBuilder:
    """``Table.builder(spark, uri).with_option(...).build()``."""

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self.spark, self.uri, self.options = spark, uri, {}

    def with_option(self, key: str, value: str) -> TableBuilder:
        return self.with_options({key: value})

    def with_options(self, options: dict[str, str]) -> TableBuilder:
        self.options |= {k: v for k, v in options.items() if not k.startswith("hoodie.read.")}
        return self

    def build(self) -> Table:
        for k, v in self.options.items():
            if not k.startswith("hoodie."):
                self.spark._jsc.hadoopConfiguration().set(k, v)
        return Table.load(self.spark, Storage(self.spark, self.uri), self.options)


class Table:
    """``spark`` may be None where a table is only planned, as in a data source's planning process."""

    def __init__(self, spark: SparkSession | None, storage: Files, config: TableConfig) -> None:
        self.spark, self.storage, self.config = spark, storage, config
        self.timeline = Timeline(storage, config)

    @classmethod
    def load(cls, spark: SparkSession | None, storage: Files, options: dict[str, str]) -> Table:
        if not storage.exists(META_FOLDER, PROPERTIES_FILE):
            raise ConfigError(f"{storage.base} has no {META_FOLDER}/{PROPERTIES_FILE}")
        stored = parse_properties(storage.read(META_FOLDER, PROPERTIES_FILE).decode())
        config = TableConfig({k: v for k, v in options.items() if k.startswith("hoodie.") and not k.startswith("hoodie.read.")} | stored)
        if not config.flag("internal.skip.config.validation"):
            config.validate()
        return cls(spark, storage, config)

    @classmethod
    def open(cls, spark: SparkSession, uri: str, options: dict[str, str] | None = None) -> Table:
        return cls.builder(spark, uri).with_options(options or {}).build()

    @staticmethod
    def builder(spark: SparkSession, uri: str) -> TableBuilder:
        return TableBuilder(spark, uri)

    # -- what the table is

    @property
    def name(self) -> str:
        return self.config.name

    @property
    def kind(self) -> str:
        return self.config.kind

    @property
    def is_mor(self) -> bool:
        return self.kind == MERGE_ON_READ

    @property
    def base_url(self) -> str:
        return self.storage.base

    @property
    def timezone(self) -> str:
        return self.config.get("table.timeline.timezone", "utc").lower()

    def avro_schema(self) -> str:
        """From the latest commit that carries one, else the property for tables without commits."""
        if not self.timeline.known:
            if text := self.config.get("table.create.schema"):
                return text
            raise SchemaError("no commit, and no schema in the properties")
        return (self.timeline.metadata(self.timeline.known[-1]).get("extraMetadata") or {}).get("schema") or ""

    def schema(self, meta_fields: bool = False) -> T.StructType:
        if text := self.avro_schema():
            found = table_schema(text)
        else:
            stats = [s for p in (self.timeline.metadata(self.timeline.known[-1]).get("partitionToWriteStats") or {}).values() for s in p or []]
            path = next((s.get("path") for s in stats if (s.get("path") or "").endswith(".parquet")), None)
            if not path:
                raise SchemaError("the latest commit has neither a schema nor a base file")
            found = from_arrow_schema(pq.ParquetFile(io.BytesIO(self.storage.footer(path))).schema_arrow)
        data = [f for f in found if f.name not in META_FIELDS]
        meta = [T.StructField(m, T.StringType()) for m in META_FIELDS] if meta_fields and self.config.has_meta_fields else []
        return T.StructType(meta + data)

    def partition_schema(self) -> T.StructType:
        if not self.config.is_partitioned:
            return T.StructType([])
        if self.config.is_timestamp_keyed:
            return path_field(self.config)
        schema = self.schema()
        return T.StructType([T.StructField(f, field_type(schema, f)) for f in self.config.partition_fields])

    # -- planning

    def _for(self, options: ReadOptions) -> tuple[Table, ReadOptions]:
        """This table with the table options that ``options`` override, and ``options`` with times in its timeline's zone."""
        table = self
        if options.extra:
            table = Table(self.spark, self.storage, TableConfig(self.config.values | options.extra))
        return table, options.resolved(table.timezone)

    @property
    def _workers(self) -> int:
        return int(self.config.get("plan.listing.parallelism", "10"))

    def plan(self, options: ReadOptions) -> tuple[list[plan.FileSlice], str | None, str | None]:
        """File slices and the range (start, end] that their rows are limited to (start None: no limit)."""
        filters = as_filters(options.filters)
        incremental = options.query_type == "incremental"
        end = (options.end if incremental else options.as_of) or self.timeline.latest
        if end is None:
            return [], None, None
        schema = self.schema(meta_fields=True)
        for f in filters:
            field_type(schema, f.column)
        pruner = PartitionPruner(self.config, schema, filters)
        if incremental:
            start, gone = options.range[0], set()
            found = [g for g in plan.written(self.timeline, start, end) if pruner.keeps(g.partition)]
        else:
            start, gone = None, self.timeline.replaced(None, end)
            known = self._known_files(pruner.keeps)
            if known is None and self.config.is_partitioned:
                known = self.storage.leaves(NOT_PARTITIONS, self._workers, pruner.keeps)
            elif known is None:
                known = {"": self.storage.listing("")[0]}
            found = plan.build([(p, f) for p, files in known.items() for f in files], self.timeline)
        out = [s for g in found if (g.partition, g.file_id) not in gone and (s := g.as_of(end))]
        done = self.timeline.completions()
        reads_logs = self.is_mor and not options.read_optimized
        out = [replace(s, logs=[f for f in s.logs if reads_logs and widen(done.get(f.time, f.time) if self.timeline.layout == 1 else f.time) <= widen(end)]) for s in out]
        # Footers tell of base files only: log records may bring values beyond their ranges.
        if filters and not incremental and not reads_logs and self.config.flag("plan.prune.files", True):
            out = self._prune_files(out, filters)
        return out, start, end

    def _prune_files(self, slices: list[plan.FileSlice], filters: list[Filter]) -> list[plan.FileSlice]:
        """The slices whose footers don't rule every row out: read here if they are few, else by tasks. A footer that can't be read rules nothing out."""
        named = sorted({f.column for f in filters})

        def may_hold(footer: bytes) -> bool:
            try:
                return file_may_hold(filters, row_group_ranges(io.BytesIO(footer), named))
            except (pa.ArrowException, OSError):
                return True

        if self.spark is None or len(slices) <= FOOTERS_HERE or scheme(self.storage.base) not in ARROW_SCHEMES:
            with ThreadPoolExecutor(self._workers) as pool:
                kept = list(pool.map(lambda s: may_hold(self.storage.footer(s.base_path)), slices))
            return [s for s, keep in zip(slices, kept, strict=True) if keep]
        base, options = self.storage.base, self.storage.options()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            storage = ArrowStorage(base, options)
            for b in batches:
                yield b.select(["n"]).filter(pa.array([may_hold(storage.footer(p)) for p in b.column("path").to_pylist()], pa.bool_()))

        paths = self.spark.createDataFrame([(n, s.base_path) for n, s in enumerate(slices)], "n int, path string")
        kept = {r["n"] for r in paths.repartition(-(-len(slices) // FOOTERS_HERE)).mapInArrow(run, "n int").collect()}
        return [s for n, s in enumerate(slices) if n in kept]

    @property
    def has_metadata_table(self) -> bool:
        """Whether a metadata table is kept (table version 8 on) and its use isn't switched off."""
        kept = self.config.version >= 8 and metadata.FILES in self.config.names("table.metadata.partitions")
        return kept and self.config.flag("metadata.enable", True)

    def _known_files(self, wanted: Callable[[str], bool]) -> dict[str, list[FileInfo]] | None:
        """Files by ``wanted`` partition from the metadata table; None, so that folders are listed, where there is none or it can't be read."""
        if not self.has_metadata_table:
            return None
        uri = self.storage.path(META_FOLDER, metadata.METADATA_FOLDER)
        try:
            storage = Storage(self.spark, uri) if self.spark else ArrowStorage(uri, self.storage.options())
            own = Table.load(self.spark, storage, {"hoodie.internal.skip.config.validation": "true"})
            return metadata.listing(own.storage, own.timeline, self.storage, wanted)
        except TableError as e:
            logging.getLogger(__name__).warning("listing folders, as the metadata table can't be read: %s", e)
            return None

    def file_slices(self, options: ReadOptions | None = None) -> list[plan.FileSlice]:
        table, options = self._for(options or ReadOptions())
        return table.plan(options)[0]

    def file_slices_splits(self, n: int, options: ReadOptions | None = None) -> list[list[plan.FileSlice]]:
        """At most ``n`` runs of slices of like length."""
        slices = self.file_slices(options)
        size = -(-len(slices) // n) if slices else 1
        return [slices[i : i + size] for i in range(0, len(slices), size)]

    def with_rows(self, slices: list[plan.FileSlice]) -> list[plan.FileSlice]:
        """The slices with their base files' rows, estimated by the bytes a row of the largest one, whose footer is read."""
        if not slices:
            return []
        one = max(slices, key=lambda s: s.size)
        rows = pq.ParquetFile(io.BytesIO(self.storage.footer(one.base_path))).metadata.num_rows
        return [replace(s, rows=rows if s is one else round(rows * s.size / max(1, one.size))) for s in slices]

    def stats(self, options: ReadOptions | None = None) -> tuple[int, int] | None:
        """Estimated (rows, bytes) of all base files; None for incremental reads. plan.groups.totals() sums those of chosen slices."""
        options = options or ReadOptions()
        slices = self.file_slices(options)
        if options.query_type == "incremental" or not slices:
            return None
        return plan.totals(replace(s, logs=[]) for s in self.with_rows(slices))

    # -- reading

    def read(self, options: ReadOptions | None = None) -> DataFrame:
        """A snapshot (latest or as of a time) or what changed in (start, end], filtered and projected."""
        table, options = self._for(options or ReadOptions())
        return table._finished(table._rows(*table.plan(options)), options)

    @staticmethod
    def _finished(df: DataFrame, options: ReadOptions) -> DataFrame:
        """Row filters and projection."""
        schema = df.schema
        for f in map(as_filter, options.filters):
            df = df.where(f if isinstance(f, Column) else f.condition(field_type(schema, f.column)))
        if options.projection is not None:
            for c in options.projection:
                field_type(schema, c)
            df = df.select(*(F.col(".".join(f"`{p}`" for p in c.split("."))) for c in options.projection))
        return df

    def _rows(self, slices: list[plan.FileSlice], start: str | None, end: str | None) -> DataFrame:
        schema = self.schema(meta_fields=True)
        plain, mixed = [s for s in slices if not s.logs], [s for s in slices if s.logs]
        parts = []
        if plain or not mixed:
            parts.append(self._base(plain, schema, start, end))
        if mixed:
            rows = self._base(mixed, schema, start, end, keyed=True).unionByName(self._logs(mixed, schema, start, end))
            parts.append(merge(self.config.merge_strategy, rows, self.config.ordering_field).drop(SLICE, DEAD))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def check_format(self, slices: list[plan.FileSlice]) -> None:
        if bad := {f for s in slices if (f := plan.format_of(s.base, self.config.base_format)) != "parquet"}:
            raise UnsupportedError(f"base files of format {', '.join(sorted(bad))}")

    def _base(self, slices: list[plan.FileSlice], schema: T.StructType, start: str | None, end: str | None, keyed: bool = False) -> DataFrame:
        if not slices:
            return self.spark.createDataFrame([], schema)
        self.check_format(slices)
        df = self.spark.read.schema(schema).parquet(*(self.storage.path(s.base_path) for s in slices))
        if keyed:
            file_id = F.regexp_extract("_metadata.file_name", r"^(.*)_[^_]*_\d+\.[A-Za-z]+$", 1)
            folder = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), FOLDER, 1)
            df = df.select(*schema.fieldNames(), F.concat(folder, F.lit("/"), file_id).alias(SLICE), F.lit(False).alias(DEAD))
        if start is not None and self.config.has_meta_fields:
            low, high, when = widen(start), widen(end), F.rpad(F.col(COMMIT_TIME), 17, "0")
            # The looser bounds on the column itself reach the row groups' statistics; times may have 14 digits or 17.
            df = df.where((F.col(COMMIT_TIME) >= low[:14]) & (F.col(COMMIT_TIME) <= high) & (when > low) & (when <= high))
        return df

    def _logs(self, slices: list[plan.FileSlice], schema: T.StructType, start: str | None, end: str) -> DataFrame:
        """Log records of the slices, deletions flagged: one task for each slice's files, one block in memory at a time."""
        ordering = self.config.ordering_field
        ordering = ordering if ordering in schema.fieldNames() else None
        low, high = widen(start) if start else "", widen(end)
        folder = lambda s: re.sub(FOLDER, r"\1", self.storage.path(s.base_path))
        rows = [(f"{folder(s)}/{s.file_id}", n, p) for s in slices for n, p in enumerate(s.log_paths)]
        own = T.StructType([*schema, T.StructField(DEAD, T.BooleanType())])
        out = T.StructType([*own, T.StructField(SLICE, T.StringType())])
        options = self.storage.options()
        # Spark's file sources skip names that begin with a dot, as log files' do, so tasks open them by Arrow's file
        # systems. What these don't know is copied to the shared folder first, under other names.
        copied = scheme(self.storage.base) not in ARROW_SCHEMES
        if copied:
            folder_of_copies = f"{shared_folder(self.spark)}/tidelake-logs-{uuid.uuid4().hex}"
            paths = Storage(self.spark, self.storage.base).copy_to([p for *_, p in rows], folder_of_copies, self._workers)
            located = self.spark.createDataFrame([(s, n, p.rpartition("/")[2]) for (s, n, _), p in zip(rows, paths, strict=True)], f"{SLICE} string, n int, name string")
            read = self.spark.read.format("binaryFile").load(folder_of_copies).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
            located = located.join(read, "name").select(SLICE, "n", "content")
        else:
            located = self.spark.createDataFrame([(s, n, self.storage.path(p)) for s, n, p in rows], f"{SLICE} string, n int, path string")

        def per_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            target, held, now = to_arrow_schema(own), [], None

            def of_slice() -> Iterator[pa.RecordBatch]:
                with contextlib.ExitStack() as stack:
                    files = [io.BytesIO(f) if copied else stack.enter_context(open_file(f, options)) for _, f in sorted(held, key=lambda p: p[0])]
                    for b in logfile.arrow_batches(files, low, high, target, RECORD_KEY, ordering, COMMIT_TIME, DEAD):
                        yield b.append_column(SLICE, pa.array([now] * b.num_rows, pa.string()))

            for batch in batches:
                for s, n, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and s != now:
                        yield from of_slice()
                        held.clear()
                    now = s
                    held.append((n, f))
            if held:
                yield from of_slice()

        return located.repartition(min(len(slices), MOST_LOG_TASKS), SLICE).sortWithinPartitions(SLICE).mapInArrow(per_slice, out)

    def read_stream(self, options: ReadOptions | None = None) -> Iterator[pa.RecordBatch]:
        """The snapshot in Arrow batches of at most ``batch_size`` rows, partition by partition."""
        options = options or ReadOptions()
        if options.query_type == "incremental":
            raise UnsupportedError("incremental reads in batches")
        return self._batches(self.read(options), options.batch_size)

    @staticmethod
    def _batches(df: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

        for row in df.mapInArrow(packed, "data binary").toLocalIterator(prefetchPartitions=True):
            batch = pa.ipc.open_stream(row.data).read_next_batch()
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == size:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def read_file_slice(self, file_slice: plan.FileSlice, options: ReadOptions | None = None) -> DataFrame:
        """One slice alone, merged, filtered and projected as in read(); without its log files if read-optimised. Times of ``options`` don't matter but as_of."""
        table, options = self._for(options or ReadOptions())
        if options.read_optimized:
            file_slice = replace(file_slice, logs=[])
        return table._finished(table._rows([file_slice], None, options.as_of or table.timeline.latest), options)

    def read_file_slice_stream(self, file_slice: plan.FileSlice, options: ReadOptions | None = None) -> Iterator[pa.RecordBatch]:
        """The same in Arrow batches of at most ``batch_size`` rows."""
        options = options or ReadOptions()
        return self._batches(self.read_file_slice(file_slice, options), options.batch_size)

    def read_file_slice_from_paths(self, base: str, logs: Iterable[str] = (), options: ReadOptions | None = None) -> DataFrame:
        """One slice by the paths of its files, relative to the table."""
        folder, _, name = base.rpartition("/")
        file_id, time = plan.parse_base(name) or ("", "")
        if not file_id:
            raise ConfigError(f"not the name of a base file: {name}")
        found = [plan.parse_log(p.rpartition("/")[2]) for p in logs]
        if None in found:
            raise ConfigError("not the name of a log file")
        return self.read_file_slice(plan.FileSlice(folder, file_id, time, name, logs=found), options)

    # -- SQL

    def create_view(self, name: str, options: ReadOptions | None = None) -> DataFrame:
        """Register the table for spark.sql(); Catalyst prunes columns and pushes filters into base file scans."""
        df = self.read(options)
        df.createOrReplaceTempView(name)
        return df
