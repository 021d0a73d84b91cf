"""Tables as a registered data source: ``spark.read.format("tidelake")``, ``CREATE TABLE ... USING tidelake`` and SQL views.

Each query plans the table anew, so new commits are seen. Conjuncts on columns go into planning: partitions, and base
files without log files, that can't hold a row are not read. A partition of the scan is one or more file slices, each
merged within its task, so a merge needs no shuffle; a large slice is merged by parts of its keys, one in memory at a time.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import json
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from ..errors import ConfigError
from ..functions.timestamps import widen
from ..operators.filters import Filter
from ..operators.merge import DEAD
from ..plans.config import APPEND_ONLY, COMMIT_SEQNO, COMMIT_TIME, RECORD_KEY, ReadOptions
from ..plans.groups import FileSlice
from ..table import Table
from . import logfile
from .storage import ArrowStorage, Storage, arrow_fs, open_file

NAME = "tidelake"
#: Where a catalog table keeps its options: in its first column, as Spark hands none to a catalog table's scan.
KEPT = "tidelake.options"
#: A slice's records are merged about so many at a time. Of its log files only the bytes are known: so many to a record.
MERGE_ROWS, LOG_ROW_BYTES = 1 << 18, 32
#: Records that are dealt to parts at once.
DEALT_ROWS = 1 << 16
EXACT, INEXACT, UNSUPPORTED = "exact", "inexact", "unsupported"

COMPARISONS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def literal(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def to_filter(given: ds.Filter) -> Filter | None:
    """Catalyst's conjunct as a filter of this library; None if it has no such form (disjunctions never come here)."""
    if isinstance(given, ds.Not):
        inner = to_filter(given.child)
        return ~inner if inner else None
    name = ".".join(getattr(given, "attribute", ()))
    if isinstance(given, ds.In):
        values = tuple(literal(v) for v in given.value if v is not None)
        return Filter(name, "IN", values) if values and len(values) == len(given.value) else None
    op = COMPARISONS.get(type(given))
    if op is None or given.value is None or isinstance(given.value, bytes | bytearray):
        return None
    return Filter(name, op, (literal(given.value),))


def support(given: ds.Filter, table: Table) -> str:
    """``exact`` if planning and the scan leave no row that fails it (equality on a partition column), ``inexact`` if planning uses it."""
    f = to_filter(given)
    if f is None:
        return UNSUPPORTED
    on_partition = table.config.is_partitioned and not table.config.is_timestamp_keyed and f.column in table.config.partition_fields
    return EXACT if on_partition and f.op == "=" else INEXACT


class Slices(ds.InputPartition):
    """File slices, and the range (start, end] that their rows are limited to."""

    def __init__(self, slices: list[FileSlice], start: str | None, end: str | None) -> None:
        super().__init__(slices)
        self.slices, self.start, self.end = slices, start, end


class TableReader(ds.DataSourceReader):
    """Spark pickles it between planning and tasks; the opened table stays behind."""

    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.source = options
        self.options, self.arrow = read_options(options), arrow_schema(schema)
        self.exact: list[Filter] = []
        config = self.table.config
        self.strategy, self.ordering, self.has_meta = config.merge_strategy, config.ordering_field, config.has_meta_fields
        self.base, self.given = self.table.storage.base, self.table.storage.options()

    @functools.cached_property
    def table(self) -> Table:
        return opened(self.source)

    def __getstate__(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            kind = support(f, self.table)
            if kind != UNSUPPORTED:
                self.options = self.options.with_filters(to_filter(f))
            if kind == EXACT:
                self.exact.append(to_filter(f))
            else:
                yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        slices, start, end = self.table.plan(self.options.resolved(self.table.timezone))
        self.table.check_format(slices)
        n = self.options.input_partitions or len(slices)
        parts: list[list[FileSlice]] = [[] for _ in range(min(n, len(slices)))]
        for s in sorted(slices, key=lambda s: -s.total_size):  # longest first, to the emptiest
            min(parts, key=lambda p: sum(x.total_size for x in p)).append(s)
        return [Slices(p, start, end) for p in parts]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for s in partition.slices if partition else []:
            for b in self._slice(s, partition.start, partition.end):
                for f in self.exact:
                    column = b.column(f.column)
                    b = b.filter(pc.fill_null(pc.equal(column, pa.scalar(f.values[0]).cast(column.type)), False))
                if b.num_rows:
                    yield b

    def _in_range(self, b: pa.RecordBatch, start: str | None, end: str) -> pa.RecordBatch:
        if start is None or not self.has_meta:
            return b
        when = pc.utf8_rpad(b.column(COMMIT_TIME), 17, "0")
        return b.filter(pc.and_(pc.greater(when, widen(start)), pc.less_equal(when, widen(end))))

    def _base(self, s: FileSlice, start: str | None, end: str) -> Iterator[pa.RecordBatch]:
        store, path = arrow_fs(f"{self.base}/{s.base_path}", self.given)
        with store.open_input_file(path) as f:
            source = pq.ParquetFile(f)
            for b in source.iter_batches(1 << 14, columns=[c for c in self.arrow.names if c in source.schema_arrow.names]):
                columns = [logfile.fitted(b.column(c.name), c.type) if c.name in b.schema.names else pa.nulls(b.num_rows, c.type) for c in self.arrow]
                yield self._in_range(pa.record_batch(columns, schema=self.arrow), start, end)

    def _slice(self, s: FileSlice, start: str | None, end: str) -> Iterator[pa.RecordBatch]:
        if not s.logs:
            yield from self._base(s, start, end)
            return
        flagged = self.arrow.append(pa.field(DEAD, pa.bool_()))
        ordering = self.ordering if self.ordering in self.arrow.names else None
        with contextlib.ExitStack() as stack:
            files = [stack.enter_context(open_file(f"{self.base}/{p}", self.given)) for p in s.log_paths]
            logs = logfile.arrow_batches(files, widen(start) if start else "", widen(end), flagged, RECORD_KEY, ordering, COMMIT_TIME, DEAD)
            base = (b.append_column(flagged.field(DEAD), pa.array([False] * b.num_rows, pa.bool_())) for b in self._base(s, start, end))
            if self.strategy == APPEND_ONLY or not ordering:
                for b in itertools.chain(base, logs):
                    yield b.filter(pc.invert(b.column(DEAD))).drop_columns([DEAD])
                return
            with open_file(f"{self.base}/{s.base_path}", self.given) as f:
                n = pq.ParquetFile(f).metadata.num_rows + sum(f.size() for f in files) // LOG_ROW_BYTES
            for rows in parted(itertools.chain(base, logs), flagged, -(-n // MERGE_ROWS) or 1):
                dead, rows = rows.filter(pc.field(DEAD)), rows.filter(~pc.field(DEAD)).drop_columns([DEAD])
                if rows.num_rows:
                    yield from latest_rows(rows, dead, ordering).to_batches(1 << 14)


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Fewer batches, of ``size`` rows at least (but the last)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def parted(batches: Iterable[pa.RecordBatch], schema: pa.Schema, n: int) -> Iterator[pa.Table]:
    """The rows in ``n`` parts by record key, in their order within each; where there are more than one, a temporary file holds them."""
    if n == 1:
        yield pa.Table.from_batches(list(batches), schema)
        return
    places: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    with tempfile.TemporaryFile() as f:
        for b in gathered(batches, DEALT_ROWS):
            part = np.fromiter((hash(k) % n for k in b.column(RECORD_KEY).to_pylist()), np.int64, b.num_rows)
            order = np.argsort(part, kind="stable")
            b, ends = b.take(pa.array(order)), np.searchsorted(part[order], np.arange(n + 1)).tolist()
            for p, (low, high) in enumerate(itertools.pairwise(ends)):
                if low < high:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                        out.write_batch(b.slice(low, high - low))
                    data = sink.getvalue()
                    places[p].append((f.tell(), data.size))
                    f.write(data)
        for own in places:
            held = []
            for at, size in own:
                f.seek(at)
                held.append(pa.ipc.open_stream(f.read(size)).read_next_batch())
            yield pa.Table.from_batches(held, schema).combine_chunks()


def latest_rows(rows: pa.Table, dead: pa.Table, ordering: str) -> pa.Table:
    """operators.merge.latest_wins() for one slice in memory."""
    at = pc.sort_indices(rows.select([RECORD_KEY, ordering, COMMIT_SEQNO]), sort_keys=[(RECORD_KEY, "ascending"), (ordering, "descending"), (COMMIT_SEQNO, "descending")])
    keys = rows.column(RECORD_KEY).take(at).combine_chunks()
    if len(keys) > 1:
        same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False)
        same = pc.or_(same, pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1])))
        at = at.filter(pa.concat_arrays([pa.array([True]), pc.invert(same).combine_chunks() if isinstance(same, pa.ChunkedArray) else pc.invert(same)]))
    rows = rows.take(at)
    if not dead.num_rows:
        return rows
    dead = pa.table({"key": dead.column(RECORD_KEY), "o": dead.column(ordering), "t": pc.utf8_rpad(dead.column(COMMIT_TIME), 17, "0")}).group_by("key").aggregate([("o", "max"), ("t", "max")])
    match = pc.index_in(rows.column(RECORD_KEY), dead.column("key").combine_chunks()).combine_chunks()
    o, t = dead.column("o_max").combine_chunks().take(match), dead.column("t_max").combine_chunks().take(match)
    mine, when = rows.column(ordering).combine_chunks(), pc.utf8_rpad(rows.column(COMMIT_TIME).combine_chunks(), 17, "0")
    later = pc.greater(t, when)
    zero = pc.fill_null(pc.equal(o, pa.scalar(0, o.type)), False) if pa.types.is_integer(o.type) or pa.types.is_floating(o.type) or pa.types.is_decimal(o.type) else pa.array([False] * len(o))
    tie = pc.or_(pc.fill_null(pc.equal(o, mine), False), pc.and_(pc.is_null(o), pc.is_null(mine)))
    ranked = pc.or_kleene(pc.coalesce(pc.greater(o, mine), pc.is_valid(o)), pc.and_kleene(tie, later))
    gone = pc.and_(pc.is_valid(match), pc.fill_null(pc.if_else(zero, later, ranked), False))
    return rows.filter(pc.invert(gone))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read_options(options: dict[str, str]) -> ReadOptions:
    out = ReadOptions()
    for k, v in options.items():
        if k.lower().startswith("hoodie.read."):
            out = out.with_option(k, v)
    return out


def opened(options: dict[str, str]) -> Table:
    """The table that a source's options name, without a session."""
    path = options.get("path") or options.get("location")
    if not path:
        raise ConfigError("the option 'path' must name a table")
    given = {k: v for k, v in options.items() if k.startswith("fs.")}
    return Table.load(None, ArrowStorage(path, given), {k: v for k, v in options.items() if k.startswith("hoodie.")})


class TableSource(ds.DataSource):
    """Options: ``path``, the keys of the format (``hoodie.read.as.of.timestamp`` and so on) and Hadoop's S3 keys."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        own = {k: v for k, v in self.options.items() if k in ("path", "location") or k.startswith(("hoodie.", "fs."))}
        found = opened(own).schema(meta_fields=True)
        first = found.fields[0]
        return T.StructType([T.StructField(first.name, first.dataType, True, {KEPT: json.dumps(own)}), *found.fields[1:]])

    def reader(self, schema: T.StructType) -> TableReader:
        kept = json.loads(next((f.metadata[KEPT] for f in schema if KEPT in (f.metadata or {})), "{}"))
        return TableReader(kept | dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let Catalyst hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)


def create_table(spark: SparkSession, name: str, uri: str, options: dict[str, str] | None = None, if_not_exists: bool = False) -> None:
    """A catalog table over the table at ``uri``; its rows are read anew at each query. The session's S3 keys go along."""
    register(spark)
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    given = Storage(spark, uri).options() | (options or {}) | {"path": uri}
    spark.sql(f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{name} USING {NAME} OPTIONS ({', '.join(f'{quote(k)} {quote(v)}' for k, v in given.items())})")
