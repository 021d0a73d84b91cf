"""Table properties and read options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import ConfigError, UnsupportedError
from ..functions.timestamps import EARLIEST, normalise
from ..operators.filters import as_filter

# Fixed values of the format: folders, property keys and defaults.
META_FOLDER, TIMELINE_FOLDER = ".hoodie", ".hoodie/timeline"  # the latter unless configured otherwise
NOT_PARTITIONS = {".hoodie", "_delta_log", "metadata"}
PROPERTIES_FILE = "hoodie.properties"
META_FIELDS = ("_hoodie_commit_time", "_hoodie_commit_seqno", "_hoodie_record_key", "_hoodie_partition_path", "_hoodie_file_name")
COMMIT_TIME, COMMIT_SEQNO, RECORD_KEY, PARTITION_PATH, FILE_NAME = META_FIELDS
REQUIRED = ("hoodie.table.name", "hoodie.table.type", "hoodie.table.version")
VERSIONS = {6: 1, 8: 2, 9: 2}  # table version to timeline layout
COPY_ON_WRITE, MERGE_ON_READ = "COPY_ON_WRITE", "MERGE_ON_READ"
APPEND_ONLY, LATEST_WINS = "APPEND_ONLY", "OVERWRITE_WITH_LATEST"
TYPES = {"cow": COPY_ON_WRITE, "copy_on_write": COPY_ON_WRITE, "mor": MERGE_ON_READ, "merge_on_read": MERGE_ON_READ}


def parse_properties(text: str) -> dict[str, str]:
    out = {}
    for line in map(str.strip, text.splitlines()):
        if line and line[0] not in "#!":
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip().replace("\\:", ":").replace("\\=", "=")
    return out


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise ConfigError(f"neither true nor false: {text}")
    return text.lower() == "true"


@dataclass(frozen=True)
class TableConfig:
    values: dict[str, str]

    def get(self, key: str, default: str = "") -> str:
        return self.values.get(f"hoodie.{key}", default)

    def flag(self, key: str, default: bool = False) -> bool:
        return _flag(self.get(key, str(default)))

    def names(self, key: str) -> list[str]:
        return [x.strip().split(":")[0] for x in self.get(key).split(",") if x.strip()]

    @property
    def name(self) -> str:
        return self.get("table.name")

    @property
    def kind(self) -> str:
        try:
            return TYPES[self.get("table.type").lower().replace("-", "_")]
        except KeyError:
            raise ConfigError(f"table type {self.get('table.type')!r}") from None

    @property
    def version(self) -> int:
        return int(self.get("table.version"))

    @property
    def layout(self) -> int:
        return int(self.get("timeline.layout.version") or VERSIONS.get(self.version, 1))

    @property
    def base_format(self) -> str:
        """As configured; empty if files tell by their extensions."""
        return self.get("table.base.file.format").lower()

    @property
    def partition_fields(self) -> list[str]:
        return self.names("table.partition.fields")

    @property
    def ordering_field(self) -> str | None:
        fields = self.names("table.ordering.fields") or self.names("table.precombine.field")
        if len(fields) > 1:
            raise UnsupportedError("more than one ordering field")
        return fields[0] if fields else None

    @property
    def has_meta_fields(self) -> bool:
        return self.flag("populate.meta.fields", True)

    @property
    def merge_strategy(self) -> str:
        said = self.get("table.record.merge.strategy").upper()
        if said in (APPEND_ONLY, LATEST_WINS):
            return said
        return LATEST_WINS if self.has_meta_fields and self.ordering_field else APPEND_ONLY

    @property
    def key_generator(self) -> str:
        return (self.get("table.keygenerator.class") or self.get("table.keygenerator.type")).rpartition(".")[2].upper()

    @property
    def is_partitioned(self) -> bool:
        return bool(self.partition_fields) and not self.key_generator.startswith(("NONPARTITIONED", "NON_PARTITION"))

    @property
    def is_timestamp_keyed(self) -> bool:
        return self.key_generator.startswith("TIMESTAMP") and self.is_partitioned

    def validate(self) -> None:
        for key in REQUIRED:
            if not self.values.get(key):
                raise ConfigError(f"{key} is missing")
        if self.version not in VERSIONS:
            raise UnsupportedError(f"table version {self.version}")
        if self.layout != VERSIONS[self.version]:
            raise ConfigError(f"timeline layout {self.layout} in table version {self.version}")
        if self.flag("datasource.write.drop.partition.columns"):
            raise UnsupportedError("partition columns that aren't in the files")
        if self.base_format not in ("", "parquet"):
            raise UnsupportedError(f"base files of format {self.base_format}")
        if self.merge_strategy == LATEST_WINS and not (self.has_meta_fields and self.ordering_field):
            raise ConfigError(f"{LATEST_WINS} needs meta fields and an ordering field")
        _ = self.kind


@dataclass(frozen=True)
class ReadOptions:
    """What to read; each ``with_`` method returns a changed copy."""

    query_type: str = "snapshot"
    as_of: str | None = None
    start: str | None = None
    end: str | None = None
    filters: tuple = ()
    projection: tuple[str, ...] | None = None
    read_optimized: bool = False
    batch_size: int = 1024
    #: File slices are read as at most so many partitions by the data source; 0: one partition a slice.
    input_partitions: int = 0
    #: Table options that hold for this read, by their full keys.
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.query_type not in ("snapshot", "incremental"):
            raise ConfigError(f"query type {self.query_type!r}")
        if self.batch_size <= 0:
            raise ConfigError("the batch size must be positive")

    def with_query_type(self, kind: str) -> ReadOptions:
        return replace(self, query_type=kind.lower())

    @staticmethod
    def _time(text: str) -> str:
        """Checked here; read in the zone of the table's timeline when the table is."""
        normalise(text)
        return text

    def with_as_of(self, timestamp: str) -> ReadOptions:
        return replace(self, as_of=self._time(timestamp))

    def with_start(self, timestamp: str) -> ReadOptions:
        return replace(self, start=self._time(timestamp))

    def with_end(self, timestamp: str) -> ReadOptions:
        return replace(self, end=self._time(timestamp))

    def with_filters(self, *filters: Any) -> ReadOptions:
        return replace(self, filters=self.filters + tuple(map(as_filter, filters)))

    def with_projection(self, *columns: str) -> ReadOptions:
        return replace(self, projection=tuple(columns))

    def with_read_optimized(self, on: bool = True) -> ReadOptions:
        return replace(self, read_optimized=on)

    def with_batch_size(self, n: int) -> ReadOptions:
        return replace(self, batch_size=n)

    def with_option(self, key: str, value: str) -> ReadOptions:
        """By the key of the format, as ``hoodie.read.as.of.timestamp``; other keys of the format override the table's for this read."""
        known = {
            "query.type": self.with_query_type,
            "as.of.timestamp": self.with_as_of,
            "start.timestamp": self.with_start,
            "end.timestamp": self.with_end,
            "use.read_optimized.mode": lambda v: self.with_read_optimized(_flag(v)),
            "stream.batch_size": lambda v: self.with_batch_size(int(v)),
            "input.partitions": lambda v: replace(self, input_partitions=int(v)),
            "file.slice.read.concurrency": lambda v: self,  # Spark has tasks for that
        }
        if act := known.get(key.removeprefix("hoodie.read.")):
            return act(value)
        if not key.startswith("hoodie.") or key.startswith("hoodie.read."):
            raise ConfigError(f"no read option {key!r}")
        return replace(self, extra={**self.extra, key: value})

    def resolved(self, zone: str) -> ReadOptions:
        """With all times as instants of the timeline's zone."""
        at = lambda t: normalise(t, zone) if t else t
        return replace(self, as_of=at(self.as_of), start=at(self.start), end=at(self.end))

    @property
    def range(self) -> tuple[str, str | None]:
        return self.start or EARLIEST, self.end
