"""Files of a table: by the Hadoop file system API on the driver, by Arrow's file systems where there is no JVM (tasks, data source planning)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import SparkSession

from ..errors import ConfigError

#: Where a local master, as in tests, keeps what would go to the shared folder.
LOCAL_FOLDER = "/tmp/checkpoints"
#: Bytes read first for a footer; a second read follows if it is longer.
FOOTER_GUESS = 1 << 16
#: Schemes that Arrow opens within tasks; log files of any other are copied to the shared folder for Spark to read.
ARROW_SCHEMES = {"", "file", "s3", "s3a", "s3n", "gs"}
#: Options of Arrow's S3 file system by Hadoop's keys (fixed values).
S3_KEYS = {"access_key": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token", "endpoint_override": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region"}


@dataclass(frozen=True)
class FileInfo:
    path: str
    name: str
    size: int


def scheme(uri: str) -> str:
    head, sep, _ = uri.partition(":")
    return head.lower() if sep and "/" not in head else ""


class Files:
    """A folder tree; paths are relative to ``base``."""

    base: str

    def path(self, *parts: str) -> str:
        return "/".join([self.base, *(p.strip("/") for p in parts if p)])

    def exists(self, *parts: str) -> bool:
        raise NotImplementedError

    def read(self, *parts: str) -> bytes:
        raise NotImplementedError

    def listing(self, *parts: str) -> tuple[list[FileInfo], list[str]]:
        """Files (checksum files left out) and names of folders; nothing where there is no such folder."""
        raise NotImplementedError

    def end(self, length: int, *parts: str) -> bytes:
        """At most the last ``length`` bytes."""
        raise NotImplementedError

    def footer(self, *parts: str) -> bytes:
        """The end of a Parquet file, from its metadata on; pyarrow reads the metadata from that alone."""
        data = self.end(FOOTER_GUESS, *parts)
        need = int.from_bytes(data[-8:-4], "little") + 8
        return data[-need:] if need <= len(data) else self.end(need, *parts)

    def leaves(self, skip: set[str], workers: int, wanted: Callable[[str], bool] = lambda _: True) -> dict[str, list[FileInfo]]:
        """Files by relative folder without folders below, '' for a flat tree; names in ``skip`` are left out at the top.

        Each folder is listed once, those of a level at the same time; the files of leaves that aren't ``wanted`` are left out.
        """
        out, todo = {}, [""]
        with ThreadPoolExecutor(workers) as pool:
            while todo:
                deeper: list[str] = []
                for here, (files, dirs) in zip(todo, pool.map(self.listing, todo), strict=True):
                    dirs = [d for d in dirs if here or d not in skip]
                    deeper += [f"{here}/{d}" if here else d for d in dirs]
                    if not dirs and wanted(here):
                        out[here] = files
                todo = deeper
        return out


class Storage(Files):
    """Any store that Spark reads."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.base = base.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        # The file system classes stand beside the package of the session's configuration class.
        package = self.conf.getClass().getPackage().getName().split(".")[:-1]
        self.api = reduce(getattr, [*package, "fs"], spark._jvm)
        self.fs = self.api.Path(self.base).getFileSystem(self.conf)

    def _p(self, *parts: str) -> Any:
        return self.api.Path(self.path(*parts))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._p(*parts))

    def read(self, *parts: str) -> bytes:
        stream = self.fs.open(self._p(*parts))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def end(self, length: int, *parts: str) -> bytes:
        path = self._p(*parts)
        size = self.fs.getFileStatus(path).getLen()
        stream = self.fs.open(path)
        try:
            stream.seek(max(0, size - length))
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, data: bytes, *parts: str) -> None:
        self.write_all([data], *parts)

    def write_all(self, pieces: Iterable[bytes], *parts: str) -> None:
        """A file of several pieces, one in memory at a time."""
        stream = self.fs.create(self._p(*parts), True)
        try:
            for data in pieces:
                stream.write(bytearray(data))
        finally:
            stream.close()

    def make(self, *parts: str) -> None:
        """A folder, with those above it."""
        self.fs.mkdirs(self._p(*parts))

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._p(new).getParent())
        if not self.fs.rename(self.api.Path(old), self._p(new)):
            raise OSError(f"can't rename {old}")

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._p(*parts), True)

    def listing(self, *parts: str) -> tuple[list[FileInfo], list[str]]:
        here = self._p(*parts)
        if not self.fs.exists(here):
            return [], []
        files, dirs = [], []
        for s in self.fs.listStatus(here):
            name = s.getPath().getName()
            if s.isDirectory():
                dirs.append(name)
            elif not name.endswith(".crc"):
                files.append(FileInfo(s.getPath().toString(), name, s.getLen()))
        return sorted(files, key=lambda f: f.name), sorted(dirs)

    def copy_to(self, names: Iterable[str], folder: str, workers: int) -> list[str]:
        """Copies of the files ``names`` in ``folder`` (of any store), under names that Spark's sources don't skip."""
        other = self.api.Path(folder).getFileSystem(self.conf)

        def one(name: str) -> str:
            out = f"{folder}/{uuid.uuid4().hex}"
            self.api.FileUtil.copy(self.fs, self._p(name), other, self.api.Path(out), False, self.conf)
            return out

        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(one, names))

    def options(self) -> dict[str, str]:
        """What Arrow's file systems need to know of the session's configuration."""
        return {k: v for k in (*S3_KEYS.values(), "fs.s3a.connection.ssl.enabled") if (v := self.conf.get(k))}


def arrow_fs(uri: str, options: dict[str, str]) -> tuple[Any, str]:
    """Arrow's file system for a URI, and the path in it; ``options`` have Hadoop's keys."""
    from pyarrow import fs

    kind = scheme(uri)
    if kind in ("s3", "s3a", "s3n"):
        given = {k: options[key] for k, key in S3_KEYS.items() if options.get(key)}
        if options.get("fs.s3a.connection.ssl.enabled") == "false":
            given["scheme"] = "http"
        return fs.S3FileSystem(**given), uri.split("://", 1)[1]
    if kind in ("", "file"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class ArrowStorage(Files):
    """Where there is no JVM: what Arrow's file systems open."""

    def __init__(self, base: str, options: dict[str, str]) -> None:
        self.base, self.given = base.rstrip("/"), options
        self.fs, self.root = arrow_fs(self.base, options)

    def options(self) -> dict[str, str]:
        return self.given

    def _at(self, *parts: str) -> str:
        return "/".join([self.root, *(p.strip("/") for p in parts if p)])

    def exists(self, *parts: str) -> bool:
        return bool(self.fs.get_file_info(self._at(*parts)).type)

    def read(self, *parts: str) -> bytes:
        with self.fs.open_input_stream(self._at(*parts)) as f:
            return f.read()

    def end(self, length: int, *parts: str) -> bytes:
        with self.fs.open_input_file(self._at(*parts)) as f:
            f.seek(max(0, f.size() - length))
            return f.read()

    def listing(self, *parts: str) -> tuple[list[FileInfo], list[str]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self._at(*parts), allow_not_found=True))
        files = [FileInfo(self.path(*parts, f.base_name), f.base_name, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.endswith(".crc")]
        return sorted(files, key=lambda f: f.name), sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


def open_file(path: str, options: dict[str, str]) -> Any:
    """A seekable file, opened within a task."""
    store, name = arrow_fs(path, options)
    return store.open_input_file(name)


def create_file(path: str, options: dict[str, str]) -> Any:
    """A new file to write to, opened within a task."""
    store, name = arrow_fs(path, options)
    return store.open_output_stream(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a local master may do without the setting."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_FOLDER
