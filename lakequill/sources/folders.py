"""Listing folders for a sync: files that start with a dot and links to files are listed too, paths are resolved."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakequill.sources.files import SKIPPED

SCHEMA = "path string, doc_id string, size long, mtime double, hash string"


class Folder(InputPartition):
    """A folder to list: itself alone, or with all below it."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class FolderSource(DataSource):
    """Options: path, extensions (by commas), depth (levels of folders that become partitions), hash (true: MD5 of contents)."""

    @classmethod
    def name(cls) -> str:
        return "lakequill_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return FolderReader(self.options)


def below(path: str) -> list[str]:
    """The folders in a folder that are read; links to folders are left out, as they may lead in circles."""
    with os.scandir(path) as found:
        return sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED and not e.name.startswith("."))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.depth = str(Path(options["path"]).resolve()), int(options.get("depth", "2"))
        self.extensions, self.hashed = tuple(options.get("extensions", ".md,.txt").lower().split(",")), options.get("hash", "true").lower() == "true"

    def partitions(self) -> Sequence[Folder]:
        """A partition for each folder down to `depth`; those at that depth are listed with all below them."""
        level, out = [self.root], []
        for deep in range(self.depth):
            out += [Folder(p, False) for p in level]
            level = [q for p in level for q in below(p)]
        return [*out, *(Folder(p, True) for p in level)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        import hashlib

        todo = [partition.path]
        while todo:
            folder = todo.pop()
            todo += below(folder) if partition.deep else []
            for name in sorted(os.listdir(folder)):
                path = os.path.join(folder, name)
                if not name.lower().endswith(self.extensions) or not os.path.isfile(path):
                    continue
                real, digest = str(Path(path).resolve()), None
                stat = os.stat(real)
                if self.hashed:
                    with open(real, "rb") as f:
                        digest = hashlib.file_digest(f, "md5").hexdigest()
                yield real, hashlib.md5(real.encode()).hexdigest()[:16], stat.st_size, stat.st_mtime, digest


def sync_scan(spark: SparkSession, root: str, extensions: Sequence[str] = (".md", ".txt"), depth: int = 2, hashed: bool = True) -> DataFrame:
    """path, doc_id, size, mtime, hash of the files that a sync sees under root: those with one of the extensions in any
    case, dot-files and links included (under the path that they lead to, once each), except in folders named in SKIPPED
    or starting with a dot. The folder has to be on a file system that the driver and all executors mount."""
    spark.dataSource.register(FolderSource)
    rows = spark.read.format("lakequill_folders").options(path=root, extensions=",".join(extensions), depth=str(depth), hash=str(hashed)).load()
    return rows.dropDuplicates(["path"])
