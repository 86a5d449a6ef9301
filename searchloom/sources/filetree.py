"""Scans of folder trees.

`FileTree` is a Python data source: one partition for each folder at the top of the tree, so walks run side by side. Where a tree is in a store
that Spark reads itself, `binary_files` lists and reads it with Spark's own source.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from searchloom.functions.files import base_name, excluded, extension, glob_regex

SCHEMA = "root string, path string, name string, ext string, size long, created_time long, modified_time long, unreadable boolean"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.masks = [re.compile(glob_regex(m)) for m in options.get("masks", "").split(";") if m]

    def masked(self, name: str) -> bool:
        return (name.startswith("~$") and len(name) > 2) or any(m.match(name) for m in self.masks)

    def partitions(self) -> list[InputPartition]:
        try:
            top = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not self.masked(e.name)]
        except OSError:
            top = []
        return [_Folder(self.root, False), *(_Folder(p, True) for p in sorted(top))]

    def _row(self, path: str, st: os.stat_result) -> tuple:
        name = os.path.basename(path)
        born = getattr(st, "st_birthtime", 0)
        return (self.root, path, name, os.path.splitext(name)[1], st.st_size, int(born), int(st.st_mtime // 1), False)

    def read(self, partition: _Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            try:
                entries = list(os.scandir(folder))
            except OSError:
                yield (self.root, folder, os.path.basename(folder), "", None, None, None, True)
                continue
            for e in entries:
                if self.masked(e.name):
                    continue
                try:
                    if e.is_symlink():
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep:
                            todo.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        yield self._row(e.path, e.stat(follow_symlinks=False))
                except OSError:
                    yield (self.root, e.path, e.name, "", None, None, None, True)


class FileTree(DataSource):
    """spark.read.format("filetree").option("masks", "*.tmp;node_modules").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, masks: list[str] | None = None) -> DataFrame:
    """Files below a root, and rows with unreadable = true for folders and files that could not be read."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("masks", ";".join(masks or [])).load(root)


def available(root: str) -> bool:
    return os.path.isdir(root)


def stat_file(path: str, root: str, masks: list[str] | None = None) -> tuple | None:
    """One file's row, or None if it is missing, no regular file, or masked below its root."""
    r = _Reader({"path": root, "masks": ";".join(masks or [])})
    below = os.path.relpath(path, root).split(os.sep)
    try:
        st = os.lstat(path)
    except OSError:
        return None
    return r._row(path, st)[:-1] if stat.S_ISREG(st.st_mode) and not any(map(r.masked, below)) else None


def binary_files(spark: SparkSession, root: str, masks: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(root, path, name, ext, size, modified_time, content) by Spark's own reader, which prunes content where it isn't used.

    That reader skips names that begin with a dot or an underscore; `scan` lists them.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", glob) if glob else r).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    df = df.select(F.lit(root).alias("root"), path.alias("path"), base_name(path).alias("name"), extension(base_name(path)).alias("ext"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_time"), "content")
    return df.where(~excluded(F.substr(F.col("path"), F.lit(len(root) + 2), F.length("path")), masks or []))


VOLUMES = "root string, label string, type string, total_bytes long, free_bytes long"
# File systems by kind of volume.
_NETWORK, _LOCAL = {"nfs", "nfs4", "cifs", "smb3", "smbfs", "sshfs", "fuse.sshfs", "afs", "9p"}, {"ext2", "ext3", "ext4", "xfs", "btrfs", "zfs", "f2fs", "ntfs", "ntfs3", "fuseblk", "overlay"}
_REMOVABLE = {"vfat", "exfat", "iso9660", "udf"}


def volumes(spark: SparkSession, mounts: str = "/proc/mounts") -> DataFrame:
    """Mounted volumes; octal escapes in their paths are undone."""
    rows = []
    try:
        with open(mounts, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        lines = []
    for line in lines:
        device, root, kind, *_ = line.split(" ")
        root = re.sub(r"\\([0-7]{3})", lambda m: chr(int(m[1], 8)), root)
        label = "Network" if kind in _NETWORK else "Removable" if kind in _REMOVABLE else "Local" if kind in _LOCAL else None
        if label is None:
            continue
        try:
            v = os.statvfs(root)
        except OSError:
            continue
        rows.append((root, device, label, v.f_frsize * v.f_blocks, v.f_frsize * v.f_bavail))
    return spark.createDataFrame(rows, VOLUMES)
