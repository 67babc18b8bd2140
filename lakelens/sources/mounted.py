"""Inventory of a mounted folder as a Spark data source, for batches and for streams.

``spark.dataSource.register(MountedInventory)``, then ``spark.read`` or
``spark.readStream.format("mounted_inventory").option("library_id", 1).load(folder)``.
Driver and executors must see the folder under one path; stores that only Spark
reads have ``sources.files.inventory``.
"""

from __future__ import annotations

import mimetypes
import os
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.catalog import IGNORED, IGNORED_PREFIXES

SCHEMA = "library_id long, path string, relative_path string, name string, extension string, mime string, size long, mtime_s long, inode long, error string"


@dataclass(frozen=True)
class Folder:
    """A folder to list: ``deep`` with all below it; ``whole``: every file, else those of the window; ``moved``: it changed in the window."""

    path: str
    deep: bool
    whole: bool
    moved: bool


@dataclass
class Share(InputPartition):
    """The folders of one task and the window (after, until] of change times in ns."""

    folders: list[Folder]
    after: int
    until: int


def _kept(name: str) -> bool:
    return name not in IGNORED and not name.startswith(IGNORED_PREFIXES)


def _below(folder: Folder, path: str, after: int, until: int) -> Folder:
    """A child folder; one that arrived in the window (both it and its parent changed in it) is read whole."""
    changed = after < os.stat(path, follow_symlinks=False).st_ctime_ns <= until
    return Folder(path, True, folder.whole or folder.moved and changed, changed)


def shares(root: str, tasks: int, after: int, until: int) -> list[Share]:
    """Folders dealt to tasks: the driver lists upper levels until there are four folders a task, tasks list what is below.

    The driver keeps folders only; a folder whose listing fails is left to a task, which reports it.
    """
    try:
        changed = after < os.stat(root).st_ctime_ns <= until
    except OSError:
        changed = False
    open_, done = deque([Folder(root, True, after <= 0, changed)]), []
    while open_ and len(open_) + len(done) < 4 * tasks:
        at = open_.popleft()
        try:
            with os.scandir(at.path) as entries:
                below = [_below(at, e.path, after, until) for e in entries if _kept(e.name) and e.is_dir(follow_symlinks=False)]
        except OSError:
            done.append(at)
            continue
        open_.extend(below)
        done.append(Folder(at.path, False, at.whole, at.moved))
    folders = [*done, *open_]
    return [Share(folders[i::tasks], after, until) for i in range(min(tasks, len(folders)))]


def listed(share: Share, root: str, library_id: int) -> Iterator[tuple]:
    """A row for each regular file of the share's folders, and one with an error for what cannot be read."""
    stack = list(share.folders)
    while stack:
        at = stack.pop()
        try:
            with os.scandir(at.path) as entries:
                for e in entries:
                    if not _kept(e.name):
                        continue
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if at.deep:
                                stack.append(_below(at, e.path, share.after, share.until))
                        elif e.is_file(follow_symlinks=False):
                            s = e.stat(follow_symlinks=False)
                            # what changes after the window comes in a later one
                            if s.st_ctime_ns <= share.until and (at.whole or s.st_ctime_ns > share.after):
                                extension = os.path.splitext(e.name)[1][1:].lower()
                                yield library_id, e.path, os.path.relpath(e.path, root), e.name, extension, mimetypes.guess_type(e.name)[0], s.st_size, s.st_mtime_ns // 10**9, s.st_ino, None
                    except OSError as bad:
                        yield _failed(e.path, root, library_id, bad)
        except OSError as bad:
            yield _failed(at.path, root, library_id, bad)


def _failed(path: str, root: str, library_id: int, bad: OSError) -> tuple:
    return library_id, path, os.path.relpath(path, root), os.path.basename(path), None, None, None, None, None, bad.strerror or str(bad)


class _Options:
    def __init__(self, options: dict):
        path = options["path"]
        path = path[5:] if path.startswith("file:") else path
        if "://" in path:
            raise ValueError(f"not a mounted folder: {path}")
        self.root = os.path.normpath("/" + path.lstrip("/"))
        self.library_id, self.tasks = int(options.get("library_id", 0)), int(options.get("tasks", 64))
        self.settle_ns = int(float(options.get("settle_s", 2)) * 1e9)


class _Batch(_Options, DataSourceReader):
    def partitions(self):
        return shares(self.root, self.tasks, 0, 2**62)

    def read(self, partition):
        return listed(partition, self.root, self.library_id)


class _Stream(_Options, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle_ns}

    def partitions(self, start: dict, end: dict):
        return shares(self.root, self.tasks, start["until"], end["until"])

    def read(self, partition):
        return listed(partition, self.root, self.library_id)


class MountedInventory(DataSource):
    """Regular files below ``path``; ignored names are left out at every level, links are not followed, contents are not read.

    As a stream, a batch holds what was added, moved in or changed since the
    last one, by the change times that the file system sets: offsets are times,
    ``settle_s`` (2) behind the clock. A folder moved in comes with all its files; a file
    may come again unchanged, which the catalog upsert sees. Files that are gone
    show in a full scan only. What cannot be read is a row with ``error`` and without size.
    Options: ``library_id``, ``tasks`` (64), ``settle_s``.
    """

    @classmethod
    def name(cls) -> str:
        return "mounted_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
