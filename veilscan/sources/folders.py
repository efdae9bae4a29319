"""Folders as a data source: one partition for each folder right below a root, listed by the workers, in sorted order.
Folders that can't be read become rows of their own."""

from __future__ import annotations

import errno
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import values as V

# Why a folder could not be read.
FAILED = "접근 실패: "
REASONS = {errno.ENOENT: "경로 없음", errno.EACCES: "권한 없음", errno.ENOTDIR: "디렉터리가 아님"}


def access_reason(e: OSError) -> str:
    """Never the exception's own text."""
    return FAILED + REASONS.get(e.errno, type(e).__name__)


def excluded(name: str, exclude: list[str]) -> bool:
    return any(x.lower() in name.lower() for x in exclude)


def walk(top: str, extensions: list[str], exclude: list[str], deep: bool = True) -> Iterator[tuple[str, str | None]]:
    """(path, None) for files and (folder, reason) for what can't be read. Links to folders aren't followed."""
    try:
        entries = sorted(os.scandir(top), key=lambda e: e.name)
    except OSError as e:
        yield top, access_reason(e)
        return
    below = []
    for e in entries:
        if e.is_dir():
            if not e.is_symlink() and not excluded(e.name, exclude):
                below.append(e.path)
        elif os.path.splitext(e.name)[1].lower() in extensions:
            yield e.path, None
    for path in below if deep else ():
        yield from walk(path, extensions, exclude)


class _Part(InputPartition):
    def __init__(self, top: str, deep: bool):
        self.top, self.deep = top, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.extensions, self.exclude = (json.loads(options[k]) for k in ("roots", "extensions", "exclude"))

    def partitions(self) -> list[InputPartition]:
        out = []
        for root in self.roots:
            out.append(_Part(root, False))
            try:
                entries = sorted(os.scandir(root), key=lambda e: e.name)
            except OSError:
                continue
            out += [_Part(e.path, True) for e in entries if e.is_dir() and not e.is_symlink() and not excluded(e.name, self.exclude)]
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        for path, reason in walk(part.top, self.extensions, self.exclude, part.deep):
            # names that are not UTF-8 keep their bytes' places
            yield path.encode("utf-8", "replace").decode("utf-8"), reason


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veilscan_folders"

    def schema(self) -> str:
        return "path string, reason string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def listing(spark: SparkSession, roots: list[str], extensions=tuple(V.EXTENSIONS), exclude=tuple(V.EXCLUDED_DIRS)) -> DataFrame:
    """path, reason (null for files), file_seq in the order of roots, folders and names."""
    spark.dataSource.register(Folders)
    options = {"roots": json.dumps(list(roots)), "extensions": json.dumps(sorted(extensions)), "exclude": json.dumps(sorted(exclude))}
    return spark.read.format("veilscan_folders").options(**options).load().withColumn("file_seq", F.monotonically_increasing_id())
