"""What the operators share: reading tables, tables in the shared folder, stable sampling."""

from __future__ import annotations

import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import delete, shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written under the shared folder, so that lost executors cost no lineage.

    A table stays until drop() takes it; what a returned DataFrame still reads must stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self) -> str:
        return f"{self.root}/{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._scratch_path)


#: Bytes of rows, as they are held in memory, up to which a table is broadcast.
BROADCAST = 48_000_000
_BYTES = {"boolean": 1, "tinyint": 1, "int": 4, "bigint": 8, "double": 8}


def checked(table: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A written table, to be broadcast if its rows come to no more than so many bytes; else its joins shuffle. The size
    is a sum over all rows: 16 bytes a row, a fixed width for each number, and the lengths of strings and binaries."""
    width = F.lit(16 + sum(_BYTES.get(t, 16) for _, t in table.dtypes)).cast("bigint")
    for name, kind in table.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    size = table.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def unit_hash(*cols: str, salt: str = "") -> Column:
    """A uniform number in [0, 1) that depends on the columns' values alone."""
    return (F.xxhash64(*[F.col(c) for c in cols], F.lit(salt)).cast("double") / F.lit(2.0**64)) + F.lit(0.5)


def slices(batches, most: int = 512):
    """Arrow batches of no more than so many rows, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a worker process keeps for an operator from task to task."""
    return _kept.setdefault(owner, {})


def alone(owner: str) -> None:
    """In a worker's task: what the worker keeps for other operators goes."""
    others = [held for name, held in _kept.items() if name != owner and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()  # a codec and its cache name each other


def let_go() -> None:
    """Memory that this process has freed goes back to the system; Arrow's pool and malloc would keep it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc alone has it
        trim(0)


def lean(run):
    """A worker's function of batches, with freed memory let go after each batch that it makes and at its end: a worker
    outlives its task, and what it keeps adds to the executor's memory in all steps that follow."""

    def lean_run(batches):
        for b in run(batches):
            yield b
            del b
            let_go()
        let_go()

    return lean_run


def blocks(texts: list, ids: list, max_chars: int = 1_500_000):
    """Runs of whole texts of about max_chars characters, so that a batch's tokens never fill the memory."""
    held, hid, n = [], [], 0
    for t, i in zip(texts, ids, strict=True):
        held.append(t)
        hid.append(i)
        n += len(t or "")
        if n >= max_chars:
            yield held, hid
            held, hid, n = [], [], 0
    if held:
        yield held, hid
