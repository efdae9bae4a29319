"""Exact deduplication over a log-structured merge index of digests; DataFrame operations only.

The input is dealt into memtables, by its tasks. A memtable has one row per digest: the identifier that stays and the
number of rows. Before it is flushed, it is probed against the runs that are there: a run whose digests lie outside the
memtable's, or in whose filter none of them is found, is not read. Then it becomes a run: sorted by digest, with its
smallest and largest digest and a filter (two bits a digest, in bitmaps of BITS bits). `fanout` runs of a level are
compacted to one of the next, one row per digest, the smallest (or largest) identifier kept.

Digests that come twice in a memtable or are found in a run are hits. Only hits are looked up in the index in the end,
and their texts are compared byte by byte; digests whose texts differ fall back to grouping by the text itself. All
other rows are groups of their own and are never shuffled.

Edge cases: a null text counts as the empty text; equal rows are equal texts like any other; a null id loses against
any other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, read_table

#: Rows of a memtable at most, and memtables at least.
MEMTABLE_ROWS, MEMTABLES = 500_000_000, 4
#: Bits of one of a filter's bitmaps, and bits that a digest has in all (two are set: some 1 of 70 others passes).
BITS, BITS_EACH = 32_768, 16


@dataclass
class Run:
    """rows: digest, id, n, sorted by digest; low, high: the range of digests; filter: bucket, bits; buckets: how many."""

    rows: DataFrame
    low: bytes
    high: bytes
    filter: DataFrame
    buckets: int


def _either(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _places() -> Column:
    """The two places of a digest in a bitmap, from its own bits."""
    bits = lambda at: F.conv(F.substring(F.hex("digest"), at, 4), 16, 10).cast("bigint") % BITS
    return F.array(bits(17), bits(25))


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("digest"), buckets)


class DigestIndex:
    """The index. keep: 'smallest' or 'largest' identifier stays. fanout: runs on a level before it is compacted."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", fanout: int = 8):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.keep, self.fanout = spark, keep, fanout
        self.scratch = Scratch(spark, "lsm")
        self.levels: list[list[Run]] = [[]]
        #: How many runs probes have read, and how many they have left alone.
        self.read = self.skipped = 0

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def memtable(self, rows: DataFrame) -> DataFrame:
        """rows: digest binary, id bigint and n where rows were counted before. One row per digest, written."""
        n = F.sum("n") if "n" in rows.columns else F.count("*")
        best = (F.min if self.keep == "smallest" else F.max)("id").alias("id")
        return self.scratch.table(rows.groupBy("digest").agg(best, n.cast("bigint").alias("n")).sortWithinPartitions("digest"))

    def flush(self, table: DataFrame, level: int = 0) -> None:
        """A memtable becomes a run; a level that is full, one run of the next."""
        about = table.agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).first()
        if about["n"]:
            buckets = about["n"] * BITS_EACH // BITS + 1
            bits = table.select(_bucket(F.lit(buckets)).alias("bucket"), F.explode(_places()).alias("at"))
            bits = self.scratch.table(bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))
            self.levels[level].append(Run(table, bytes(about["low"]), bytes(about["high"]), bits, buckets))
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """All runs of a level become one sorted run on the next, smallest (or largest) identifiers kept."""
        old, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        if old:
            self.flush(self.memtable(_either([r.rows for r in old])), level + 1)
            self.scratch.drop(*[t for r in old for t in (r.rows, r.filter)])

    def view(self, only: DataFrame | None = None) -> DataFrame:
        """One row per digest over all levels: digest, id, n. only: digests that are asked for (digest)."""
        parts = [r.rows if only is None else r.rows.join(only, "digest", "left_semi") for r in self.runs]
        best = (F.min if self.keep == "smallest" else F.max)("id").alias("id")
        return _either(parts).groupBy("digest").agg(best, F.sum("n").alias("n"))

    def probe(self, table: DataFrame) -> DataFrame | None:
        """digest: those of a memtable that the index holds; None where no run has to be read. All filters are asked at
        once, then only the runs that may hold some digest are read, for those digests alone."""
        span = table.agg(F.min("digest").alias("low"), F.max("digest").alias("high")).first()
        if span["low"] is None:
            return None
        near = {i: r for i, r in enumerate(self.runs) if r.low <= bytes(span["high"]) and bytes(span["low"]) <= r.high}
        self.skipped += len(self.runs) - len(near)
        if not near:
            return None
        sizes = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(r.buckets).cast("bigint").alias("buckets")) for i, r in near.items()])
        asked = table.select("digest", F.inline(sizes)).select("digest", "run", _bucket(F.col("buckets")).alias("bucket"), _places().alias("at"))
        filters = checked(self.scratch.table(_either([r.filter.withColumn("run", F.lit(i)) for i, r in near.items()])))
        byte = lambda at: F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = lambda at: F.pmod(F.floor(byte(at) / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
        maybe = asked.join(filters, ["run", "bucket"]).filter(is_set(F.col("at")[0]) & is_set(F.col("at")[1])).select("run", "digest")
        maybe = self.scratch.table(maybe)
        wanted = {r["run"] for r in maybe.select("run").distinct().collect()}
        self.read += len(wanted)
        self.skipped += len(near) - len(wanted)
        if not wanted:
            return None
        held = [near[i].rows.select("digest").join(checked(self.scratch.table(maybe.filter(F.col("run") == i).select("digest"))), "digest", "left_semi") for i in sorted(wanted)]
        return self.scratch.table(_either(held).distinct())


def _grouped(docs: DataFrame, keep: str, id_col: str, text_col: str, memtables: int, fanout: int) -> DataFrame:
    """id, digest, keep_id, group_size: one row per input row."""
    index = DigestIndex(docs.sparkSession, keep, fanout)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    thin = index.scratch.table(rows.select("id", "digest", F.spark_partition_id().alias("task")))
    number = max(memtables, -(-thin.count() // MEMTABLE_ROWS))
    hits = []
    for i in range(number):
        table = index.memtable(thin.filter(F.col("task") % number == i))
        hits.append(index.scratch.table(table.filter("n > 1").select("digest")))  # a compaction drops the table
        if (seen := index.probe(table)) is not None:
            hits.append(seen)
        index.flush(table)
    if not index.runs:
        return thin.select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    found = checked(index.scratch.table(_either(hits).distinct()))
    groups = checked(index.scratch.table(index.view(found).select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))))
    # the texts of hits, byte by byte
    compared = rows.join(found, "digest", "left_semi").groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
    odd = index.scratch.table(compared.filter("not same").select("digest"))
    size = F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size")
    out = thin.select("id", "digest").join(groups, "digest", "left").select("id", "digest", F.coalesce("keep_id", "id").alias("keep_id"), size)
    if odd.isEmpty():
        return out
    apart = rows.join(odd, "digest", "left_semi")
    best = (F.min if keep == "smallest" else F.max)("id").alias("keep_id")
    by_text = apart.groupBy("digest", "text").agg(best, F.count("*").alias("group_size"))
    apart = apart.join(by_text, ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
    return out.join(odd, "digest", "left_anti").unionByName(apart)


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", memtables: int = MEMTABLES, fanout: int = MEMTABLES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    kept is true on the rows whose id is the group's keep_id (all of them, should an id repeat within a group).
    """
    return _grouped(docs, keep, id_col, text_col, memtables, fanout).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups does not keep; of rows equal in id and text one stays."""
    scratch = Scratch(docs.sparkSession, "dedup")
    groups = scratch.table(_grouped(docs, keep, id_col, text_col, MEMTABLES, MEMTABLES).filter("group_size > 1").withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))))
    go = checked(scratch.table(groups.filter("not kept").select(F.col("id").alias("go_id"), F.col("digest").alias("go_digest")).distinct()))
    twice = scratch.table(groups.filter("kept").groupBy("id", "digest").count().filter("count > 1").select("id", "digest"))
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("own"))
    rows = rows.join(go, F.col(f"row.{id_col}").eqNullSafe(F.col("go_id")) & (F.col("own") == F.col("go_digest")), "left_anti")
    if twice.isEmpty():
        return rows.select("row.*")
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest"))
    once, again = rows.join(twice, same, "left_anti"), rows.join(twice, same, "left_semi")
    again = again.groupBy(F.col(f"row.{id_col}").alias("id"), "own").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(again.select("row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
