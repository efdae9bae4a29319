"""From files to results: extract, detect, filter, and the tables that reports and the state are made of. Each file is
listed, read and recognised once: its row and its findings come from the same pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.extract import texts
from ..sources.folders import listing
from .corp_filter import mark_corp
from .detect import ScanConfig, detect


@dataclass
class Scan:
    """files: path, file_seq, error, encrypted, unreadable, corp_filtered, partial_detection. hits: path, file_seq, det_seq, then the columns of a
    finding, without those that the corporate filter took away."""

    files: DataFrame
    hits: DataFrame


_FILE = ["path", "file_seq", "error", "encrypted", "unreadable", "failed"]
_HIT = [f.name for f in V.STATE["hits"].dataType.elementType]


def scan_rows(extracted: DataFrame, config: ScanConfig) -> DataFrame:
    """extracted: TEXTS. One row per file or unreadable folder (det_seq is -1) and one per finding, from one pass over the
    texts: path, file_seq, error, encrypted, unreadable, partial_detection, det_seq, the columns of a finding,
    corp_dropped. Findings meet by file and spreadsheet column, texts don't move."""
    found = detect(extracted, config=config, keep=_FILE, loc_kind="loc_kind", cells="cells", found="found" if config.python else None, whole=True)
    failed = F.coalesce("failed", F.array().cast("array<string>"))
    partial = F.when(F.size(failed) > 0, F.concat(F.lit(V.PARTIAL), F.array_join(failed, ", ")))
    found = mark_corp(found, "path", "file_seq")
    return found.select("path", "file_seq", F.coalesce("error", partial).alias("error"), "encrypted", F.coalesce("unreadable", F.lit(False)).alias("unreadable"), failed.alias("partial_detection"), "det_seq", *_HIT, "corp_dropped")


def tables(rows: DataFrame) -> Scan:
    """scan_rows(), written before, as two tables; findings stay rows."""
    dropped = rows.filter("det_seq >= 0 and corp_dropped").groupBy("path", "file_seq").agg(F.count("*").cast("int").alias("n"))
    files = rows.filter("det_seq < 0").select("path", "file_seq", "error", "encrypted", "unreadable", "partial_detection")
    files = files.join(dropped, ["path", "file_seq"], "left").withColumn("corp_filtered", F.coalesce("n", F.lit(0))).drop("n")
    return Scan(files, rows.filter("det_seq >= 0 and not corp_dropped").select("path", "file_seq", "det_seq", *_HIT))


def results(rows: DataFrame) -> DataFrame:
    """scan_rows() as one row per file: path, file_seq, error, encrypted, unreadable, partial_detection, corp_filtered, hits
    (array), as the state keeps them. A file's findings meet in one row: reports of large scans take tables()."""
    hit = F.when((F.col("det_seq") >= 0) & ~F.col("corp_dropped"), F.struct("det_seq", "start", *[c for c in _HIT if c != "start"]))
    first = [F.first(c).alias(c) for c in ("error", "encrypted", "unreadable", "partial_detection")]
    out = rows.groupBy("path", "file_seq").agg(*first, F.count_if("corp_dropped").cast("int").alias("corp_filtered"), F.array_sort(F.collect_list(hit)).alias("hits"))
    return out.withColumn("hits", F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in _HIT])))


def split(rows: DataFrame) -> Scan:
    """results() as two tables."""
    hits = rows.select("path", "file_seq", F.posexplode("hits").alias("det_seq", "h")).select("path", "file_seq", "det_seq", "h.*")
    return Scan(rows.drop("hits"), hits)


def from_state(rows: DataFrame) -> Scan:
    """The state's rows (STATE) as two tables; files come in the order of their paths' hashes, which is the same in each
    run, as the state holds no order."""
    full = rows.withColumn("unreadable", F.lit(False)).withColumn("corp_filtered", F.coalesce("corp_filtered", F.lit(0))).withColumn("encrypted", F.coalesce("encrypted", F.lit(False)))
    return split(full.withColumn("file_seq", F.shiftrightunsigned(F.xxhash64("path"), 1)))


def folder_rows(spark: SparkSession, roots: list[str], config: ScanConfig | None = None) -> DataFrame:
    """scan_rows() of all files below the roots. Files and folders that can't be read come from one listing."""
    config = config or ScanConfig()
    found = listing(spark, roots, config.extensions, config.exclude_dirs)
    return scan_rows(texts(found, config.python), config)


def scan_folders(spark: SparkSession, roots: list[str], config: ScanConfig | None = None) -> DataFrame:
    """results() of all files below the roots."""
    return results(folder_rows(spark, roots, config))


def scan_binary(files: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """results() of files at hand: path, content (as spark.read.format('binaryFile') gives them), file_seq if there is one."""
    if "file_seq" not in files.columns:
        files = files.withColumn("file_seq", F.monotonically_increasing_id())
    config = config or ScanConfig()
    return results(scan_rows(texts(files, config.python), config))
