"""What reports are made of: totals, kinds, files at risk, and the rows that fit into a sheet. Inputs are files
(path, file_seq, error, encrypted, unreadable, corp_filtered) and hits (path, file_seq, det_seq, start, pii_type, status)."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .detect import DETECTORS, ScanConfig, describe_detectors

#: What stands for a place that is null: it comes last.
LAST = 2**63 - 1


def exposed() -> Column:
    return F.col("status") == V.EXPOSED


def file_totals(files: DataFrame) -> DataFrame:
    """One row. Folders that could not be read are no files; encrypted files count as neither error nor filtered."""
    readable = ~F.coalesce("unreadable", F.lit(False))
    encrypted = F.coalesce("encrypted", F.lit(False))
    return files.agg(
        F.count_if(readable).alias("total_files"),
        F.count_if(readable & ~encrypted & F.col("error").isNotNull()).alias("error_files"),
        F.count_if(readable & encrypted).alias("encrypted_files"),
        F.count_if(~readable).alias("unreadable_paths"),
        F.coalesce(F.sum(F.when(readable & ~encrypted, F.col("corp_filtered"))), F.lit(0)).cast("bigint").alias("corp_filtered"),
    )


def hit_totals(hits: DataFrame) -> DataFrame:
    """One row: exposed, masked, masking_rate in percent (100 without findings)."""
    n = hits.agg(F.count_if(exposed()).alias("exposed"), F.count_if(~exposed()).alias("masked"))
    rate = F.when(F.col("exposed") + F.col("masked") == 0, 100.0).otherwise(F.try_divide(F.col("masked").cast("double"), (F.col("exposed") + F.col("masked")).cast("double")) * 100.0)
    return n.withColumn("masking_rate", rate)


def by_type(hits: DataFrame) -> DataFrame:
    """pii_type, exposed, masked for kinds that occur."""
    return hits.groupBy("pii_type").agg(F.count_if(exposed()).alias("exposed"), F.count_if(~exposed()).alias("masked"))


def by_type_rollup(hits: DataFrame) -> DataFrame:
    """by_type and, with a null kind, all kinds together, from one pass."""
    return hits.rollup("pii_type").agg(F.count_if(exposed()).alias("exposed"), F.count_if(~exposed()).alias("masked"))


def top_files(hits: DataFrame, n: int = 20) -> DataFrame:
    """The n files with most exposed findings; of equal ones those that come first."""
    out = hits.filter(exposed()).groupBy("path", "file_seq").agg(F.count("*").alias("exposed"))
    return out.orderBy(F.desc("exposed"), "file_seq", "path").limit(n).select("path", "exposed")


def tier() -> Column:
    """0: key kind and exposed, 1: key kind and masked, 2: the rest."""
    return F.when(~F.col("pii_type").isin(*V.KEY_TYPES), 2).when(exposed(), 0).otherwise(1)


def _steps() -> list[dict[str, Column]]:
    """The order of tiers, files and places, coarse to fine. In a group of one step the next has some 2**21 groups at most,
    whether files are counted or numbered by hashes; a group of the last is 2**16 places of a file and detector."""
    file, det, start = (F.coalesce(F.col(c).cast("bigint"), F.lit(LAST)) for c in ("file_seq", "det_seq", "start"))
    return [{"_tier": tier(), "_files": F.shiftright(file, 42)}, {"_block": F.shiftright(file, 21)}, {"_file": file, "_dets": F.shiftright(det, 16)}, {"_det": det, "_starts": F.shiftright(start, 16)}]


def row_budget(hits: DataFrame, cap: int) -> DataFrame:
    """The hits that fit into cap rows: as many of tier 0 as there are, then of tier 1, then of the rest, each in the order
    of files and places. Counts find the group of each step in which the cap is reached; rows beyond it are left where they
    are, and only places of the last group are ranked against the cap, so no task ranks a tier or a file."""
    steps = _steps()
    rows = hits.withColumns({n: c for step in steps for n, c in step.items()})
    within, names = rows.withColumn("_left", F.lit(cap)), []
    for step in steps:
        counts = within.groupBy(*names, "_left", *step).agg(F.count("*").alias("_n"))
        ahead = F.coalesce(F.sum("_n").over(Window.orderBy(*step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        names += step
        # one row: the group that reaches the cap (or else the last one), and how many of its rows fit
        edge = counts.withColumn("_left", F.col("_left") - ahead).filter("_left > 0").orderBy(*map(F.desc, step)).limit(1).drop("_n")
        within = rows.join(F.broadcast(edge), names)
    place, edge = F.struct(*names), edge.select(F.struct(*names).alias("_edge"), "_left")
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.asc_nulls_last("start")))
    kept = rows.join(F.broadcast(edge), place <= F.col("_edge")).withColumn("_rank", rank)
    return kept.filter((place < F.col("_edge")) | (F.col("_rank") <= F.col("_left"))).drop(*names, "_edge", "_left", "_rank")


def error_classes(files: DataFrame) -> DataFrame:
    """path, reason, class of files that have an error or could not be reached; encrypted ones have a list of their own."""
    unreadable = F.coalesce("unreadable", F.lit(False))
    rows = files.filter(unreadable | (~F.coalesce("encrypted", F.lit(False)) & F.col("error").isNotNull()))
    return rows.select("path", F.coalesce("error", F.lit("")).alias("reason"), F.when(unreadable, V.UNREADABLE_CLASS).otherwise(V.FAILED_CLASS).alias("class"))


@dataclass
class Summary:
    total_files: int = 0
    error_files: int = 0
    encrypted_files: int = 0
    exposed: int = 0
    masked: int = 0
    masking_rate: float = 100.0
    corp_filtered: int = 0
    unreadable_paths: int = 0
    scanned_at: str = ""
    tool_version: str = ""
    active_types: tuple = ()
    inactive_types: tuple = ()
    by_type: dict = field(default_factory=dict)


def summarise(files: DataFrame, hits: DataFrame) -> Summary:
    s = Summary(**file_totals(files).first().asDict())
    order = [d.pii_type for d in DETECTORS.values()]
    kinds = {r["pii_type"]: {"exposed": r["exposed"], "masked": r["masked"]} for r in by_type(hits).collect()}
    s.by_type = {t: kinds[t] for t in order if t in kinds}
    s.exposed = sum(k["exposed"] for k in kinds.values())
    s.masked = sum(k["masked"] for k in kinds.values())
    if kinds:
        s.masking_rate = s.masked / (s.exposed + s.masked) * 100.0
    return s


def stamp(s: Summary, config: ScanConfig, now: datetime.datetime | None = None) -> Summary:
    """When, by which version, and for which kinds."""
    s.scanned_at = (now or datetime.datetime.now()).replace(microsecond=0).isoformat()
    s.tool_version = V.VERSION
    active, inactive = describe_detectors(config)
    s.active_types, s.inactive_types = tuple(active), tuple(inactive)
    return s
