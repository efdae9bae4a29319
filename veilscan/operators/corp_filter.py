"""Corporate-number columns: in a spreadsheet column where most findings of a kind pass the corporate checksum too, those
findings are no personal numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Findings that a column must have, and the share of suspects from which they go.
LEAST, SHARE = 3, 0.7
_CELL = r"(?d)^(.+)!([A-Z]+)\d+$"


def mark_corp(hits: DataFrame, *file: str) -> DataFrame:
    """hits (the columns in file, path by default, location, pii_type, corp_suspect) with a column corp_dropped. Findings outside cells stand for
    themselves: they are dealt out by their place, not gathered by file."""
    letters = F.regexp_extract("location", _CELL, 2)
    cell = F.coalesce(letters != "", F.lit(False))
    column = F.when(cell, F.concat(F.regexp_extract("location", _CELL, 1), F.lit("!"), letters)).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64("location"), F.lit(64)).cast("string")))
    w = Window.partitionBy(*(file or ("path",)), "_column", "pii_type")
    suspects = F.count_if(F.coalesce("corp_suspect", F.lit(False))).over(w)
    n = F.count("*").over(w)
    out = hits.withColumn("_column", column).withColumn("_cell", cell)
    dropped = F.col("_cell") & F.coalesce("corp_suspect", F.lit(False)) & (n >= LEAST) & (suspects / n >= SHARE)
    return out.withColumn("corp_dropped", dropped).drop("_column", "_cell")
