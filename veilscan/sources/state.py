"""The state of a scan that goes on: results as JSON lines in a folder for each scan id, one part for each batch."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

_LABELS = {
    "pii_type": [V.RRN, V.FOREIGN, V.PASSPORT, V.DRIVER, V.PHONE, V.LANDLINE, V.EMAIL],
    "status": [V.EXPOSED, V.MASKED],
    "confidence": [V.CONFIRMED, V.PRESUMED],
    "risk": [V.CRITICAL, V.HIGH, V.MEDIUM, V.LOW],
}


def default_dir() -> str:
    return os.path.join(os.path.expanduser("~"), ".config", "veilscan", "state")


class State:
    def __init__(self, spark: SparkSession, scan_id: str, base: str | None = None):
        if not re.fullmatch(r"[\w\-]+", scan_id):
            raise ValueError(f"a scan id has letters, digits, _ and - only: {scan_id!r}")
        self.spark, self.scan_id = spark, scan_id
        self.root = f"{(base or default_dir()).rstrip('/')}/{scan_id}"
        self.checkpoint = f"{self.root}/checkpoint"

    def write(self, rows: DataFrame, batch: str) -> None:
        """A batch that is written again replaces itself. Its paths follow its results, in a narrow table."""
        rows.select(*V.STATE.names).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.root}/results/batch={batch}")
        done = self.spark.read.schema("path string").option("mode", "DROPMALFORMED").json(f"{self.root}/results/batch={batch}")
        done.filter("path is not null").write.mode("overwrite").parquet(f"{self.root}/done/batch={batch}")

    def exists(self, what: str = "results") -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def paths(self, but: str = "") -> DataFrame:
        """path, of all results but a batch's."""
        if not self.exists("done"):
            return self.results().select("path")
        done = self.spark.read.schema("path string, batch string").parquet(f"{self.root}/done")
        return done.filter(F.col("batch") != but).select("path")

    def results(self) -> DataFrame:
        """Rows of STATE, one for each path; lines that are cut off, lack what they need or have unknown labels don't count."""
        if not self.exists():
            return self.spark.createDataFrame([], V.STATE)
        rows = self.spark.read.schema(V.STATE).option("mode", "DROPMALFORMED").json(f"{self.root}/results/batch=*")
        whole = lambda h: F.reduce(F.array(*[h[k].isin(*v) for k, v in _LABELS.items()], h["snippet"].isNotNull(), h["start"].isNotNull(), h["end"].isNotNull()), F.lit(True), lambda a, x: a & F.coalesce(x, F.lit(False)))
        rows = rows.filter("path is not null").filter(F.forall(F.coalesce("hits", F.array().cast(V.STATE["hits"].dataType)), whole))
        return rows.dropDuplicates(["path"])

    def undone(self, files: DataFrame, batch: str = "") -> DataFrame:
        """files whose path has no result yet, whatever the result was; a batch that runs again does its own anew."""
        return files.join(self.paths(batch), "path", "left_anti")
