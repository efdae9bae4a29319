"""A scan of a paged listing that can be resumed: each batch leaves out what is done, extracts, detects, and writes its
results before its cursor is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import ScanConfig
from ..operators.scan import results, scan_rows
from ..sources.cloud import page_stream, with_content
from ..sources.extract import texts
from ..sources.state import State


def collect(spark: SparkSession, state: State, client: str, options: dict, config: ScanConfig | None = None, workers: int = 8, idle: int = 2) -> None:
    """Runs until `idle` polls in a row bring no new cursor. workers: files that are read at once."""
    config = config or ScanConfig()

    def batch(rows: DataFrame, number: int) -> None:
        todo = state.undone(rows.dropDuplicates(["path"]).withColumn("file_seq", F.monotonically_increasing_id()), f"{number}")
        held = texts(with_content(todo.repartition(workers), client, options), config.python)
        state.write(results(scan_rows(held, config)), f"{number}")

    query = page_stream(spark, client, options, config.extensions).writeStream.foreachBatch(batch).option("checkpointLocation", state.checkpoint).trigger(processingTime="0 seconds").start()
    try:
        same, last = 0, None
        while same < idle and query.isActive:
            query.awaitTermination(1)
            progress = query.lastProgress
            at = progress and (progress["batchId"], progress["sources"][0]["endOffset"])
            same = same + 1 if progress and at == last and not query.status["isTriggerActive"] else 0
            last = at
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
