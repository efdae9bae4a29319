"""Mixing sources to target weights by weighted fair queueing; DataFrame operations only.

Each source's documents are shuffled by a digest of id and text and queued for up to `repeats` rounds. The virtual finish time of
a copy is its source's words queued up to it and with it, divided by the source's target. All copies form one queue,
ordered by that time over all sources (ties by the source's place), and are taken as long as the words so far are within
the total budget, which is the sum of all sizes.

A unit of virtual time holds about as many words wherever it lies, so the queue is ranged by time into buckets of equal
width. Their sums say in which of them the budget ends; that one is sorted, and its last copy within the budget is the
cut for all copies. Texts don't move for that; mixed() then sorts the copies taken, with their rows, by time.

The running sums of a source are made in buckets of its shuffle order, more of them for larger sources, so that no
source is summed in one task: sums per bucket, running sums of those, then running sums within a bucket. Sources are
ranked in one task: a row for each.

Edge cases: a null text has size 0; a document of size 0 is never taken; a null source is a source, after all others;
rows equal in all columns are separate documents, and copies are theirs by row; ids may repeat or be null; an empty table
gives an empty result; other columns are ignored by queue() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, checked, read_table

#: Documents that a bucket of the shuffle order has on average.
BUCKET_ROWS = 4096
REPEATS = 3
#: Buckets of virtual time whose sums are added up together.
SUMS = 1024


def n_words(text: Column) -> Column:
    """The number of runs of characters other than the six ASCII white spaces: each run becomes one letter."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("bigint")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sizes: source, source_size, n. Adds rank, weight, total and target: weights 1, 2, 3 in turn by the sources' order; shares of
    the total, none above repeats times its source's size. Sources come by the ratio of that bound to their weight, so
    those at their bound are a prefix of that order; what a prefix leaves is dealt to the rest by weight."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("bigint"))
    w = w.withColumn("most", F.col("source_size") * repeats)
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest"),
    )
    level = (F.col("total") - F.col("full")).cast("double") / F.col("rest").cast("double")
    w = w.withColumn("open", F.col("most").cast("double") > F.col("weight").cast("double") * level)
    first = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("full"), F.col("rest")))).over(everything)
    w = w.withColumn("cut", first)
    share = F.col("weight").cast("double") * ((F.col("total") - F.col("cut.full")).cast("double") / F.col("cut.rest").cast("double"))
    bound = F.col("most").cast("double")
    return w.select("source", "rank", "source_size", "n", "weight", "total", F.when(F.col("cut").isNull(), bound).otherwise(F.least(bound, share)).alias("target"))


def _queued(rows: DataFrame, repeats: int, scratch: Scratch) -> DataFrame:
    """rows: doc_id, source, size, place and others. Adds rank, source_size, target, total, n and queued: the source's
    words before the row in a round."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    t = checked(scratch.table(targets(sizes, repeats)))  # where it isn't broadcast, Spark splits a hot source's rows
    part = (F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") * F.ceil(F.col("n") / BUCKET_ROWS) / F.lit(2**32)).cast("bigint")
    d = rows.join(t, rows["source"].eqNullSafe(t["source"])).select(rows["*"], "rank", "source_size", "target", "total", "n").withColumn("part", part)
    sums = d.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.table(sums.select("rank", "part", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("ahead")))
    d = d.join(checked(sums), ["rank", "part"])
    inner = Window.partitionBy("rank", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("queued", F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("part", "ahead", "place")


def _time(round_: Column) -> Column:
    return (round_ * F.col("source_size") + F.col("queued") + F.col("size")).cast("double") / F.col("target")


def _cut(d: DataFrame, repeats: int, scratch: Scratch):
    """How the queue ends: the number of buckets in a unit of time, the bucket in which the budget ends, and of the
    last copy within it there the time and the source's rank (null: none there); None for a table without words."""
    about = d.agg(F.count("*").alias("n"), F.max("total").alias("total")).first()
    if not about["total"]:
        return None
    per_unit, budget = max(1, about["n"] // BUCKET_ROWS), about["total"]
    copies = d.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("time", _time(F.col("round")))
    copies = copies.withColumn("bucket", F.floor(F.col("time") * per_unit))
    sums = scratch.table(copies.groupBy("bucket").agg(F.sum("size").alias("words")))
    blocks = sums.groupBy(F.floor(F.col("bucket") / SUMS).alias("block")).agg(F.sum("words").alias("words"))
    block = _ends(blocks, "block", F.lit(0), budget)
    if block is None:
        return per_unit, None, None, None  # the budget takes all
    within = sums.filter(F.floor(F.col("bucket") / SUMS) == block["block"])
    bucket = _ends(within, "bucket", F.lit(block["before"]), budget)
    run = Window.orderBy("time", "rank").rowsBetween(Window.unboundedPreceding, 0)
    last = copies.filter(F.col("bucket") == bucket["bucket"]).select("time", "rank", F.sum("size").over(run).alias("words"))
    last = last.filter(F.col("words") + bucket["before"] <= budget).agg(F.max(F.struct("time", "rank")).alias("last")).first()["last"]
    return per_unit, bucket["bucket"], last and last["time"], last and last["rank"]


def _ends(sums: DataFrame, key: str, start: Column, budget: int):
    """The first key with which the sum so far exceeds the budget, and the sum before it."""
    so_far = F.sum("words").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) + start
    return sums.select(key, "words", so_far.alias("so_far")).filter(F.col("so_far") > budget).orderBy(key).select(key, (F.col("so_far") - F.col("words")).alias("before")).first()


def _copies(d: DataFrame, repeats: int, scratch: Scratch) -> DataFrame:
    """Adds rounds: the rounds in which a row is taken (an array)."""
    cut = _cut(d, repeats, scratch)
    if cut is None:
        return d.withColumn("rounds", F.array().cast("array<int>"))
    per_unit, bucket, time, rank = cut

    def taken(r: Column) -> Column:
        if bucket is None:
            return F.lit(True)
        at = F.floor(_time(r) * per_unit)
        before = at < bucket
        if time is None:
            return before
        return before | ((at == bucket) & ((_time(r) < F.lit(time)) | ((_time(r) == F.lit(time)) & (F.col("rank") <= rank))))

    rounds = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), taken)
    return d.withColumn("rounds", F.when(F.col("size") > 0, rounds).otherwise(F.array().cast("array<int>")))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *keep: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text))
    return docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), place.alias("place"))


def queue(docs: DataFrame, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, queued (the source's words before it in a
    round), taken, copies."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.table(_rows(docs, id_col, text_col, source_col))
    d = _copies(scratch.table(_queued(rows, repeats, scratch)), repeats, scratch).withColumn("copies", F.size("rounds").cast("bigint"))
    return d.select("doc_id", "source", "size", "source_size", "target", "queued", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The mix: docs' columns, a row for each copy taken, in the order of virtual finish times over all sources. Rows are
    numbered in a written table, so that each has its own copies."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    whole = scratch.table(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")))
    rows = scratch.table(_rows(whole, "row.doc_id", "row.text", "row.source", "rid"))
    queued = scratch.table(_queued(rows, repeats, scratch))
    scratch.drop(rows)
    d = _copies(queued, repeats, scratch)
    copies = d.select("rid", "rank", "source_size", "queued", "size", "target", F.explode("rounds").alias("round"))
    copies = checked(scratch.table(copies.select("rid", "rank", _time(F.col("round")).alias("time"))))
    scratch.drop(queued)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return whole.join(copies, "rid").repartitionByRange(n, "time", "rank").sortWithinPartitions("time", "rank").select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), chr(10), coalesce(text, ''))) AS place FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 3 AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(source_size * 3) OVER p, 0) AS BIGINT) AS full_,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS BIGINT) AS rest
  FROM s WINDOW p AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT full_ AS cfull, rest AS crest FROM r
  WHERE CAST(most AS DOUBLE) > CAST(weight AS DOUBLE) * (CAST(total - full_ AS DOUBLE) / CAST(rest AS DOUBLE))
  ORDER BY CAST(most AS DOUBLE) / weight, full_, rest LIMIT 1
), t AS (
  SELECT source, rank, total, source_size, CASE WHEN crest IS NULL THEN CAST(most AS DOUBLE)
         ELSE least(CAST(most AS DOUBLE), CAST(weight AS DOUBLE) * (CAST(total - cfull AS DOUBLE) / CAST(crest AS DOUBLE))) END AS target
  FROM r LEFT JOIN c ON true
), q AS (
  SELECT row_number() OVER () AS rid, doc_id, size, rank, total, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queued
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT rid, size, total, sum(size) OVER (ORDER BY CAST(round * source_size + queued + size AS DOUBLE) / target, rank
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words
  FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS round) WHERE size > 0
), n AS (SELECT rid, count(*) AS copies FROM k WHERE words <= total GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken FROM q LEFT JOIN n USING (rid)
"""
