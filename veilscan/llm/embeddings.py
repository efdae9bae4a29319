"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines. Two vectors collide on a line where one lies within the window centred
on the other; vectors at the cosine asked for differ on a line by a normal variable of known spread, so the number of
lines out of COUNTED on which such a pair collides is binomial, and the least count that verification asks for is the
one that such a pair misses with a probability of at most MISS. Counting all pairs on all lines would touch a share of
all pairs; so each of many tables first sorts by the windows of some lines taken together (their cells, at a random
shift), and only pairs that share all cells of a table are counted, then verified by the cosine in double precision. The
number of lines in a table grows with the logarithm of the number of vectors, so that a vector shares a key with few
others by chance; the number of tables follows so that a pair at the cosine shares one with probability RECALL. Keys
that one vector has for itself go before any vector moves.

Equal vectors are brought together first. Keys with many vectors are dealt out as pairs of blocks. A block passes on,
for each vector, how many it is linked to (a pair counts in the first table in which it shares all cells), and a
spanning forest of its links; never its pairs.

Vectors of any dimension are compared with those of their own dimension. Dimensions are taken together by the power of
two that holds them (some thirty at most), padded with zeros to it, and the dimension is part of every key.

Edge cases: vectors that are null, of zero length, or that hold a null or non-finite component have no link and are
components of their own; repeated rows are equal vectors; ids may repeat (each row counts); a null id counts as a link but
names no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, read_table
from .components import BLOCK, components, pair_rows, run_bounds, runs, spanning

COUNTED, MISS, RECALL = 48, 1e-3, 0.995
#: Half a counting window, and a cell's width, in spreads of a pair at the cosine asked for.
WINDOW, CELL = 1.5, 6.0
#: Vectors whose cells are in memory at once.
AT_ONCE = 1024
_KEYS = 1 << 61


def _same_cell(c: float) -> float:
    """The probability that two points whose distance is normal with spread 1 / c share a cell of width 1."""
    return erf(c / sqrt(2)) - 2 / (sqrt(2 * pi) * c) * (1 - exp(-c * c / 2))


class Plan:
    """All that workers need: lines, shifts, windows, the least count."""

    def __init__(self, dim: int, n: int, cosine: float, seed: int = 20):
        self.cosine, self.dim = cosine, dim
        spread = sqrt(max(1e-12, 2 - 2 * cosine))
        self.lines = max(4, ceil(log(16 * max(2, n)) / -log(_same_cell(CELL * spread / sqrt(2)))))
        self.tables = max(4, ceil(log(1 - RECALL) / log(1 - _same_cell(CELL) ** self.lines)))
        self.cell, self.window = CELL * spread, WINDOW * spread
        draw = np.random.default_rng(seed)
        self.axes = draw.standard_normal((dim, self.lines * self.tables)).astype(np.float32)
        self.shift = (draw.random(self.lines * self.tables) * self.cell).astype(np.float32)
        self.mix = draw.integers(1, _KEYS, self.lines, dtype=np.int64) | 1
        self.counted = draw.standard_normal((dim, COUNTED)).astype(np.float32)
        p, miss, self.least = erf(WINDOW / sqrt(2)), 0.0, 0
        for k in range(COUNTED + 1):
            miss += _binomial(COUNTED, k, p)
            if miss > MISS:
                self.least = k
                break

    def keys(self, x: np.ndarray, dims: np.ndarray) -> np.ndarray:
        """By vector and table: a hash of its dimension and cells; some vectors at a time, as each has many cells."""
        out = np.zeros((len(x), self.tables), np.int64)
        for at in range(0, len(x), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            cells = np.floor((x[part].astype(np.float32) @ self.axes + self.shift) / self.cell).astype(np.int32)
            cells = cells.reshape(-1, self.tables, self.lines)
            h = np.repeat(dims[part].astype(np.int64), self.tables).reshape(-1, self.tables)
            with np.errstate(over="ignore"):
                for i in range(self.lines):
                    h = (h ^ (cells[:, :, i] * self.mix[i])) * np.int64(0x2545F4914F6CDD1D)
                    h ^= (h.view(np.uint64) >> np.uint64(31)).view(np.int64)
            out[part] = h
        return out


def _binomial(n: int, k: int, p: float) -> float:
    from math import comb

    return comb(n, k) * p**k * (1 - p) ** (n - k)


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>), good: whether it can have links, by the edge cases above but for the dimension."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    # -0.0 and 0.0 are equal
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda c: c + F.lit(0.0)).alias("v"), F.coalesce(fine, F.lit(False)).alias("good"))


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, padded with zeros, and their dimensions."""
    column = column.combine_chunks()
    dims = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(dims) and (dims == width).all():
        x = flat.reshape(-1, width)
    else:
        x = np.zeros((len(dims), width))
        x[np.repeat(np.arange(len(dims)), dims), np.arange(len(flat)) - np.repeat(np.cumsum(dims) - dims, dims)] = flat
    # scaled by the largest component first: no overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), dims


def _first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By pair of rows the first table in which they have one key."""
    parts = range(0, len(a), AT_ONCE)
    return np.concatenate([(keys[a[i : i + AT_ONCE]] == keys[b[i : i + AT_ONCE]]).argmax(axis=1) for i in parts])


def linked(classes: DataFrame, dim: int, cosine: float, scratch: Scratch) -> DataFrame:
    """classes: cls bigint, n bigint, v: distinct vectors of up to `dim` dimensions. cls, links (rows of other classes, in
    parts that add up) and to (a smaller class linked to, or null)."""
    spark = classes.sparkSession
    plan = Plan(dim, classes.count(), cosine)
    sent = spark.sparkContext.broadcast(plan)

    def key(batches):
        import pyarrow as pa

        plan = sent.value
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                t = pa.Table.from_batches([b.slice(at, AT_ONCE)])
                keys = plan.keys(*_matrix(t.column("v"), dim))
                cls, table = np.repeat(t.column("cls").to_numpy(), plan.tables), np.tile(np.arange(plan.tables, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(keys.ravel()), pa.array(cls)], ["tab", "key", "cls"])

    # most keys belong to one vector alone: they go before any vector moves
    thin = classes.select("cls", "v").mapInArrow(key, "tab int, key bigint, cls bigint")
    counts = scratch.table(thin.groupBy("tab", "key").agg(F.count("*").alias("rows")).filter("rows > 1"))
    dealt = scratch.table(thin.join(checked(counts), ["tab", "key"]))
    k = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int")
    dealt = dealt.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    dealt = dealt.select("tab", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "cls").join(classes, "cls")
    keys = ["tab", "key", "i", "j"]

    def verify(batches):
        import pyarrow as pa

        plan = sent.value
        for t in runs(batches, 4):
            starts, ends = run_bounds(t, 4)
            many = ends - starts > 1
            if not many.any():
                continue
            x, dims = _matrix(t.column("v"), dim)
            tab, side, cls, n = (t.column(c).to_numpy() for c in ("tab", "side", "cls", "n"))
            on = x.astype(np.float32) @ plan.counted
            for _, _, a, b in pair_rows(starts[many], ends[many], side, 100_000):
                hits = (np.abs(on[a] - on[b]) <= plan.window).sum(axis=1) >= plan.least
                a, b = a[hits], b[hits]
                near = (np.einsum("ij,ij->i", x[a], x[b]) >= plan.cosine) & (dims[a] == dims[b])
                a, b = a[near], b[near]
                if not len(a):
                    continue
                some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                every = plan.keys(x[some], dims[some])
                first = _first_shared(every, at[: len(a)], at[len(a) :]) == tab[a]
                ids, at = np.unique(np.concatenate([cls[a], cls[b]]), return_inverse=True)
                links = np.bincount(at, np.concatenate([np.where(first, n[b], 0), np.where(first, n[a], 0)]), len(ids)).astype(np.int64)
                away, root = spanning(len(ids), at[: len(a)], at[len(a) :])
                to = np.arange(len(ids))
                to[away] = root
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[to])], ["cls", "links", "to"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, *keys).select(*keys, "side", "cls", "n", "v").sortWithinPartitions(*keys).mapInArrow(verify, "cls bigint, links bigint, to bigint")


def near_duplicates(rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    scratch = Scratch(rows.sparkSession, "embeddings")
    width = F.pow(F.lit(2), F.ceil(F.log2(F.size("v")))).cast("int")
    v = scratch.table(vectors(rows, id_col, vec_col).withColumn("width", F.when(F.col("good"), width)))
    classes = v.filter("good").groupBy("v", "width").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()))
    found = [linked(classes.filter(F.col("width") == r["width"]).select("cls", "n", "v"), r["width"], cosine, scratch) for r in classes.select("width").distinct().orderBy("width").collect()]
    if not found:
        return v.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.table(reduce(DataFrame.unionByName, found))
    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    # components run over classes, as ids can be null or repeat; their name is the smallest id of their rows
    comp = scratch.table(components(found.filter("cls <> to").select(F.col("cls").alias("a"), F.col("to").alias("b")).distinct()))
    c = classes.join(comp, classes["cls"] == comp["node"], "left").select("cls", "v", "low", "n", F.coalesce("component_id", "cls").alias("of"))
    names = scratch.table(c.groupBy("of").agg(F.min("low").alias("component_id")))
    c = c.join(names, "of").join(sums, "cls", "left")
    c = scratch.table(c.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"))
    out = v.join(c, (v["v"] == c["v"]) & v["good"], "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), comp_id.alias("component_id"), (F.col("id") == comp_id).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
