"""Connected components, and pairs within keys in blocks. Nothing here gathers links or members on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of one key that meet in one task; larger keys are dealt out as pairs of blocks.
BLOCK = 512


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b bigint. Returns node, component_id (the smallest node reachable) for nodes other than that smallest
    one; nodes without edges don't come. Large-star and small-star steps in turn: each links a node's neighbours to
    the smallest of them, until nothing changes; each round is a table in the shared folder."""
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    held = None
    while True:
        # large star: every neighbour above a node gets the smallest of the node and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["w"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below it get the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        small = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.table(small)
        scratch.drop(e)
        e = new
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == held:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
        held = state


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n members of a block the smallest member that it reaches by the pairs (a, b): members that reach
    another one, and that one. Linear in pairs for each round, few rounds."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = low[low]
        new = low[root]
        if (new == root).all():
            break
        root = new
    away = np.nonzero(root != np.arange(n))[0]
    return away, root[away]


def runs(batches, key_columns: int):
    """Of Arrow batches sorted by their first columns, tables that end where a key ends."""
    import pyarrow as pa

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held:
            t = pa.concat_tables([*held, t])
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for c in range(key_columns):
            v = t.column(c).to_numpy()
            change |= v[1:] != v[:-1]
        last = np.nonzero(change)[0]
        if len(last):
            yield t.slice(0, last[-1] + 1)
            held = [t.slice(last[-1] + 1)]
        else:
            held = [t]
    if held:
        yield pa.concat_tables(held)


def pair_rows(starts: np.ndarray, ends: np.ndarray, side: np.ndarray, most: int = 2_000_000):
    """Row pairs (x, y), x before y, within runs [start, end): pairs of rows of side 3, and of sides 1 and 2. Yields
    (first run, last run, x, y), about `most` pairs at a time, all pairs of a run together."""
    sizes = ends - starts
    cost = np.cumsum(sizes * (sizes - 1) // 2)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + most, side="right")))
        s, n = starts[at:to], sizes[at:to]
        rows = np.repeat(s, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        behind = np.repeat(s + n, n) - rows - 1
        x = np.repeat(rows, behind)
        y = x + 1 + (np.arange(behind.sum()) - np.repeat(np.cumsum(behind) - behind, behind))
        use = (side[x] == 3) & (side[y] == 3) | (side[x] + side[y] == 3) & (side[x] != 3) & (side[y] != 3)
        yield at, to, x[use], y[use]
        at = to


def run_bounds(t, key_columns: int) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(t.num_rows - 1, bool)
    for c in range(key_columns):
        v = t.column(c).to_numpy()
        change |= v[1:] != v[:-1]
    cuts = np.nonzero(change)[0] + 1
    return np.r_[0, cuts], np.r_[cuts, t.num_rows]

