"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint holds a bit for each bit that is set in over half of its shingles' hashes. Equal fingerprints are
brought together first. The 64 bits are grouped into PARTS partitions, correlated bits together (so that some partitions
are skewed and can be skipped), by the bits' correlations over all fingerprints. Two fingerprints that differ in at most
`radius` bits differ, for any thresholds with a sum of radius - PARTS + 1, in some partition by no more than its threshold; -1
skips a partition. For each fingerprint a dynamic programme picks thresholds by the number of candidates that each would
bring, known from the histograms of all partitions' values. Fingerprints are indexed by each partition's value; each probes
the values within its thresholds; what meets is verified on all bits. Values with many fingerprints are dealt out as
pairs of blocks, and a block passes on a spanning forest of its links rather than all of them.

Edge cases: a null text and one without words have fingerprint zero; a text with fewer words than a shingle is one
shingle; repeated rows and ids are documents like any other; a null id counts as none and has no component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks, checked, lean, read_table, slices
from .components import BLOCK, components, run_bounds, runs, spanning

PARTS, WIDTH = 4, 16
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str, size: int) -> list[str]:
    words = _WORDS.findall(text.translate(_LOWER))
    if len(words) <= size:
        return [" ".join(words)] if words else []
    if size == 3:
        return [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])]
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def fingerprint(text: str, size: int = 3) -> int:
    from xxhash import xxh64_intdigest

    return majority(np.array([xxh64_intdigest(s, 42) for s in shingles(text, size)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a bigint."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                fp = np.array([fingerprint(t or "", size) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id bigint, fp bigint")


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """By pair of bits, the number of fingerprints with both; 64 x 64 numbers come to the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((64, 64))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], ["at", "n"])

    out = np.zeros(4096)
    for r in fps.select("fp").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(64, 64)


def group_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """PARTS groups of WIDTH bits. Each starts with the two most correlated bits left and takes in, one by one, the bit
    most correlated with those it has."""
    p = both / max(1, n)
    one = np.diag(p)
    dev = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    c = np.abs(p - np.outer(one, one)) / np.outer(dev, dev)
    np.fill_diagonal(c, 0)
    left, out = list(range(64)), []
    while left:
        sub = c[np.ix_(left, left)]
        a, b = divmod(int(sub.argmax()), len(left))
        group = [left[a], left[b]] if a != b else left[:2]
        while len(group) < WIDTH:
            rest = [i for i in left if i not in group]
            group.append(max(rest, key=lambda i: (c[i, group].sum(), -i)))
        out.append(sorted(group))
        left = [i for i in left if i not in group]
    return out


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """By fingerprint and partition: the partition's bits as a number."""
    x = fp.view(np.uint64)
    out = np.zeros((len(x), len(groups)), np.int64)
    for g, bits in enumerate(groups):
        for i, b in enumerate(bits):
            out[:, g] |= ((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def masks(radius: int) -> list[np.ndarray]:
    """masks[e]: what to flip in a partition to differ in just e bits."""
    by_weight = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32))
    return [np.nonzero(by_weight == e)[0] for e in range(radius + 1)]


def candidates(histogram: np.ndarray, radius: int) -> np.ndarray:
    """By threshold e = 0..radius, partition and value: fingerprints within e of the value, plus what probing costs."""
    out, at = [], np.arange(1 << WIDTH)
    total, cost = np.zeros_like(histogram), 0
    for flips in masks(radius):
        if len(flips) > 200:  # not worth a probe; its candidates are counted as all
            out.append(np.full_like(histogram, histogram.sum() + 1))
            continue
        for f in flips:
            total = total + histogram[:, at ^ f]
        cost += len(flips)
        out.append(total + cost)
    return np.stack(out)


def allocate(cost: np.ndarray, radius: int) -> np.ndarray:
    """cost: by threshold, fingerprint and partition. Thresholds by fingerprint and partition, -1 to radius, that sum to
    radius - partitions + 1 at the least cost: best[s] after each partition, for each sum s, then backwards."""
    levels, n, parts = cost.shape[0] + 1, cost.shape[1], cost.shape[2]
    with_skip = np.concatenate([np.zeros((1, n, parts)), cost])  # level l: threshold l - 1
    goal = radius + 1  # the sum of levels
    best, picks = np.full((goal + 1, n), np.inf), []
    best[0] = 0
    for p in range(parts):
        new, pick = np.full_like(best, np.inf), np.zeros((goal + 1, n), np.int8)
        for s in range(goal + 1):
            for level in range(min(s, levels - 1) + 1):
                v = best[s - level] + with_skip[level, :, p]
                better = v < new[s]
                new[s] = np.where(better, v, new[s])
                pick[s][better] = level
        best = new
        picks.append(pick)
    out, s = np.zeros((n, parts), np.int64), np.full(n, goal)
    for p in range(parts - 1, -1, -1):
        out[:, p] = picks[p][s, np.arange(n)]
        s = s - out[:, p]
    return out - 1


def links(fps: DataFrame, radius: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """fps: distinct fingerprints, fp and rep (bigint). Edges a, b between reps: a spanning forest of the links found
    in each block."""
    spark = fps.sparkSession
    scratch = scratch or Scratch(spark, "simhash")
    n = fps.count()
    groups = group_bits(co_occurrence(fps), n)

    def values(batches):
        import pyarrow as pa

        total = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for b in batches:
            v = part_values(b.column(0).to_numpy(), groups)
            for p in range(PARTS):
                total[p] += np.bincount(v[:, p], minlength=1 << WIDTH)
        p, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(total[p, v])], ["part", "value", "n"])

    # at most PARTS * 65,536 numbers come to the driver, whatever the input
    counted = fps.select("fp").mapInArrow(values, "part int, value int, n bigint").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros((PARTS, 1 << WIDTH))
    histogram[counted.column(0).to_numpy(), counted.column(1).to_numpy()] = counted.column(2).to_numpy()
    near = candidates(histogram, radius)
    # probes come from values within the thresholds that were worth it, so a value's probes are about as many as its neighbours' rows
    split = np.maximum(1, np.ceil(histogram / BLOCK)).astype(np.int32)
    sent = spark.sparkContext.broadcast((near.astype(np.float32), split))
    flips = masks(radius)

    def deal(batches):
        import pyarrow as pa

        near, split = sent.value
        for b in batches:
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(fp), 20_000):
                f, r = fp[at : at + 20_000], rep[at : at + 20_000]
                v = part_values(f, groups)
                threshold = allocate(np.stack([[near[e, p, v[:, p]] for p in range(PARTS)] for e in range(radius + 1)]).transpose(0, 2, 1), radius)
                out = []  # part, value, i (block of the index), j (block of the probes), role, row
                own = (f.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                for p in range(PARTS):
                    rows = np.arange(len(f))
                    out += _spread(p, v[:, p], rows, own, split[p], 0)
                    for e in range(radius + 1):
                        use = np.nonzero(threshold[:, p] >= e)[0]
                        for x in flips[e] if len(use) else ():
                            value = v[use, p] ^ x
                            hit = near[0, p, value] > 1  # some fingerprint has it (1 is the probe's own cost)
                            out += _spread(p, value[hit], use[hit], own, split[p], 1)
                part, value, i, j, role, row = (np.concatenate([o[c] for o in out]) for c in range(6))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c.astype(np.int32)) for c in (part, value, i, j)), pa.array(role.astype(np.int8)), pa.array(f[row]), pa.array(r[row])],
                    ["part", "value", "i", "j", "role", "fp", "rep"],
                )

    def verify(batches):
        import pyarrow as pa

        for t in runs(batches, 4):
            starts, ends = run_bounds(t, 4)
            role, fp, rep = (t.column(c).to_numpy() for c in ("role", "fp", "rep"))
            fp = fp.view(np.uint64)
            firsts = starts + np.add.reduceat(role == 0, starts)  # index rows come first
            a, b = _crossed(starts, firsts, ends, fp, radius)
            if not len(a):
                continue
            ids, at = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
            away, root = spanning(len(ids), at[: len(a)], at[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[root])], ["a", "b"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = fps.select("fp", "rep").mapInArrow(lean(deal), "part int, value int, i int, j int, role tinyint, fp bigint, rep bigint")
    keys = ["part", "value", "i", "j"]
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "role").mapInArrow(lean(verify), "a bigint, b bigint").distinct()


def _spread(part: int, value: np.ndarray, rows: np.ndarray, own: np.ndarray, split: np.ndarray, role: int) -> list[tuple]:
    """Rows for the blocks of their value: an index row belongs to one block i and meets all blocks j of probes, and the
    other way round. Few values have more than one block."""
    k = split[value]
    one = k == 1
    zero = np.zeros(int(one.sum()), np.int64)
    out = [(zero + part, value[one], zero, zero, zero + role, rows[one])]
    if not one.all():
        value, rows, k = value[~one], rows[~one], k[~one]
        mine = np.repeat(own[rows] % k, k)
        each = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        v, r = np.repeat(value, k), np.repeat(rows, k)
        out.append((np.full(len(v), part), v, each if role else mine, mine if role else each, np.full(len(v), role), r))
    return out


def _crossed(starts, firsts, ends, fp, radius, most: int = 2_000_000):
    """Linked rows: index rows [start, first) against probes [first, end) of each run, about `most` pairs at a time."""
    n, m = firsts - starts, ends - firsts
    cost, at, found = np.cumsum(n * m), 0, []
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + most, side="right")))
        pairs = (n * m)[at:to]
        offset = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        width = np.repeat(np.maximum(1, m[at:to]), pairs)
        x = np.repeat(starts[at:to], pairs) + offset // width
        y = np.repeat(firsts[at:to], pairs) + offset % width
        near = np.bitwise_count(fp[x] ^ fp[y]) <= radius
        near &= fp[x] != fp[y]
        found.append((x[near], y[near]))
        at = to
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def clustered(docs: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: one row per document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, size, id_col, text_col))
    fps = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"))
    found = scratch.table(components(links(fps, radius, scratch)))
    to = fps.join(found, fps["rep"] == found["node"], "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(to, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, radius: int = 3, size: int = 3, similarity: float | None = None) -> DataFrame:
    """docs without those of a component that are not its smallest id; rows with a null id stay. With a similarity,
    components are of texts whose sets of shingles have that Jaccard similarity or more (jaccard.clustered)."""
    from . import jaccard

    found = clustered(docs, radius, size) if similarity is None else jaccard.clustered(docs, similarity, size)
    scratch = Scratch(docs.sparkSession, "simhash")
    go = checked(scratch.table(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("go_id")).distinct()))
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(go, F.col("row.doc_id") == F.col("go_id"), "left_anti").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
