"""Near copies by SimHash, held to the Jaccard similarity of word shingles: what simhash.dedup does for a similarity.

A text is the set of the 64-bit hashes of its shingles of `size` words, and the fingerprint of that set. Fingerprints
that differ in few bits are linked by simhash.links; each such pair is verified on whole sets, so that only texts of
similarity `least` or more are linked. At 0.8 a pair's fingerprints differ in some ten bits of 64 on average, far beyond
what partitions of the bits can be probed for; the pairs that such links miss are found on the sets themselves, again by
the pigeonhole principle: all sets are put in one order, shingles that are frequent in a sample of texts last, and two
sets of similarity `least` or more share one of the first n - ceil(least * n) + 1 shingles of either (n: its size).
Lengths and the places of the shared shingle rule most of those pairs out, parities most others: a text's hashes are
counted in one to two buckets for each, and two sets differ in at least as many hashes as buckets in which one count is odd
and the other even. The rest are compared on whole sets. Neither the sample, which settles the order alone, nor the
parities ever change the result. First each text is compared with the first one of a shingle. Then texts that share a shingle and
are not yet in one component meet in blocks, and a block passes on the most alike pair of each component, ROUNDS times
over with the components so far, so that a large family of copies is one component at the cost of few of its pairs; what is
not in one component after that is compared pair by pair.

Edge cases: a null text and one without words are the empty set, all of which are alike; a text with fewer words than a
shingle is one shingle; a null id has no component; repeated rows and ids are documents like any other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alone, blocks, checked, kept, lean, slices, unit_hash
from .components import BLOCK, components, pair_rows, run_bounds, runs
from .simhash import _LOWER, _WORDS, links, majority

#: Texts that the order of shingles is taken from, and frequent shingles that it holds, at most.
SAMPLE, FREQUENT = 5_000, 500_000
#: Bits in which fingerprints may differ to be linked.
NEAR = 3
#: Buckets whose parities a set is told by, at most; rounds in which components pass on their most alike pairs alone.
BUCKETS, ROUNDS = 1 << 14, 2
#: Words whose hashes a worker keeps.
CACHE = 200_000
_words: dict[str, int] = kept("jaccard")


def _rest() -> None:
    """A worker that waits for its next task holds no words. (Functions that are sent to workers would clear a copy.)"""
    _words.clear()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hashed(text: str, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    from xxhash import xxh64_intdigest

    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    for w in set(words):
        if w not in _words:
            _words[w] = xxh64_intdigest(w, 42)
    one = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n, h = max(1, len(one) - size + 1), np.uint64(len(one) if len(one) < size else size)
    with np.errstate(over="ignore"):
        h = np.full(n, h)
        for i in range(min(size, len(one))):
            h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + one[i : i + n])
    return np.unique(h)


def _prefix(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def _hashes(docs: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, text. doc_id, hs: array of a text's hashes."""

    def run(batches):
        import pyarrow as pa

        alone("jaccard")
        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                hs = [hashed(t or "", size).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.list_(pa.int64())), pa.array([_set_key(h) for h in hs], pa.int64())], ["doc_id", "hs", "sk"])
        _rest()

    return docs.mapInArrow(lean(run), "doc_id bigint, hs array<bigint>, sk bigint")


def _set_key(h: np.ndarray) -> int:
    """Equal for equal sets (their hashes are in order)."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(h.tobytes(), 7)).astype(np.int64))


def parities(h: np.ndarray) -> bytes:
    """A bit for each bucket of the hashes: whether an odd number of them falls into it."""
    n = 64
    while n < min(len(h), BUCKETS):
        n *= 2
    odd = np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(odd: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows x and y, the number of buckets whose parities differ; the sets differ in no fewer hashes."""
    width = np.array([len(o) for o in odd])
    common, out = np.minimum(width[x], width[y]), np.zeros(len(x), np.int64)
    for w in np.unique(common):
        use = np.nonzero(common == w)[0]
        rows, at = np.unique(np.concatenate([x[use], y[use]]), return_inverse=True)
        bits = np.stack([_folded(np.frombuffer(odd[i], np.uint64), w // 8) for i in rows])
        a, b, step = at[: len(use)], at[len(use) :], max(1, 16_000_000 // int(w))
        for s in range(0, len(use), step):
            out[use[s : s + step]] = np.bitwise_count(bits[a[s : s + step]] ^ bits[b[s : s + step]]).sum(axis=1, dtype=np.int64)
    return out


def _folded(words: np.ndarray, n: int) -> np.ndarray:
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _most(n: np.ndarray, least: float) -> np.ndarray:
    """How many hashes two similar sets with n hashes in sum can differ in."""
    return (1 - least) / (1 + least) * n + 1e-6


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) that come in three or more texts of a sample, and in how many."""
    n = docs.count()
    some = docs.filter(unit_hash("doc_id", salt="shingles") < min(1.0, SAMPLE / max(1, n)))
    got = _hashes(some, size).select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sets(docs: DataFrame, size: int, least: float) -> DataFrame:
    """doc_id, sk (a key of the set), fp (its fingerprint), n (its size), odd (its parities), first: array of the shingles
    that a similar set must share one of."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))

    def run(batches):
        import pyarrow as pa

        alone("jaccard")
        often, count = sent.value
        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                sk, fp, n, odd, first = [], [], [], [], []
                for t in texts:
                    h = hashed(t or "", size)
                    sk.append(_set_key(h))
                    fp.append(majority(h))
                    n.append(len(h))
                    odd.append(parities(h))
                    if len(often) and len(h):
                        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                        h = h[np.argsort(np.where(often[at] == h, count[at], 0), kind="stable")]
                    first.append(h[: _prefix(len(h), least)].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sk, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(odd, pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "sk", "fp", "n", "odd", "first"])
        _rest()

    return docs.mapInArrow(lean(run), "doc_id bigint, sk bigint, fp bigint, n int, odd binary, first array<bigint>")


def _shared(batches):
    """Of rows h, sk, n, pos sorted by h and sk, one for each h and sk, where h has several sk; with the first row of its h.
    No more than a batch and a row is held."""
    import pyarrow as pa

    names = ["h", "sk", "n", "pos"]
    held, told, last = None, False, None  # the first row of the h that goes on, whether it was given out, the last sk
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(4)]
        ahead = held is not None and held[0] == cols[0][0]
        if ahead:
            cols = [np.r_[x, c] for x, c in zip(held, cols, strict=True)]
        h, sk = cols[0], cols[1]
        new = np.r_[True, h[1:] != h[:-1]]
        again = np.r_[False, ~new[1:] & (sk[1:] == sk[:-1])]
        if ahead and len(sk) > 1:
            again[1] = sk[1] in (sk[0], last)
        last = sk[-1]
        cols = [c[~again] for c in cols]
        new = new[~again]
        starts = np.nonzero(new)[0]
        sizes = np.diff(np.r_[starts, len(new)])
        first = np.repeat(starts, sizes)
        use = np.repeat(sizes > 1, sizes)
        if ahead and told:
            use[0] = False
        held, told = [c[starts[-1]] for c in cols], bool(sizes[-1] > 1) or (ahead and told and len(starts) == 1)
        rows = np.nonzero(use)[0]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in cols), *(pa.array(c[first[rows]]) for c in cols[1:])], [*names, "lsk", "ln", "lpos"])


def _may(a: tuple[str, str, str], b: tuple[str, str, str], least: float) -> str:
    """SQL: whether sets with these columns sk, n, pos can be similar if this is the first shingle that they share."""
    return f"{a[0]} <> {b[0]} and least({a[1]} - {a[2]}, {b[1]} - {b[2]}) >= {least / (1 + least)!r} * ({a[1]} + {b[1]}) - 1e-6"


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _told(rows: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """sk, n, odd of the sets with these keys (sk); one row each."""
    some = rows.select("sk", "n", "odd").join(checked(scratch.table(keys.distinct())), "sk", "left_semi")
    return scratch.table(some.groupBy("sk").agg(F.first("n").alias("n"), F.first("odd").alias("odd")))


def possible(pairs: DataFrame, rows: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """pairs: a, b (set keys). Those that parities don't rule out."""

    def run(batches):
        for b in slices(batches):
            n = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
            at = np.arange(b.num_rows)
            apart = differing(b.column("oa").to_pylist() + b.column("ob").to_pylist(), at, at + b.num_rows)
            yield b.select(["a", "b"]).take(np.nonzero(apart <= _most(n, least))[0])

    pairs = scratch.table(pairs.distinct())
    told = _told(rows, pairs.select(F.explode(F.array("a", "b")).alias("sk")), scratch).hint("merge")
    a = told.select(F.col("sk").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    b = told.select(F.col("sk").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "oa", "ob").mapInArrow(lean(run), "a bigint, b bigint")


def _pairs_in_blocks(batches, least: float):
    """Of rows sorted by block: a table of blocks, where they start, and rows x and y of the pairs in some of them that are in
    different components and can be similar if what they meet in is the first shingle that they share; with a column odd,
    also by their parities, of which so many differ (else None)."""
    for t in runs(batches, 1):
        side, sk, n, pos, c = (t.column(k).to_numpy() for k in ("side", "sk", "n", "pos", "c"))
        rest, n = (n - pos).astype(np.int64), n.astype(np.int64)
        odd = t.column("odd").to_pylist() if "odd" in t.column_names else None
        starts, ends = run_bounds(t, 1)
        for _, _, x, y in pair_rows(starts, ends, side, 500_000):
            x, y = (v[(c[x] != c[y]) & (sk[x] != sk[y])] for v in (x, y))
            use = np.minimum(rest[x], rest[y]) >= least / (1 + least) * (n[x] + n[y]) - 1e-6
            x, y, apart = x[use], y[use], None
            if odd is not None and len(x):
                apart = differing(odd, x, y)
                use = apart <= _most(n[x] + n[y], least)
                x, y, apart = x[use], y[use], apart[use]
            if len(x):
                yield t, starts, x, y, apart


def _with_partners(least: float):
    """Rows that have a partner in their block; blocks of the same sets get one name."""

    def run(batches):
        import pyarrow as pa

        for t, starts, x, y, _ in _pairs_in_blocks(batches, least):
            rows = np.unique(np.concatenate([x, y]))
            side, sk, n, pos = (t.column(k).to_numpy()[rows] for k in ("side", "sk", "n", "pos"))
            block = np.searchsorted(starts, rows, side="right")
            first = np.nonzero(np.r_[True, block[1:] != block[:-1]])[0]
            with np.errstate(over="ignore"):
                name = np.add.reduceat(_mixed(_mixed(sk.view(np.uint64)) + side.astype(np.uint64)), first).view(np.int64)
            name = np.repeat(name, np.diff(np.r_[first, len(rows)]))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (name, side, sk, n, pos)], ["block", "side", "sk", "n", "pos"])

    return run


def _alike(least: float, all_pairs: bool):
    """Pairs of set keys a < b that parities don't rule out: all, or of each component the one with the fewest
    differing parities."""

    def run(batches):
        import pyarrow as pa

        for t, _, x, y, apart in _pairs_in_blocks(batches, least):
            sk, c = (t.column(k).to_numpy() for k in ("sk", "c"))
            if not all_pairs:
                whose, at = np.concatenate([c[x], c[y]]), np.tile(np.arange(len(x)), 2)
                order = np.lexsort((at, apart[at], whose))
                at = np.unique(at[order][np.r_[True, np.diff(whose[order]) != 0]])
                x, y = x[at], y[at]
            ab = np.unique(np.stack([np.minimum(sk[x], sk[y]), np.maximum(sk[x], sk[y])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], ["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, size: int, least: float, scratch: Scratch) -> DataFrame:
    """pairs: a, b (set keys). Those whose sets are similar; sets are made again, from one text each."""
    pairs = scratch.table(pairs.distinct())
    ends = scratch.table(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("sk")))
    ids = checked(scratch.table(rows.join(checked(scratch.table(ends.select("sk").distinct())), "sk", "left_semi").groupBy("sk").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()))
    whole = _hashes(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), size).select("sk", "hs")
    # a set moves once for each of its pairs
    of = lambda end: F.first(F.when(F.col("sk") == F.col(end), F.col("hs")), ignorenulls=True)
    both = whole.join(checked(ends), "sk").groupBy("a", "b").agg(of("a").alias("ha"), of("b").alias("hb")).withColumn("same", F.size(F.array_intersect("ha", "hb")))
    return scratch.table(both.filter(f"same >= {least!r} * (size(ha) + size(hb) - same) - 1e-9").select("a", "b"))


def _joined(comp: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """comp (node, component_id) with these links too."""
    old = comp.select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    return comp if found.isEmpty() else scratch.table(components(old.unionByName(found)))


def clustered(docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest id that chains of similar texts reach): one row per document with an id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").filter("doc_id is not null")
    rows = scratch.table(sets(docs, size, least))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # fingerprints first: equal ones by their smallest set key, others by few differing bits
    fps = scratch.table(rows.groupBy("fp").agg(F.min("sk").alias("rep")))
    equal = rows.select("sk", "fp").distinct().join(fps, "fp").filter("sk <> rep").select(*_ordered("sk", "rep"))
    close = links(fps, NEAR, scratch).select(*_ordered("a", "b"))
    found = verified(possible(equal.unionByName(close), rows, least, scratch), docs, rows, size, least, scratch)
    comp = scratch.table(components(found))
    # then sets that share one of their first shingles; of equal sets one row each
    more = scratch.table(rows.groupBy("sk").agg(F.count("*").alias("k"), F.min("doc_id").alias("low")).filter("k > 1").select("sk", "low"))
    one = rows.join(checked(more), "sk", "left").filter("low is null or doc_id = low")
    thin = one.select("sk", "n", F.posexplode("first").alias("pos", "h")).select("h", "sk", "n", "pos")
    schema = "h bigint, sk bigint, n int, pos int, lsk bigint, ln int, lpos int"
    shared = scratch.table(thin.repartition(parts, "h").sortWithinPartitions("h", "sk", "pos").mapInArrow(_shared, schema))
    known = checked(comp)
    first = shared.filter(_may(("sk", "n", "pos"), ("lsk", "ln", "lpos"), least)).select(*_ordered("sk", "lsk")).distinct()
    first = first.join(known.select(F.col("node").alias("a"), F.col("component_id").alias("ca")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("component_id").alias("cb")), "b", "left")
    first = first.filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    comp = _joined(comp, verified(possible(first, rows, least, scratch), docs, rows, size, least, scratch), scratch)
    left = shared.select("h", "sk", "n", "pos").join(checked(comp), shared["sk"] == comp["node"], "left").select("h", "sk", "n", "pos", F.coalesce("component_id", "sk").alias("c"))
    # shingles whose texts are all in one component are done with
    open_ = left.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("k")).filter("lo < hi").select("h", "k")
    left = scratch.table(left.join(open_, "h"))
    # a shingle with many texts is dealt out as pairs of blocks: a row meets its own block (side 3), and others from either side
    own = F.pmod(F.xxhash64("sk"), F.col("k")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(F.xxhash64("h", F.least(own, x), F.greatest(own, x)).alias("block"), F.when(own == x, 3).when(own < x, 1).otherwise(2).alias("side")))
    near = left.select("sk", "n", "pos", F.explode(meets).alias("m")).select("m.*", "sk", "n", "pos")

    def in_blocks(rows, run, schema):
        rows = rows.join(checked(comp), rows["sk"] == comp["node"], "left").select(*rows.columns, F.coalesce("component_id", "sk").alias("c"))
        return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(lean(run), schema)

    def with_partners(near):
        near = in_blocks(near, _with_partners(least), "block bigint, side int, sk bigint, n int, pos int")
        return scratch.table(near.groupBy("block", "side", "sk").agg(F.first("n").alias("n"), F.min("pos").alias("pos")))

    def with_parities(near):
        told = _told(rows, near.select("sk"), scratch).select("sk", "odd")
        return near.join(told.hint("merge"), "sk").select(*near.columns, "odd")

    near = with_parities(with_partners(with_parities(with_partners(near))))
    for at in range(ROUNDS + 1):
        pairs = scratch.table(in_blocks(near, _alike(least, at == ROUNDS), "a bigint, b bigint").distinct())
        if pairs.isEmpty():
            break
        comp = _joined(comp, verified(pairs, docs, rows, size, least, scratch), scratch)
    named = scratch.table(rows.select("doc_id", "sk").join(checked(comp), F.col("sk") == F.col("node"), "left").select("doc_id", F.coalesce("component_id", "sk").alias("c")))
    low = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    scratch.drop(rows, fps, shared, left)
    return named.join(low, "c").select("doc_id", "component_id")
