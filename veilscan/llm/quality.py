"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a row of features of its whole text, once. Features are cut into bins at quantiles of a bounded
labelled sample; boosting goes round the features, each time fitting a tree of depth two to one feature's bins and
adding it, shrunk, to that feature's lookup table. Then pairs of features are ranked by how much of the remaining loss a
coarse grid over both explains, and the best are boosted likewise by trees that cut one feature and then the other.
A document's score is the logistic function of an intercept and one table entry for each feature and pair.

Edge cases: a null text is the empty text and has a score like any other; labels other than 0 and 1 (null among them), or of
documents that don't exist, teach nothing; with several labels a document teaches each of them; without any label, or with one class alone,
the score is the smoothed share of label 1 (0.5 without labels); repeated rows are scored alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks, crc_of_id, read_table, slices, unit_hash

FEATURES = ["log_words", "word_length", "distinct", "top_word", "distinct_pairs", "short", "upper", "digit", "point", "symbol", "bar", "shout", "space", "lines", "same_lines", "longest", "capital"]
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
BINS, ROUNDS, PAIRS, PAIR_BINS, RATE = 32, 120, 6, 8, 0.1
#: Characters of a class; other scripts' full stops, commas and marks count like the Latin ones.
_CLASS = {"digit": "0123456789", "point": ".,;:?。、，；：？؟،؛।", "symbol": "$%&*#@^~<>=+\\/_{}[]", "bar": "|", "shout": "!！", "space": " \t\n\r\x0b\x0c\u3000"}
_NAMES = ["upper", *_CLASS]


@cache
def _classes() -> np.ndarray:
    """By code point of the basic plane the number of its class in _NAMES, or the last number; others have none."""
    out = np.full(1 << 16, len(_NAMES), np.uint8)
    out[[c for c in range(1 << 16) if chr(c).isupper()]] = 0
    for i, chars in enumerate(_CLASS.values(), 1):
        out[[ord(c) for c in chars]] = i
    return out


def features(text: str) -> list[float]:
    words = text.split()
    n, m = max(1, len(words)), max(1, len(text))
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)  # halves of surrogate pairs have no class
    by = np.bincount(_classes()[codes], minlength=len(_NAMES))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    return [
        np.log1p(len(words)),
        float(lengths.sum()) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:]))) / n,
        float((lengths <= 3).sum()) / n,
        *(float(by[i]) / m for i in range(len(_NAMES))),
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(float(lengths.max(initial=0))),
        float(sum(c for w, c in counts.items() if w.istitle())) / n,
    ]


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f: array<double>, one per entry of FEATURES."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([features(t or "") for t in texts], pa.list_(pa.float64()))], ["doc_id", "f"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id bigint, f array<double>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gain(g, h):
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut bins in two, and the gain there."""
    left, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left):
        return 0.0, 0
    gains = _gain(left, lh) + _gain(g.sum() - left, h.sum() - lh) - _gain(g.sum(), h.sum())
    at = int(gains.argmax())
    return float(gains[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin."""
    gain, at = _cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One cut along either feature, then each side along the other."""
    if _cut(g.sum(0), h.sum(0))[0] > _cut(g.sum(1), h.sum(1))[0]:
        return _tree2_rows(g.T, h.T).T
    return _tree2_rows(g, h)


def _tree2_rows(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    _, at = _cut(g.sum(1), h.sum(1))
    return np.concatenate([np.tile(_tree(g[s].sum(0), h[s].sum(0), 1), (len(g[s]), 1)) for s in (slice(0, at), slice(at, None)) if len(g[s])])


class Additive:
    """intercept, edges by feature, tables by feature, and tables by pair over coarser bins."""

    def __init__(self, n_features: int):
        self.intercept = 0.0
        self.edges = [np.zeros(0)] * n_features
        self.tables = [np.zeros(1)] * n_features
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], 1)

    def coarse(self, bins: np.ndarray, i: int) -> np.ndarray:
        return bins[:, i] * PAIR_BINS // len(self.tables[i])

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            out += t[b[:, i]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[self.coarse(b, i), self.coarse(b, j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS) -> Additive:
        m = cls(x.shape[1])
        share = (y.sum() + 1) / (len(y) + 2)
        m.intercept = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return m
        m.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
        m.tables = [np.zeros(len(e) + 1) for e in m.edges]
        b = m.bins(x)
        out = np.full(len(y), m.intercept)
        for _ in range(rounds):
            for i, t in enumerate(m.tables):
                p = _sigmoid(out)
                g, h = np.bincount(b[:, i], y - p, len(t)), np.bincount(b[:, i], p * (1 - p), len(t))
                step = RATE * _tree(g, h)
                t += step
                out += step[b[:, i]]
        coarse = [m.coarse(b, i) for i in range(x.shape[1])]
        grid = lambda i, j, v: np.bincount(coarse[i] * PAIR_BINS + coarse[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        p = _sigmoid(out)
        found = []
        for i in range(x.shape[1]):
            for j in range(i):
                g, h = grid(i, j, y - p), grid(i, j, p * (1 - p))
                found.append((float(_gain(g, h).sum() - _gain(g.sum(0), h.sum(0)).sum() - _gain(g.sum(1), h.sum(1)).sum()), i, j))
        m.pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:n_pairs]]
        m.grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in m.pairs]
        for _ in range(rounds // 3):
            for (i, j), t in zip(m.pairs, m.grids, strict=True):
                p = _sigmoid(out)
                step = RATE * _tree2(grid(i, j, y - p), grid(i, j, p * (1 - p)))
                t += step
                out += step[coarse[i], coarse[j]]
        return m


def fit(rows: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Additive:
    """rows: featured(). labels: doc_id, quality. usable: on doc_id, which labels may teach."""
    known = labels.filter(usable & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("y"))
    n = known.count()
    if not n:
        return Additive(len(FEATURES))
    known = known.filter(unit_hash("doc_id", salt="quality") < min(1.0, sample / n))
    got = rows.join(known, "doc_id").select("f", "y").toArrow()
    if not got.num_rows:
        return Additive(len(FEATURES))
    return Additive.fit(np.array(got.column(0).to_pylist()), np.array(got.column(1).to_pylist()))


def scored(rows: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id bigint, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(spark, "quality").table(featured(read_table(spark, sf_dir, "documents")))
    teaches = crc_of_id() % 4 != 2
    out = scored(rows, fit(rows, read_table(spark, sf_dir, "labels"), teaches))
    return out.select("doc_id", (~teaches).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
