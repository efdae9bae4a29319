r"""Toxicity: a support vector machine over a subsequence string kernel on sentences, by Nystroem landmarks.

Two sentences are alike by the subsequences of P letters that they share. Up to one letter is passed over between two
letters of a subsequence, and each one passed over multiplies its weight by DECAY: gapped words and words with inserted
letters keep most of what they share with the plain ones. Such subsequences are few for each letter, so the kernel is a
product of explicit (hashed) vectors of them, over the root of both lengths. Spaces count as letters: a phrase is more
than its words. Signs within words go ("i.d.i.o.t"), runs of single letters are joined ("i d i o t").

The kernel is taken against landmark sentences; whitening by the landmarks' own kernel matrix gives features in which a
linear SVM is the kernel SVM. As the kernel is a product of vectors, the weighted sum over landmarks is a vector too:
it is added up once, and scoring a text is one pass over its letters, whatever the number of landmarks.

Labels are of documents, so sentences are learned as multiple instances: of a document with label 1 the sentence with
the highest margin is a positive example (at first by how much oftener its subsequences come in such documents), and so
are up to INSTANCES - 1 others with a positive margin; of one with label 0 the highest and some others are negative ones, in ROUNDS turns. A document's margin is its highest sentence's,
turned into a probability by a logistic fit on a quarter of the documents that the SVM has not seen, weighed as the
labels are. Sentences of more than WORDS words are taken in windows that overlap by half.

The model is fitted on at most about `sample` documents and `chars` characters of either label; scoring reads whole texts.

Edge cases: a null text is the empty text, which has a score like any other; without labels, or with one class alone, the
score is the smoothed share of label 1 (0.5 without labels); labels other than 0 and 1 (null among them) teach nothing; a document
with several labels teaches each of them; repeated rows are scored alike; ids may repeat or be null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_of_id, read_table, slices, unit_hash

P, DECAY = 4, 0.6
#: Hashed subsequences; what a length counts for at least; words of a window.
DIM_BITS, SOFT, WORDS = 20, 30, 8
#: Documents and characters of either label that the model is fitted on, and landmarks, at most.
SAMPLE, CHARS, LANDMARKS = 1200, 8_000_000, 400
#: Turns of learning; sentences of a document with label 1 that are positive examples, at most.
ROUNDS, INSTANCES = 3, 4
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_SPACE = np.uint32(32)


def _offsets() -> list[tuple[tuple[int, ...], float]]:
    """Where a subsequence's letters stand, and its weight."""
    out = []
    for gaps in product((1, 2), repeat=P - 1):
        at = [0]
        for g in gaps:
            at.append(at[-1] + g)
        out.append((tuple(at), DECAY ** (at[-1] - (P - 1))))
    return out


OFFSETS = _offsets()


@cache
def _kinds() -> np.ndarray:
    """By code point of the basic plane: 1 letter or digit, 2 white space, 3 a sign that ends a sentence before white
    space, 4 one that ends it anywhere, 0 any other sign."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        out[c] = 1 if chr(c).isalnum() else 2 if chr(c).isspace() else 0
    for marks, kind in ((".!?…؟।", 3), ("\n\r\f。！？", 4)):
        out[[ord(c) for c in marks]] = kind
    return out


class Sentences:
    """The sentences of some texts, one after the other: letters with single spaces within and around sentences; by
    sentence (or window of a long one) where it starts and ends (inclusive), and the text that it is of."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(codes < 1 << 16, _kinds()[np.minimum(codes, 0xFFFF)], 1)
        at = np.nonzero(kind == 1)[0]
        self.n = len(at)
        empty = np.zeros(0, np.int64)
        self.codes, self.starts, self.ends, self.of, self.limit = np.zeros(0, np.uint32), empty, empty, empty, empty
        if not self.n:
            return
        blank = (kind == 2) | (kind == 4)
        stop = kind == 4
        stop[:-1] |= (kind[:-1] == 3) & blank[1:]
        spaces, stops = np.cumsum(blank | stop), np.cumsum(stop)
        gap = np.zeros(self.n, np.int64)  # before a letter: 0 within a word, 1 a new word, 2 a new sentence
        gap[1:] = (np.diff(spaces[at]) > 0).astype(np.int64) + (np.diff(stops[at]) > 0)
        gap[_joined(gap)] = 0
        place = np.arange(self.n) + np.cumsum(gap) + 1
        self.codes = np.full(self.n + int(gap.sum()) + 2, _SPACE)
        self.codes[place] = codes[at]
        first = np.r_[0, np.nonzero(gap == 2)[0]]  # the sentences' first letters
        last = np.r_[first[1:], self.n] - 1
        ends = place[last] + 1
        lengths = np.fromiter(map(len, low), np.int64, len(low))
        text = np.searchsorted(np.cumsum(lengths + 1), at[first], side="right")
        words = np.r_[0, np.nonzero(gap)[0]]  # the words' first letters
        own = np.searchsorted(words, first)  # a sentence's first word
        count = np.diff(np.r_[own, len(words)])
        windows = np.maximum(1, -(-(count - WORDS) // (WORDS // 2)) + 1)
        sentence = np.repeat(np.arange(len(first)), windows)
        step = (np.arange(len(sentence)) - np.repeat(np.cumsum(windows) - windows, windows)) * (WORDS // 2)
        behind = own[sentence] + step + WORDS
        inner = step + WORDS < count[sentence]
        self.starts = place[words[own[sentence] + step]] - 1
        self.ends = np.where(inner, place[words[np.minimum(behind, len(words) - 1)]] - 1, ends[sentence])
        self.of = text[sentence]
        self.limit = np.repeat(ends, np.diff(np.r_[place[first] - 1, len(self.codes)]))  # by place, its sentence's end
        self.limit = np.r_[np.zeros(len(self.codes) - len(self.limit), np.int64), self.limit]

    def text(self, i: int) -> str:
        return self.codes[self.starts[i] : self.ends[i] + 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def hashed(self):
        """For each pattern of gaps: by place the hash of the subsequence that starts there, its weight (0 beyond the end)."""
        n = len(self.codes)
        padded = np.r_[self.codes, np.zeros(2 * P, np.uint32)]
        with np.errstate(over="ignore"):
            parts = [padded * m for m in _MULTIPLY[:P]]
            for at, weight in OFFSETS:
                h = parts[0][:n].copy()
                for part, o in zip(parts[1:], at[1:], strict=True):
                    h += part[o : o + n]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                yield (h >> np.uint32(32 - DIM_BITS)), np.where(np.arange(n) + at[-1] <= self.limit, np.float32(weight), np.float32(0))

    def scale(self) -> np.ndarray:
        return 1 / np.sqrt(SOFT + self.ends - self.starts)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """By sentence: the product of its vector and the weights."""
        v = np.zeros(len(self.codes))
        for h, w in self.hashed():
            v += weights[h] * w
        total = np.r_[0.0, np.cumsum(v)]
        return (total[self.ends + 1] - total[self.starts]) * self.scale()

    def vectors(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some sentences: number in `which`, hash, weight of what their vectors are made of."""
        size = self.ends[which] + 1 - self.starts[which]
        place = np.repeat(self.starts[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row, scale, out = np.repeat(np.arange(len(which)), size), np.repeat(self.scale()[which], size), []
        for h, w in self.hashed():
            some = w[place] > 0
            out.append((row[some], h[place][some], w[place][some] * scale[some]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (row[:0], row[:0].astype(np.uint32), scale[:0])


def _spoilt(text: str, draw: np.random.Generator) -> str:
    out = []
    for w in text.split():
        if len(w) > P:
            i = int(draw.integers(1, len(w)))
            w = w[:i] + "abcdefghijklmnopqrstuvwxyz0123456789"[int(draw.integers(36))] + w[i:]
        out.append(w)
    return " ".join(out)


def _joined(gap: np.ndarray) -> np.ndarray:
    """Letters whose space before them goes: those of runs of P - 1 or more words of one letter."""
    word = np.nonzero(gap)[0]
    firsts = np.r_[0, word]
    one = np.diff(np.r_[firsts, len(gap)]) == 1
    new = np.r_[True, ~(one[1:] & one[:-1] & (gap[firsts[1:]] == 1))]
    run = np.cumsum(new) - 1
    return firsts[~new & (np.bincount(run)[run] >= P - 1)]


def kernel(some: Sentences, which: np.ndarray, others: Sentences, marks: np.ndarray, rarity: np.ndarray | None = None) -> np.ndarray:
    """The kernel of sentences with landmarks, through what the landmarks' vectors hold by hash. rarity: by hash, what a
    shared subsequence counts for (1 without it)."""
    row, h, w = some.vectors(which)
    mark, mh, mw = others.vectors(marks)
    if rarity is not None:
        mw = mw * rarity[mh]
    order = np.argsort(mh, kind="stable")
    mark, mh, mw = mark[order], mh[order], mw[order]
    low, high = np.searchsorted(mh, h, "left"), np.searchsorted(mh, h, "right")
    out = np.zeros(len(which) * len(marks))
    for i in range(0, len(h), 200_000):
        part = slice(i, i + 200_000)
        n = high[part] - low[part]
        at = np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(row[part], n) * len(marks) + mark[at], np.repeat(w[part], n) * mw[at], len(out))
    return out.reshape(len(which), len(marks))


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Linear L2-loss SVM by dual coordinate descent; the last entry is the bias. Classes weigh the same in all."""
    x = np.hstack([x, np.ones((len(x), 1))])
    s = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y <= 0).sum()))
    d = 1 / (2 * c * weight)
    q, a, w = (x * x).sum(1) + d, np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            g = s[i] * (w @ x[i]) - 1 + d[i] * a[i]
            new = max(0.0, a[i] - g / q[i])
            if new != a[i]:
                w += (new - a[i]) * s[i] * x[i]
                a[i] = new
    return w


def _highest(s: Sentences, margins: np.ndarray, n: int, least: float) -> np.ndarray:
    out = np.full(n, least)
    np.maximum.at(out, s.of, margins)
    return out


def _best(s: Sentences, margins: np.ndarray, most: int = 1, least: np.ndarray | None = None) -> np.ndarray:
    """By text that has one: its sentence with the highest margin, the first of equal ones, and up to `most` - 1 others
    that come next, as far as their margins are `least` (by text) or more."""
    order = np.lexsort((np.arange(len(margins)), -margins, s.of))
    if not len(order):
        return order
    new = np.r_[True, np.diff(s.of[order]) > 0]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    use = new | ((rank < most) & (margins[order] >= (least[s.of[order]] if least is not None else np.inf)))
    return order[use]


class Toxicity:
    """weights: the landmarks' weighted vectors, added up; bias; slope and shift of the logistic function."""

    def __init__(self, share: float = 0.5):
        self.weights: np.ndarray | None = None
        self.bias, self.slope, self.shift, self.landmarks = -1.0, 0.0, float(np.log(share / (1 - share))), 0

    def margin(self, texts: list[str]) -> np.ndarray:
        """The highest margin of each text's sentences; the bias, which a sentence like no landmark has, at least."""
        if self.weights is None:
            return np.full(len(texts), self.bias)
        s = Sentences(texts)
        return _highest(s, s.sums(self.weights) + self.bias, len(texts), self.bias)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin([t or "" for t in texts]) + self.shift, -30, 30)))

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], most: int = LANDMARKS, stand_for: tuple[float, float] = (1.0, 1.0)) -> Toxicity:
        """stand_for: how many labelled documents each one of label 0, and of label 1, stands for."""
        y = np.array(labels, float)
        n0, n1 = (y <= 0).sum() * stand_for[0], (y > 0).sum() * stand_for[1]
        m = cls(float((n1 + 1) / (n0 + n1 + 2)))
        if len(np.unique(y)) < 2:
            return m
        # a quarter of either label is for the logistic fit; too few to spare any: all for both
        rank = np.zeros(len(y), int)
        for v in (0, 1):
            rank[y == v] = np.arange((y == v).sum())
        aside = rank % 4 == 3 if min((y > 0).sum(), (y <= 0).sum()) >= 8 else np.ones(len(y), bool)
        learn = ~aside if not aside.all() else aside
        own, is_toxic = [t for t, l in zip(texts, learn, strict=True) if l], y[learn] > 0
        m._learn(own, is_toxic, most)
        if m.weights is None:
            return m
        m._calibrate(m.margin([t for t, a in zip(texts, aside, strict=True) if a]), y[aside], stand_for)
        return m

    def _learn(self, texts: list[str], toxic: np.ndarray, most: int) -> None:
        s = Sentences(texts)
        if not len(s.starts) or len(np.unique(toxic[s.of])) < 2:
            return
        often, rarity = _oftener(s, toxic)
        margins, kept = s.sums(often), np.zeros(0, np.int64)
        draw = np.random.default_rng(11)
        other = np.nonzero(~toxic[s.of])[0]
        other = draw.permutation(other)[: 2 * int((~toxic).sum())]
        for turn in range(ROUNDS):
            top = _highest(s, margins, len(texts), -np.inf)
            best = _best(s, margins, INSTANCES, top * 0.25 if not turn else np.zeros(len(texts)))
            good, bad = best[toxic[s.of[best]]], _best(s, margins)
            bad = bad[~toxic[s.of[bad]]]
            kept = np.union1d(kept, bad)  # hard ones of earlier turns stay
            rows = np.r_[good, np.union1d(kept, other)]
            label = np.r_[np.ones(len(good)), np.zeros(len(rows) - len(good))]
            marks = np.r_[draw.permutation(good)[: most * 3 // 4], draw.permutation(rows[len(good) :])[: most // 4]]
            x, mm = kernel(s, rows, s, marks, rarity), kernel(s, marks, s, marks, rarity)
            value, vector = np.linalg.eigh((mm + mm.T) / 2)
            white = vector @ np.diag(np.maximum(value, 1e-3 * max(value.max(), 1e-9)) ** -0.5) @ vector.T
            # each positive example a second time, with a character inserted into its longer words
            spoilt = Sentences([_spoilt(s.text(i), draw) for i in good])
            again = kernel(spoilt, _best(spoilt, -spoilt.starts.astype(float)), s, marks, rarity)
            w = _svm(np.vstack([x, again]) @ white, np.r_[label, np.ones(len(again))])
            mark, h, weight = s.vectors(marks)
            self.weights = np.bincount(h, weight * rarity[h] * (white @ w[:-1])[mark], 1 << DIM_BITS).astype(np.float32)
            self.bias, self.landmarks = float(w[-1]), len(marks)
            margins = s.sums(self.weights) + self.bias

    def _calibrate(self, margins: np.ndarray, y: np.ndarray, stand_for: tuple[float, float]) -> None:
        at, n = np.clip(margins, -5, 5), [(y <= 0).sum(), (y > 0).sum()]
        target = np.where(y > 0, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        weigh = np.where(y > 0, stand_for[1], stand_for[0])
        weigh = weigh / weigh.mean()
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(a * at + b, -30, 30)))
            g, h = np.array([(weigh * (p - target) * at).sum() + 1e-3 * a, (weigh * (p - target)).sum()]), weigh * (p * (1 - p) + 1e-9)
            step = np.linalg.solve(np.array([[(h * at * at).sum() + 1e-3, (h * at).sum()], [(h * at).sum(), h.sum() + 1e-9]]), g)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.slope, self.shift = float(a), float(b)


def _oftener(s: Sentences, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By hash: how much oftener the subsequence comes in documents with label 1, 0 where it doesn't for sure; and its
    rarity, the squared logarithm of the share of documents without label 1 that hold it."""
    counts = [np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)]
    text = np.zeros(len(s.codes), np.int64)
    text[s.starts] = np.r_[s.of[0], np.diff(s.of)] if len(s.of) else 0
    text = np.maximum.accumulate(np.where(text > 0, np.cumsum(text), 0))
    cuts = np.searchsorted(text, np.arange(len(toxic) + 1))
    every = [h for h, _ in s.hashed()]
    for i in range(len(toxic)):
        if cuts[i + 1] > cuts[i]:
            counts[int(toxic[i])][np.unique(np.concatenate([h[cuts[i] : cuts[i + 1]] for h in every]))] += 1
    n = [max(1, int((~toxic).sum())), max(1, int(toxic.sum()))]
    low = counts[1] - 1.5 * np.sqrt(counts[1])  # by the lower end of a rough interval
    often = np.maximum(0, np.log(np.maximum(low, 1e-9) / n[1] * n[0] / (counts[0] + 1)))
    return often.astype(np.float32), np.log((n[0] + 1) / (counts[0] + 1)) ** 2 + 0.01


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, chars: int = CHARS) -> Toxicity:
    """labels: doc_id, toxic. usable: on doc_id, which labels may teach. At most about 2 * sample texts of 2 * chars
    characters in all come to the driver."""
    known = labels.filter(usable & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("y"))
    lengths = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")).join(known, "doc_id")
    n = {r["y"]: (r["n"], r["size"]) for r in lengths.groupBy("y").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    if not n:
        return Toxicity()
    share = {y: min(1.0, sample / k, chars / max(1, size)) for y, (k, size) in n.items()}
    some = known.filter(unit_hash("doc_id", salt="toxic") < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy("doc_id", "y", "text").select("text", "y").toArrow()
    y = got.column(1).to_pylist()
    stand = tuple(n.get(v, (0, 0))[0] / max(1, y.count(v)) for v in (0, 1))
    return Toxicity.fit([t or "" for t in got.column(0).to_pylist()], y, stand_for=stand)


def scored(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist(), 300_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(m.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id bigint, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    teaches = crc_of_id() % 5 != 0
    out = scored(docs, fit(docs, read_table(spark, sf_dir, "labels"), teaches))
    return out.select("doc_id", (~teaches).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
