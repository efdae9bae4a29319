"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A text's likelihood in a language sums over
all ways to segment it into pieces: for each word, a forward pass over its characters adds up, at each place, the
probabilities of all pieces that end there. Piece probabilities are learned by expectation maximisation, the expected
counts coming from the same forward pass and its mirror image. Words are cut at white space alone and start with the
vocabulary's word mark; a word may be as long as a text (scripts without spaces), its sums are rescaled on the way.

The model is fitted on at most `docs_per_lang` documents and about CHARS characters of each of the `most_langs` most
frequent languages (chosen by a hash of the id), whole texts; predictions read nothing but the text. Forward passes run
over many words at once; each worker keeps the scores of words it has met, within CACHE bytes.

Edge cases: texts that are null or hold no letter are 'und' with score 0; so are all where nothing can be learned; ties
go to the language that sorts first; rows without language or text teach nothing; repeated rows count as often as they
come; ids may repeat or be null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, blocks, crc_of_id, kept, lean, read_table, slices, unit_hash

MARK = "▁"
#: Of a character that no piece covers, and of a piece before smoothing.
UNKNOWN, FLOOR = 1e-7, 1e-9
#: Characters up to which the sums over a word can't leave the range of a double.
SHORT = 33
#: Bytes of words and scores that a worker keeps; characters that meet in one forward pass over long words.
CACHE, AT_ONCE = 64_000_000, 200_000
#: What the model is fitted on, at most: documents and characters of a language, languages.
DOCS_PER_LANG, CHARS, LANGS, ROUNDS = 250, 3_000_000, 256, 3
_B = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1e150


class Pieces:
    """The vocabulary's pieces by a hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = sorted({p for i in ids if (p := sp.id_to_piece(i))})
        self.longest = max(map(len, self.pieces))
        keys = np.array([self.key(np.array([ord(c) for c in p], np.uint64)) for p in self.pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[keys >> np.uint64(44)] = True
        self.size = len(self.pieces) + 2  # then: no piece (probability 0), unknown character

    @staticmethod
    def key(codes: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in codes:
                h = Pieces.step(h, c)
        return h

    @staticmethod
    def step(h, c):
        x = (h ^ (c + np.uint64(0x7F4A7C15))) * _B
        return x ^ (x >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids, or size - 2 where there is no piece."""
        out = np.full(h.shape, self.size - 2, np.int32)
        rows = np.nonzero(self.seen[h >> np.uint64(44)])
        some = h[rows]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[rows] = np.where(self.keys[at] == some, self.order[at], self.size - 2)
        return out

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For words of up to n characters: item k - 1 has the ids of the pieces of k characters, by word and start. What
        lies behind a shorter word's end means nothing."""
        n = max(map(len, words))
        codes = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        h, out = np.zeros((len(words), n), np.uint64), []
        with np.errstate(over="ignore"):
            for k in range(1, min(n, self.longest) + 1):
                h = self.step(h[:, : n - k + 1], codes[:, k - 1 :])
                ids = self.find(h)
                if k == 1:
                    ids[ids == self.size - 2] = self.size - 1
                out.append(ids)
        return out


def marked(word: str) -> str:
    return MARK + word.replace("\0", "\ufffd")


def by_length(words: list[str], langs: int = 1):
    """Rows of words that make one pass: of equal length up to SHORT, else of lengths within a factor of two."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kind = np.where(lengths <= SHORT, lengths, SHORT + np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    order = np.argsort(kind, kind="stable")
    cuts = np.nonzero(np.diff(kind[order]))[0] + 1
    for rows in np.split(order, cuts) if len(words) else ():
        n = int(lengths[rows].max())
        most = max(1, AT_ONCE * 4 // (n + 1) // max(1, langs // 4) if n <= SHORT else AT_ONCE // n)
        for i in range(0, len(rows), most):
            yield rows[i : i + most]


def forward(lattice: list[np.ndarray], probs: np.ndarray) -> np.ndarray:
    """By word, place and language: the summed probability of all segmentations up to there."""
    n = lattice[0].shape[1]
    a = np.zeros((n + 1, lattice[0].shape[0], probs.shape[1]))
    a[0] = 1
    none = probs.shape[0] - 2
    for j in range(1, n + 1):
        for k in range(1, min(j, len(lattice)) + 1):
            ids = lattice[k - 1][:, j - k]
            if k < 3:
                a[j] += a[j - k] * probs[ids]
            else:  # few words have a piece here
                rows = np.nonzero(ids != none)[0]
                a[j, rows] += a[j - k, rows] * probs[ids[rows]]
    return a


def _found(lattice: list[np.ndarray], none: int) -> list[np.ndarray]:
    """By length of a piece, whether any word has one at a start."""
    return [(ids != none).any(axis=0) for ids in lattice]


def _logs(lattice: list[np.ndarray], lengths: np.ndarray, probs: np.ndarray, back: bool = False) -> np.ndarray:
    """By place, word and language the logarithm of the sum over all segmentations up to there (back: from there to the
    word's end), for words of any length. The last columns are kept in one scale, which moves on as they get small."""
    n, size, none = lattice[0].shape[1], lattice[0].shape[0], probs.shape[0] - 2
    found, longest = _found(lattice, none), len(lattice)
    ring = np.zeros((longest + 1, size, probs.shape[1]))
    scale, out = np.zeros((size, probs.shape[1])), np.full((n + 1, size, probs.shape[1]), -np.inf)
    for step in range(n + 1):
        j = n - step if back else step
        now = ring[step % (longest + 1)]
        now[:] = 0
        for k in range(1, min(step, longest) + 1):
            start = j if back else j - k
            if not found[k - 1][start]:
                continue
            ids = lattice[k - 1][:, start]
            rows = slice(None) if k < 3 else np.nonzero(ids != none)[0]
            now[rows] += ring[(step - k) % (longest + 1)][rows] * probs[ids[rows]]
        if back:
            now[lengths == j], scale[lengths == j] = 1, 0
        elif not step:
            now[:] = 1
        with np.errstate(divide="ignore"):
            out[j] = np.log(now) + scale
        if step % 8 == 7:
            small = (now > 0) & (now < 1 / _STEP)
            if small.any():
                ring[:, small] *= _STEP
                scale[small] -= np.log(_STEP)
    return out


def log_sums(v: Pieces, words: list[str], probs: np.ndarray) -> np.ndarray:
    """By word and language: the logarithm of the summed probability of all its segmentations."""
    out = np.zeros((len(words), probs.shape[1]))
    for rows in by_length(words, probs.shape[1]):
        group = [words[i] for i in rows]
        lengths = np.fromiter(map(len, group), np.int64, len(group))
        if lengths.max() <= SHORT:
            out[rows] = np.log(forward(v.lattice(group), probs)[-1])
        else:
            out[rows] = _logs(v.lattice(group), lengths, probs)[lengths, np.arange(len(group))]
    return out


def expected(lattice: list[np.ndarray], lengths: np.ndarray, probs: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
    """Adds to total the expected counts of pieces for one language (probs: one column)."""
    p, n = probs[:, 0], lattice[0].shape[1]
    if n > SHORT:
        a, b = _logs(lattice, lengths, probs)[:, :, 0], _logs(lattice, lengths, probs, back=True)[:, :, 0]
        end = a[lengths, np.arange(len(lengths))]
        found = _found(lattice, len(p) - 2)
        with np.errstate(divide="ignore"):
            logp = np.log(p)
        for k in range(1, min(n, len(lattice)) + 1):
            for start in np.nonzero(found[k - 1])[0]:
                rows = np.nonzero(start + k <= lengths)[0]
                ids = lattice[k - 1][rows, start]
                np.add.at(total, ids, np.exp(a[start, rows] + logp[ids] + b[start + k, rows] - end[rows]) * counts[rows])
        return
    a = forward(lattice, probs)[:, :, 0]
    b = np.zeros_like(a)
    b[n] = 1
    for j in range(n - 1, -1, -1):
        for k in range(1, min(n - j, len(lattice)) + 1):
            b[j] += b[j + k] * p[lattice[k - 1][:, j]]
    for j in range(1, n + 1):
        for k in range(1, min(j, len(lattice)) + 1):
            ids = lattice[k - 1][:, j - k]
            total += np.bincount(ids, a[j - k] * p[ids] * b[j] / a[n] * counts, len(total))


class Model:
    """langs in order, and log-likelihoods of words in each of them."""

    def __init__(self, path: str, langs: list[str], probs: np.ndarray):
        self.path, self.langs, self.probs = path, langs, probs

    def __getstate__(self):
        return {"path": self.path, "langs": self.langs, "probs": self.probs.astype(np.float32)}

    def __setstate__(self, held):
        self.__init__(held["path"], held["langs"], held["probs"].astype(float))

    def start(self) -> None:
        self.pieces, self.rows = pieces(self.path), {}
        self.logs, self.n, self.bytes = np.zeros((1 << 12, len(self.langs))), 0, 0

    def rest(self) -> None:
        """At a task's end: many words go, as the worker may wait for long; few stay for the next task."""
        if self.bytes > CACHE // 4:
            self.start()

    def learn(self, words: list[str]) -> None:
        """Scores distinct words that are not yet kept."""
        logs, end = log_sums(self.pieces, [marked(w) for w in words], self.probs), self.n + len(words)
        if end > len(self.logs):
            self.logs = np.concatenate([self.logs[: self.n], np.zeros((max(end, len(self.logs) * 3 // 2) - self.n, len(self.langs)))])
        self.logs[self.n : end] = logs
        self.rows.update(zip(words, range(self.n, end), strict=True))
        self.n = end
        self.bytes += sum(map(len, words)) * 2 + len(words) * (170 + 8 * len(self.langs))  # a string, its place in the table, a number

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        if self.bytes > CACHE:
            self.start()
        cut = [t.split() for t in texts]
        every = list(chain.from_iterable(cut))
        at = list(map(self.rows.get, every))
        if None in at:
            self.learn(list(dict.fromkeys(w for w, i in zip(every, at, strict=True) if i is None)))
            at = list(map(self.rows.get, every))
        out, logs, end = np.zeros((len(texts), len(self.langs))), self.logs[np.array(at, np.int64)], 0
        for i, ws in enumerate(cut):
            out[i] = logs[end : (end := end + len(ws))].sum(axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability, all languages being as likely beforehand."""
        texts = [t or "" for t in texts]
        named = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        ll = self.log_likelihoods(texts)
        p = np.exp(ll - ll.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[b] if n else "und" for b, n in zip(best, named, strict=True)], np.where(named, p.max(axis=1), 0.0)


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _word_counts(sample: DataFrame) -> DataFrame:
    """sample: lang, text. lang, word, n, in parts that add up; words as predictions cut them."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            for texts, langs in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                by: dict[str, Counter] = {}
                for t, l in zip(texts, langs, strict=True):
                    by.setdefault(l, Counter()).update(t.split())
                rows = [(l, w, n) for l, c in by.items() for w, n in c.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    return sample.mapInArrow(run, "lang string, word string, n bigint")


def fit(docs: DataFrame, usable: Column, path: str | None = None, docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS, chars: int = CHARS, most_langs: int = LANGS) -> Model:
    """usable: which rows may teach. The word counts of the sample, not texts, come to the driver."""
    path = path or default_vocabulary()
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    share = {r["lang"]: min(1.0, docs_per_lang / r["n"], chars / max(1, r["chars"])) for r in sizes}
    langs = sorted(share)
    if not langs:
        return Model(path, [], np.zeros((1, 0)))
    by = F.coalesce(F.element_at(F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(share[l]))]), F.col("lang")), F.lit(0.0))
    sample = rows.filter(unit_hash("doc_id", salt="langid") < by).select("lang", "text")
    counted = _word_counts(sample).groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    v = pieces(path)
    probs = np.zeros((v.size, len(langs)))
    by_lang: dict[str, dict[str, int]] = {l: {} for l in langs}
    for l, w, c in zip(*(counted.column(i).to_pylist() for i in range(3)), strict=True):
        by_lang[l][marked(w)] = c
    for g, l in enumerate(langs):
        words = sorted(by_lang[l])
        counts = np.array([by_lang[l][w] for w in words], float)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        groups = [(v.lattice([words[i] for i in rows]), lengths[rows], counts[rows]) for rows in by_length(words)]
        p = np.full((v.size, 1), 1 / v.size)
        for _ in range(rounds):
            p[-2], p[-1] = 0, UNKNOWN
            total = np.zeros(v.size)
            for lattice, n, c in groups:
                expected(lattice, n, p, c, total)
            total[-2:] = 0
            p[:, 0] = total / max(total.sum(), 1) + FLOOR
            p /= p.sum()
        p[-2], p[-1] = 0, UNKNOWN
        probs[:, g] = p[:, 0]
    return Model(path, langs, probs)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages

    def run(batches):
        import pyarrow as pa

        m = started(sent)
        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                lang, score = m.predict(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


_started = kept("langid")


def started(sent) -> Model:
    """A worker's model lives on from task to task with its word scores; another broadcast replaces it."""
    alone("langid")
    if sent.value is not _started.get("value"):
        _started["value"] = sent.value
        sent.value.start()
    return _started["value"]


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs whose language is told with a posterior of `least` or more; columns as they were."""
    sent, schema, at = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m = started(sent)
        for b in slices(batches):
            keep = []
            for texts, _ in blocks(t := b.column(at).to_pylist(), [None] * len(t)):
                lang, score = m.predict(texts)
                keep += [name != "und" and s >= least for name, s in zip(lang, score, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))
        m.rest()

    return docs.mapInArrow(lean(run), schema)


def teaches() -> Column:
    return crc_of_id() % 4 != 2


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identified(docs, fit(docs, teaches()))
    return out.select("doc_id", (~teaches()).alias("held_out"), "lang_pred", "score")
