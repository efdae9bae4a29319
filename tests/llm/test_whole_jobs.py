"""What the operators must do on whole inputs: edited copies, long documents, rare cases."""

import os
import random
import re
import subprocess
import sys
import weakref
from types import SimpleNamespace as Held

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

import corpus_pipeline
from veilscan.llm import bpe, jaccard, langid, pii, quality


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(texts, least):
    ids, s = sorted(texts), {i: _shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (s[a] == s[b] or len(s[a] & s[b]) >= least * len(s[a] | s[b]) - 1e-9):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_copies_with_edits(spark):
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    licence = draw.choices(vocabulary, k=60)
    texts = {}
    for i in range(30):
        words = draw.choices(vocabulary, k=draw.randint(60, 300)) + licence * (i % 3 == 0)
        texts[10 * i] = " ".join(words)
        for j in range(1, 5):  # from one word to far below the bound
            edited = list(words)
            for _ in range(1 + j * len(words) // 90):
                edited[draw.randrange(len(edited))] = draw.choice(vocabulary)
            texts[10 * i + j] = " ".join(edited)
    # a chain
    chain = draw.choices(vocabulary, k=200)
    for i in range(12):
        texts[1000 + i] = " ".join(chain[3 * i :] + vocabulary[: 3 * i])
    texts |= {5000: "", 5001: " \n", 5002: "one two", 5003: "ONE two", 5004: "one two three"}
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (0, texts[0])], "doc_id bigint, text string")
    want = _components(texts, 0.8)
    got = {r.doc_id: r.component_id for r in jaccard.clustered(docs).collect()}
    assert got == want and len(set(want.values())) < len(want) - 50
    left = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert {i for i in left if i is not None} == set(want.values()) and left.count(None) == 1


def _family(members, draw):
    """Texts by id: some edits of one text, half of them few and half of them many."""
    vocabulary = [f"w{i}" for i in range(3000)]
    base = draw.choices(vocabulary, k=200)
    texts = {}
    for i in range(members):
        words = list(base)
        for at in draw.sample(range(200), (2, 5)[i % 2] + (i % 20 == 0)):
            words[at] = draw.choice(vocabulary)
        texts[i] = " ".join(words)
    return texts


def test_large_family_of_near_copies_is_compared_in_few_pairs(spark, monkeypatch):
    texts, compared, whole = _family(300, random.Random(5)), [], jaccard.verified

    def counted(pairs, *rest):
        compared.append(pairs.distinct().count())
        return whole(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.clustered(docs).collect()} == _components(texts, 0.8)
    assert sum(compared) < 4 * len(texts)


def test_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8, raising=False)
    texts = _family(60, random.Random(6))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.clustered(docs).collect()} == _components(texts, 0.8)


def test_parities_never_tell_of_more_than_differs():
    draw = np.random.default_rng(7)
    for n, m in ((0, 3), (1, 1), (40, 400), (300, 300), (300, 1100), (20_000, 70_000)):
        shared = draw.integers(0, 2**63, min(n, m) // 2, np.uint64)
        a, b = (np.unique(np.concatenate([shared, draw.integers(0, 2**63, k - len(shared), np.uint64)])) for k in (n, m))
        odd = [jaccard.parities(a), jaccard.parities(b), jaccard.parities(a)]
        told = jaccard.differing(odd, np.array([0, 0, 1]), np.array([1, 2, 1]))
        assert 0 < told[0] <= len(np.setxor1d(a, b)) and told[1] == told[2] == 0


def test_pii_terms_far_from_the_mention(spark):
    filler = " ".join(f"word{i}" for i in range(200))
    rows = [(i, f"Zorblat 王明 77341 Zorblat {filler} write to zq@corp.example") for i in range(4)]
    rows += [(10 + i, f"{filler} number {i}, write to p{i}@corp.example") for i in range(200)]
    rows += [(500, f"{filler} only Zorblat here")]  # no mention
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [r.t[x.s : x.e] for x in r.terms] for r in pii.analysed(docs, with_text=True).collect()}
    assert all(got[i] == ["Zorblat", "王明", "77341", "Zorblat"] for i in range(4))
    assert got[500] == ["Zorblat"] and not any(got[i] for i in range(10, 210))


def test_capital_counts_all_words():
    at = quality.FEATURES.index("capital")
    for n in (0, 1, 511, 512, 1024, 4097):
        words = [("Title", "plain", "plain", "plain")[i % 4] for i in range(n)]
        assert quality.features(" ".join(words))[at] == (n + 3) // 4 / max(1, n)


WORKER = """
import random, re
from types import SimpleNamespace as Held
import numpy as np, pyarrow as pa
from veilscan.llm import langid

def memory():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

caught, draw = [], random.Random(1)
path = langid.default_vocabulary()
size = langid.pieces(path).size
model = langid.Model(path, ["a", "b", "c", "d"], np.full((size, 4), 1 / size))
spark = Held(sparkContext=Held(broadcast=lambda m: Held(value=m)))
langid.accepted(Held(sparkSession=spark, schema=None, columns=["text"], mapInArrow=lambda run, schema: caught.append(run)), model)
words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(3, 12))) for _ in range(120_000)]
batches = [pa.record_batch({"text": [" ".join(draw.choices(words, k=500)) for _ in range(512)]}) for _ in range(4)]
before = memory()
for _ in caught[0](batches):
    pass
print(memory() - before)
"""


def test_language_worker_lets_go_of_memory():
    done = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 25  # MB; 40 where freed memory is kept


def test_workers_keep_nothing_of_other_operators():
    codec = weakref.ref(bpe.codec(*bpe._default()))
    assert codec() is bpe.codec(*bpe._default())
    value = Held(start=lambda: None)
    assert langid.started(Held(value=value)) is value and langid._started
    assert codec() is None
    bpe.codec(*bpe._default())
    assert not langid._started


def test_near_copies_leave_no_words_in_a_worker():
    caught = []
    jaccard._hashes(Held(mapInArrow=lambda run, schema: caught.append(cloudpickle.dumps(run))), 5)
    batch = pa.record_batch({"doc_id": [1], "text": ["some words that a worker meets"]})
    assert sum(b.num_rows for b in cloudpickle.loads(caught[0])([batch])) == 1
    assert not jaccard._words
