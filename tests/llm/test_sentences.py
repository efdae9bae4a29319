"""Toxicity by sentences: phrases, windows of long ones, predictions of a whole table by a plain loop."""

import re

import numpy as np
import pytest

from veilscan.llm import toxicity


def _corpus(n=480):
    draw = np.random.default_rng(12)
    plain = ["".join(w) for w in draw.choice(list("abcdefghilmnoprstu"), (700, 5))]
    phrases = [("green", "goblin"), ("rotten", "turnip")]
    texts, y = [], []
    for i in range(n):
        sentences = [list(draw.choice(plain, 9)) for _ in range(4)]
        a, b = phrases[i // 4 % 2]
        at = int(draw.integers(1, 8))
        if i % 4 == 0:  # the phrase
            sentences[int(draw.integers(4))][at:at] = [a, b]
        else:  # its words, apart, in other sentences
            sentences[0].insert(at, a)
            sentences[2].insert(at, b)
        texts.append(" ".join(" ".join(s) + "." for s in sentences))
        y.append(int(i % 4 == 0))
    return texts, y


def test_phrases_of_clean_words():
    texts, y = _corpus()
    m = toxicity.Toxicity.fit(texts[:400], y[:400])
    s, y = m.score(texts[400:]), np.array(y[400:])
    rank = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert rank > 0.95
    one, two, apart = m.score(["ma green goblin ta.", "ma rotten turnip ta.", "ma green ta. la goblin ra. turnip. rotten."])
    assert min(one, two) > apart


def _plain_margin(m, text):
    """Windows of words, subsequences and weights, one by one."""
    margins = [m.bias]
    for sentence in re.split(r"[.!?](?=\s|$)|\n", text.lower()):
        words = [w for w in ("".join(c for c in t if c.isalnum()) for t in sentence.split()) if w]
        joined, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and len(words[j]) == 1:
                j += 1
            if j - i >= toxicity.P - 1:
                joined.append("".join(words[i:j]))
                i = j
            else:
                joined.append(words[i])
                i += 1
        if not joined:
            continue
        whole = " " + " ".join(joined) + " "
        place = [1]
        for w in joined:
            place.append(place[-1] + len(w) + 1)
        for start in range(0, max(1, len(joined) - toxicity.WORDS + toxicity.WORDS // 2), toxicity.WORDS // 2):
            low, high = place[start] - 1, place[min(start + toxicity.WORDS, len(joined))] - 1
            total = 0.0
            for i in range(low, high + 1):
                for at, weight in toxicity.OFFSETS:
                    if i + at[-1] < len(whole):
                        h = np.uint32(0)
                        with np.errstate(over="ignore"):
                            for k, o in zip(toxicity._MULTIPLY, at):
                                h = np.uint32(h + np.uint32(ord(whole[i + o])) * k)
                            h = np.uint32((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D))
                        total += float(m.weights[h >> np.uint32(32 - toxicity.DIM_BITS)]) * weight
            margins.append(total / np.sqrt(toxicity.SOFT + high - low) + m.bias)
    return max(margins)


def test_predictions_against_a_plain_loop(spark):
    from pyspark.sql import functions as F

    texts, y = _corpus(120)
    odd = ["", None, " . ! ", "a b c d. e f", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen", "x" * 300, "É c! ñ? ok.no", "12 34\n56"]
    rows = list(enumerate(texts + odd)) + [(None, texts[0]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([*enumerate(y), (7, 1), (8, None), (9, 5), (None, 1), (99999, 1)], "doc_id bigint, toxic int")
    m = toxicity.fit(docs, labels, F.lit(True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in toxicity.scored(docs, m).collect())
    want = sorted((-1 if i is None else i, 1 / (1 + np.exp(-(m.slope * _plain_margin(m, t or "") + m.shift)))) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (2, 3)], [(1, 0), (2, 0)]])
def test_labels_that_teach_nothing(spark, labels):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.lit(True))
    known = [y for _, y in labels if y in (0, 1)]
    want = (sum(known) + 1) / (len(known) + 2)
    assert [round(r.score, 9) for r in toxicity.scored(docs, m).collect()] == [round(want, 9)] * 2
