"""Single pieces of the operators at their edges: odd letters, odd labels, very long words, hostile input."""

import base64
import math
import unicodedata
from fractions import Fraction

import numpy as np
import pytest

from veilscan.llm import langid, pii, quality, registry, secrets


def _jwt(head: bytes) -> str:
    return base64.urlsafe_b64encode(head).decode().rstrip("=") + ".eyJzdWIiOjF9.abc"


@pytest.mark.parametrize("head", [b'{"a":' + b"[" * 200_000, b'{"a":1}', b'["alg"]', b'"alg"', b'{"alg"', b"\xff\xfe"])
def test_headers_that_are_no_token(head):
    text = "x " + ("eyJ" + _jwt(head)[3:])
    assert [k for _, _, k in secrets.scan(text) if k == "jwt"] == []
    assert [k for _, _, k in secrets.scan(text + " " + _jwt(b'{"alg":"none"}'))].count("jwt") == 1


def test_quality_counts_code_points():
    of = lambda t: dict(zip(quality.FEATURES, quality.features(t), strict=True))
    for t in ("простой русский текст без знаков", "한국어 문장 입니다", "日本語の文章"):
        f = of(t)
        assert f["point"] == f["symbol"] == f["shout"] == f["upper"] == 0
    f = of("ПРОСТОЙ Русский. Ωмега, 中文。😀")
    n = len("ПРОСТОЙ Русский. Ωмега, 中文。😀")
    assert f["upper"] == 9 / n and f["point"] == 3 / n


def test_letters_are_unicode_letters():
    m = langid.Model(langid.default_vocabulary(), ["en"], np.full((langid.pieces(langid.default_vocabulary()).size, 1), 1e-5))
    m.start()
    texts = ["½ ² Ⅷ ①", "12 ٣ _", "ª", "中", "a½", "", None, "�"]
    lang, score = m.predict(texts)
    letters = [any(unicodedata.category(c)[0] == "L" for c in t or "") for t in texts]
    assert [x != "und" for x in lang] == letters and [s > 0 for s in score] == letters


def test_long_words_sum_over_all_segmentations():
    v = langid.pieces(langid.default_vocabulary())
    draw = np.random.default_rng(1)
    p = draw.random((v.size, 2)) * 1e-4
    p[-2], p[-1] = 0, 1e-7
    ids = dict(zip(v.pieces, range(len(v.pieces)), strict=True))

    def total(w, g):
        a = [Fraction(1)] + [Fraction(0)] * len(w)
        for j in range(1, len(w) + 1):
            for k in range(1, min(j, v.longest) + 1):
                i = ids.get(w[j - k : j], v.size - 1 if k == 1 else None)
                if i is not None:
                    a[j] += a[j - k] * Fraction(float(p[i, g]))
        return math.log(a[-1].numerator) - math.log(a[-1].denominator)

    words = [langid.marked(w) for w in ("the", "internationalization" * 3, "x" * 70, "日本語の文章" * 30, "nation" * 40)]
    got = langid.log_sums(v, words, p)
    assert np.allclose(got, [[total(w, g) for g in range(2)] for w in words], rtol=1e-12)


def test_expected_counts_of_long_words(monkeypatch):
    v = langid.pieces(langid.default_vocabulary())
    p = np.random.default_rng(2).random((v.size, 1)) * 1e-3
    p[-2], p[-1] = 0, 1e-7
    words = [langid.marked(w) for w in ("internationalization", "wonderfully", "x日y")]
    lengths, counts = np.array([len(w) for w in words]), np.array([2.0, 3.0, 1.0])
    one, many = np.zeros(v.size), np.zeros(v.size)
    for w, c in zip(words, counts, strict=True):
        langid.expected(v.lattice([w]), np.array([len(w)]), p, np.array([c]), one)
    monkeypatch.setattr(langid, "SHORT", 1)
    langid.expected(v.lattice(words), lengths, p, counts, many)
    assert np.allclose(one, many)


def test_languages_against_a_plain_loop(spark):
    """The whole query on a small table: one text at a time, one word at a time, all segmentations."""
    words = {"aa": ["nation", "stone", "rivers"], "bb": ["maison", "pierre", "les"]}
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(draw.choice(words[l], 12)) + (" ½" if i % 5 else ""), l) for i, l in enumerate(["aa", "bb"] * 12)]
    rows += [(40, "nation pierre stone", None), (41, None, "aa"), (42, "½ 12", "bb"), (None, "les maison", None), (3, "rivers", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, langid.teaches())
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identified(docs, model).collect()}
    v = langid.pieces(model.path)
    want = {}
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            want[i, "und"] = 0.0
            continue
        ll = sum(langid.log_sums(v, [langid.marked(w)], model.probs)[0] for w in t.split())
        e = np.exp(ll - ll.max())
        want[i, model.langs[int(ll.argmax())]] = float(e.max() / e.sum())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert [l for _, l in want if l != "und"].count("aa") >= 12
    few = langid.fit(docs, langid.teaches(), most_langs=1)
    assert few.langs == ["aa"]


def test_quality_against_a_plain_loop(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(6)
    texts = [" ".join(draw.choice(["stone", "river", "Hill.", "sea"] if i % 2 else ["$$$", "BUY!", "now|", "1234"], 30)) for i in range(120)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "stone"), (5, texts[5])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 7), (4, None), (6, 1), (9999, 1), (None, 1)], "doc_id bigint, quality int")
    rows = quality.featured(docs)
    model = quality.fit(rows, labels, F.lit(True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 12)) for r in quality.scored(rows, model).collect())

    def one(t):
        out, f = model.intercept, quality.features(t or "")
        at = [sum(x >= e for e in edges) for x, edges in zip(f, model.edges, strict=True)]
        out += sum(t[a] for t, a in zip(model.tables, at, strict=True))
        low = [a * quality.PAIR_BINS // len(t) for a, t in zip(at, model.tables, strict=True)]
        out += sum(g[low[i], low[j]] for (i, j), g in zip(model.pairs, model.grids, strict=True))
        return round(float(1 / (1 + np.exp(-np.clip(out, -30, 30)))), 12)

    want = sorted([(i, one(t)) for i, t in enumerate(texts)] + [(-1, one("stone")), (5, one(texts[5]))])
    assert got == want
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in want if 0 <= i < 120)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in ("op4_mix_sources", "op7_embeddings")])
def test_null_and_repeated_ids(spark, sf, frames, tmp_path, name):
    """Rows without an id, or with one that others have, get a result each; the other rows' results stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(1).selectExpr("cast(null as bigint) doc_id", "'the house of my brother' text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    again = docs.filter("doc_id in (2, 91)")
    docs.unionByName(odd).unionByName(odd).unionByName(again).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    n = len(frames["documents"])
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) == n + 4 and got.doc_id.isna().sum() == 2
    counts = got.doc_id.value_counts()
    assert counts[2] == counts[91] == 2 and (counts.drop([2, 91]) == 1).all()


def test_disclosing_terms_against_brute_force(spark):
    """Spans of terms by the definition of PMI, over a small table with rare values, shared domains and copies."""
    import re

    draw = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(draw.choice(vocabulary, 12))
        if i % 16 == 0:
            words += ["Zorblat", f"p{i}@rare.example"]  # a new address each time, one domain
        elif i % 10 == 3:
            words += ["quux", "10.1.2.3", "or"] + ["Quux"] * (i % 3)
        elif i % 9 == 4:
            words += [f"a{i}@common{i}.example", "seldom"]
        rows.append((i, " ".join(words)))
    rows += [(500, "seldom quux alone"), (501, None), (502, "")] + [(600, "plainly plainly u@copy.example copied")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, [(x.s, x.e) for x in r.terms]) for r in pii.analysed(docs).collect())

    mail, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
    ents, terms = [], []
    for _, t in rows:
        t = t or ""
        m, a = {x.lower() for x in re.findall(mail, t)}, set(re.findall(ip, t))
        ents.append({("m", x) for x in m} | {("d", x.split("@")[1]) for x in m} | {("i", x) for x in a} | {("n", x.rpartition(".")[0]) for x in a})
        bare = re.sub(f"{mail}|{ip}", "\1", t)
        terms.append({w.lower() for w in re.findall(r"[\w'\x01-]+", bare) if "\1" not in w and not re.fullmatch("[a-z]{1,2}", w)})
    n, told = len(rows), set()
    for e in set().union(*ents):
        having = [i for i in range(n) if e in ents[i]]
        ic = math.log2(n / len(having))
        for t in set().union(*(terms[i] for i in having)):
            both, df = sum(t in terms[i] for i in having), sum(t in x for x in terms)
            if ic >= 3 and len(having) >= 3 and both >= 3 and math.log2(n * both / (len(having) * df)) >= 0.8 * ic - 1e-12:
                told.add(t)
    want = sorted((i, [m.span() for m in re.finditer(r"[\w'-]+", t or "") if m.group().lower() in told and not any(b.start() < m.end() and m.start() < b.end() for b in re.finditer(f"{mail}|{ip}", t or ""))]) for i, t in rows)
    assert {"zorblat", "quux", "copied"} <= told and "seldom" not in told
    assert got == want


def _links(rows, least):
    """n_links and component_id by row, over all pairs."""
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    scaled = [np.array(v, float) / max(map(abs, v)) if g else None for (_, v), g in zip(rows, good, strict=True)]
    x = [v if v is None else v / np.linalg.norm(v) for v in scaled]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least] for i in range(len(rows))]
    low, change = [i for i, _ in rows], True
    while change:
        change = False
        for i, js in enumerate(near):
            m = min([low[i], *(low[j] for j in js)], key=lambda k: (k is None, k))
            if m != low[i]:
                low[i], change = m, True
    return [len(js) for js in near], low


def test_vectors_of_all_dimensions(spark):
    from veilscan.llm import embeddings

    draw = np.random.default_rng(3)
    rows, i = [], 0
    for dim, n in ((16, 30), (3, 12), (1, 4), (2, 4), (17, 9), (64, 6)):
        base = draw.standard_normal((3, dim))
        for k in range(n):
            rows.append((i, [float(c) for c in (base[k % 3] + 0.02 * draw.standard_normal(dim))]))
            i += 1
    rows += [(i, [1.0, 0.0]), (i + 1, [1.0]), (i + 2, [1.0, 0.0, 0.0]), (i + 3, []), (i + 4, None), (i + 5, [0.0]), (i + 6, [1e300, 1e300]), (i + 7, [1e-300, 1e-300])]
    rows += [(5, rows[5][1]), (5, rows[9][1])]  # ids that repeat
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    links, low = _links(rows, 0.95)
    assert sum(r.n_links for r in got) >= 0.95 * sum(links)
    assert set((r.vec_id, r.component_id) for r in got) ^ set((k, c) for (k, _), c in zip(rows, low, strict=True)) == set()
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [2.0, -1.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_duplicates(nulls).collect()) == [(0, 2, 3), (0, 2, 3), (3, 2, 3), (4, 0, 4)]
