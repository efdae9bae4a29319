"""Each query against brute force or SQL, over texts that are null, empty, very long or equal, and over empty tables."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from veilscan.llm import bpe, embeddings, exact_dedup, langid, mixing, pii, quality, registry, secrets, simhash, toxicity
from tests.llm.test_whole_jobs import _components
from veilscan.llm.components import components

Q = registry.QUERIES
_done: dict = {}


@pytest.fixture
def run(spark, sf):
    def get(name):
        if name not in _done:
            _done[name] = Q[name](spark, sf).toPandas().sort_values("vec_id" if "7" in name else "doc_id").reset_index(drop=True)
        return _done[name]

    return get


@pytest.fixture
def text(frames):
    d = frames["documents"]
    return {i: t or "" for i, t in zip(d.doc_id, d.text, strict=True)}


def crc(i):
    return zlib.crc32(str(i).encode())


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.mark.parametrize("name", Q)
def test_empty_tables(spark, empty, sf, name):
    got = Q[name](spark, empty)
    assert got.count() == 0 and got.columns == list(Q[name](spark, sf).columns)


@pytest.mark.parametrize("name", [n for n in Q if "7" not in n])
def test_one_row_per_document(run, text, name):
    assert list(run(name).doc_id) == list(text)


def _unions(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in ids]


def test_langid(run, frames, text):
    d = run("op1_langid").merge(frames["documents"][["doc_id", "lang"]], on="doc_id")
    assert all(d.held_out == [crc(i) % 4 == 2 for i in d.doc_id])
    blank = [not re.search(r"[^\W\d_]", text[i]) for i in d.doc_id]
    assert all((d.lang_pred == "und") == blank) and all(d.score[blank] == 0) and d.score.between(0, 1).all()
    known = d[d.lang.notna() & (d.lang_pred != "und") & (d.doc_id <= 90)]
    assert (known.lang == known.lang_pred).mean() > 0.95


def test_langid_sums_all_segmentations():
    v = langid.pieces(langid.default_vocabulary())
    draw = np.random.default_rng(1)
    p = draw.random((v.size, 1))
    p[-2], p[-1] = 0, 1e-7
    ids = dict(zip(v.pieces, range(len(v.pieces)), strict=True))

    def total(w):
        out = 0.0 if w else 1.0
        for k in range(1, min(len(w), v.longest) + 1):
            i = ids.get(w[:k], v.size - 1 if k == 1 else v.size - 2)
            out += p[i, 0] * total(w[k:]) if p[i, 0] else 0
        return out

    for w in ("▁the", "▁hausé", "▁x日y"):
        assert np.isclose(langid.forward(v.lattice([w]), p)[-1, 0, 0], total(w), rtol=1e-9)


def _tiktoken():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(run, text):
    enc = _tiktoken()
    for r in run("op2_bpe").itertuples():
        ids = enc.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text[r.doc_id]))


def test_bpe_prefixes_and_edits():
    enc, c = _tiktoken(), bpe.codec(*bpe._default())
    draw = np.random.default_rng(2)
    whole = lambda b: enc._encode_single_piece(b)
    for _ in range(60):
        b = bytes(draw.choice(np.frombuffer(b"abetheing ouns.1\xc3\xa9\n", np.uint8), draw.integers(1, 120)))
        p = bpe.PrefixText(c, b)
        assert p.ids == whole(b)
        p.append(b"tion")
        assert p.ids == whole(b + b"tion")
        at = int(draw.integers(0, len(b)))
        p.replace(at, at + 1, b"qu")
        assert p.ids == whole(b[:at] + b"qu" + b[at + 1 :] + b"tion")
    long = bpe.PrefixText(c, b"the cat sat on the mat " * 400)
    assert long.replace(4000, 4001, b"zz") < 2000 and long.ids == whole(long.bytes)


def _luhn(s):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(s))) % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m.group())


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
}
SECRET = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
}


def _base(kinds, t):
    found = sorted((m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t) if ok(m))
    return found, [f"{k}:{s}:{e}" for s, _, e, k in found]


@pytest.mark.parametrize("name,kinds", [("op3_pii", PII), ("op8_secrets", SECRET)])
def test_base_spans(run, text, name, kinds):
    n = 0
    for r in run(name).itertuples():
        found, listed = _base(kinds, text[r.doc_id])
        n += len(found)
        assert r.base_sha256 == sha(",".join(listed)), text[r.doc_id][:200]
        assert [getattr(r, f"n_{k}") for k in kinds] == [sum(f[3] == k for f in found) for k in kinds]
        assert set(listed) <= set(r.spans.split(",") if r.spans else [])
    assert n >= 4


def test_pii_terms(spark):
    rows = [(i, f"meeting notes {i}, call Zorblat Quux at zq@corp.example about lunch") for i in range(4)]
    rows += [(10 + i, f"meeting notes about lunch {i}, call or write to p{i}@corp.example") for i in range(40)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    terms = {t for r in pii.analysed(docs, with_text=True).collect() for t in (r.t[x.s : x.e] for x in r.terms)}
    assert terms == {"Zorblat", "Quux"}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == "meeting notes 0, call   at [EMAIL] about lunch" and clean[10] == "meeting notes about lunch 0, call or write to [EMAIL]" and clean[99] == clean[100] == ""
    assert "[NAME]" in pii.sanitised(docs, remove=9.0).filter("doc_id = 0").first().text


def test_secrets_with_checksums():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = body + secrets.base62(zlib.crc32(body.encode()), 6)
    jwt = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=") + ".eyJzdWIiOjF9.abc"
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(b"\x30\x82" + b"x" * 40).decode() + "\n-----END PRIVATE KEY-----"
    t = f"é ghp_{good} ghp_{body}000000 {jwt} {pem} eyJub3Q.eyJx.z"
    assert [(k, t[s:e]) for s, e, k in secrets.scan(t)] == [("github", f"ghp_{good}"), ("jwt", jwt), ("pem", pem)]


def test_mix(spark, run, frames, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(mixing.OP4_SQL).df().sort_values("doc_id").reset_index(drop=True)
    d = run("op4_mix_sources")
    for c in ("size", "source_size", "taken"):
        assert list(d[c]) == list(want[c])
    assert np.allclose(d.target, want.target) and (d.taken <= 3 * d["size"]).all()
    g = d.assign(source=frames["documents"].source).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("source_size", "first"), longest=("size", "max"))
    assert (abs(g.taken - g.target) <= g.longest).all() and (g.target <= 3 * g.most + 1e-6).all() and np.isclose(g.target.sum(), d["size"].sum())
    mix = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))
    assert mix.columns == list(frames["documents"].columns)
    assert mix.count() == (d.taken[d["size"] > 0] // d["size"][d["size"] > 0]).sum()


def test_mix_of_equal_rows(spark):
    """Rows that are equal in all columns have copies of their own; the closed form of each source tells how many."""
    rows = [(1, "a b c", "s0")] * 50 + [(None, "a b c d", "s1")] * 20 + [(i, "w " * (1 + i % 7), "s2") for i in range(200)] + [(7, None, "s3"), (8, "", None), (9, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    q = mixing.queue(docs).toPandas()
    mix = mixing.mixed(docs).toPandas()
    for name, g in q.groupby(q.source.fillna("?")):
        words = mix[mix.source.fillna("?") == name].text.str.split().str.len().sum()
        assert words == g.taken.sum() and abs(words - g.target.iloc[0]) <= g["size"].max()
        # a source is served in the order of its queue: all rounds before the cut, then a prefix of the last
        served = sorted((r * g.source_size.iloc[0] + a, n) for a, n, c in zip(g.queued, g["size"], g.copies) for r in range(c) if n)
        assert [a for a, _ in served] == list(np.cumsum([0] + [n for _, n in served])[:-1])
    assert q.taken.sum() <= q["size"].sum() and q.taken.sum() > q["size"].sum() - 7
    again = mixing.mixed(docs).toPandas()
    assert again.fillna(-1).values.tolist() == mix.fillna(-1).values.tolist()


def test_toxicity(spark, run):
    d = run("op5_toxicity")
    assert all(d.held_out == [crc(i) % 5 == 0 for i in d.doc_id]) and d.score.between(0, 1).all() and all(d.predicted == (d.score >= 0.5))
    draw = np.random.default_rng(5)
    plain = ["".join(w) for w in draw.choice(list("abcdefghilmnoprstu"), (900, 6))]
    docs = [" ".join(draw.choice(plain, 15)) for _ in range(400)]
    y = [int(i % 4 == 0) for i in range(400)]
    docs = [f"{t} {('blorpish', 'twaddlek')[i // 4 % 2]}" if v else t for i, (t, v) in enumerate(zip(docs, y, strict=True))]
    m = toxicity.Toxicity.fit(docs, y)
    s = m.score(["a blorpish man", "a blo-rp.ish man", "a b l o r p i s h man", "a blorxpish man", " ".join(plain[:30]), "", None])
    assert (s[:4] >= 0.5).all() and (s[4:] < 0.5).all()
    assert np.allclose(toxicity.Toxicity.fit(["a", "b"], [1, 1]).score(["a", None]), 0.75)


def _subsequences(s):
    """By string of P letters with at most one letter between two of them: the sum of its weights in s."""
    from itertools import combinations

    out = {}
    for c in combinations(range(len(s)), toxicity.P):
        gaps = np.diff(c)
        if gaps.max() <= 2:
            u = "".join(s[i] for i in c)
            out[u] = out.get(u, 0) + toxicity.DECAY ** int((gaps - 1).sum())
    return out


def test_string_kernel():
    texts = ["idiot", "id.i.ot", "idxiot", "i d i o t", "abcabc abd", "cabab", "xyz", "a", "Über-Größe 12\tü", "日本語の文章です。日本"]
    plain = [" idiot ", " idiot ", " idxiot ", " idiot ", " abcabc abd ", " cabab ", " xyz ", " a ", " übergröße 12 ü ", " 日本語の文章です "]
    s = toxicity.Sentences(texts)
    first = [int(np.nonzero(s.of == i)[0][0]) for i in range(len(texts))]
    assert [s.text(i) for i in first] == plain and len(s.of) == len(texts) + 1
    got = toxicity.kernel(s, np.array(first), s, np.array(first))
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            x, y = _subsequences(a), _subsequences(b)
            want = sum(w * y.get(u, 0) for u, w in x.items()) / np.sqrt((toxicity.SOFT + len(a) - 1) * (toxicity.SOFT + len(b) - 1))
            assert np.isclose(got[i, j], want, atol=1e-6), (a, b)


def _fingerprint(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(run, text):
    d = run("op6_simhash")
    fp = {i: _fingerprint(t) for i, t in text.items()}
    assert list(d.fingerprint) == [f"{fp[i]:016x}" for i in d.doc_id]
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert list(d.component_id) == _unions(list(fp), near) and len(near) > 8


def test_simhash_finds_all_links(spark):
    draw = np.random.default_rng(6)
    # correlated bits, chains, and a crowd within few bits of one value, larger than a block
    base = draw.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = list(base) + [int(b) ^ int(sum(1 << int(i) for i in draw.choice(64, draw.integers(1, 5), replace=False))) for b in base for _ in range(4)]
    fps += [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    fps = sorted({int(f) for f in fps})
    ids = list(range(len(fps)))
    x = np.array(fps, np.uint64)
    near = [(i, int(j)) for i in ids for j in np.nonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3)[0] + i + 1]
    want = _unions(ids, near)
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(x.view(np.int64))], "fp bigint, rep bigint")
    got = {r.node: r.component_id for r in components(simhash.links(df)).collect()}
    assert [got.get(i, i) for i in ids] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 200)] + [(5, 5), (300, 301), (301, 300)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 200)}, 301: 300}


def test_embeddings(run, frames):
    d, e = run("op7_embeddings"), frames["embeddings"]
    ok = [v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in e.embedding]
    ids = [i for i, o in zip(e.vec_id, ok, strict=True) if o]
    x = np.stack([np.array(v, np.float32).astype(float) for v, o in zip(e.embedding, ok, strict=True) if o])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    links = dict(zip(ids, near.sum(1), strict=True))
    comp = dict(zip(ids, _unions(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)]), strict=True))
    assert d.n_links.sum() >= 0.9 * sum(links.values()) and all(d.n_links <= [links.get(i, 0) for i in d.vec_id])
    assert list(d.component_id) == [comp.get(i, i) for i in d.vec_id] and all(d.kept == (d.vec_id == d.component_id))


def test_quality(run):
    d = run("op9_quality")
    assert all(d.held_out == [crc(i) % 4 == 2 for i in d.doc_id]) and d.score.between(0, 1).all() and all(d.predicted == (d.score >= 0.7))
    draw = np.random.default_rng(8)
    x = draw.random((1500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells by itself
    m = quality.Additive.fit(x[:1000], y[:1000], n_pairs=1)
    right = lambda m: ((m.score(x[1000:]) > 0.5) == y[1000:]).mean()
    assert right(m) > 0.85 and m.pairs == [(1, 0)] and right(quality.Additive.fit(x[:1000], y[:1000], n_pairs=0)) < 0.65
    assert np.allclose(quality.Additive.fit(x, np.ones(1500)).score(x), 1501 / 1502)


def test_exact_dedup(spark, run, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(exact_dedup.OP10_SQL).df().sort_values("doc_id").reset_index(drop=True)
    d = run("op10_exact_dedup")
    for c in want:
        assert list(d[c]) == list(want[c])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = exact_dedup.dedup(docs, keep="largest")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(d.doc_id[d.kept])
    twice = exact_dedup.dedup(docs.unionByName(docs), keep="smallest")
    assert twice.count() == d.kept.sum()


def test_index_compacts(spark):
    index = exact_dedup.DigestIndex(spark, "smallest", fanout=3)
    for i in range(7):
        index.flush(index.memtable(spark.range(i * 10, i * 10 + 10).selectExpr("unhex(sha2(cast(id % 25 as string), 256)) digest", "id")))
    assert [len(level) for level in index.levels] == [1, 2]
    seen = {r.id: r.n for r in index.view().collect()}
    assert set(seen) == set(range(25)) and sum(seen.values()) == 70


def test_index_skips_runs(spark):
    """Runs out of range, or without any of the digests by their filters, aren't read; what is there is always found."""
    of = lambda low, high, first: spark.range(low, high).selectExpr(f"unhex(concat('{first}', substring(sha2(cast(id as string), 256), 3))) digest", "id")
    index = exact_dedup.DigestIndex(spark, "largest", fanout=9)
    for low, first in ((0, "11"), (2000, "11"), (4000, "ee")):
        index.flush(index.memtable(of(low, low + 2000, first)))
    assert index.probe(index.memtable(of(0, 0, "11"))) is None and (index.read, index.skipped) == (0, 0)
    got = index.probe(index.memtable(of(1990, 2010, "11")))
    assert got.count() == 20 and (index.read, index.skipped) == (2, 1)
    assert index.probe(index.memtable(of(9000, 9001, "11"))) is None and (index.read, index.skipped) == (2, 4)
    assert index.probe(index.memtable(of(0, 10, "aa"))) is None or index.skipped > 4
    every = index.probe(index.memtable(of(0, 4000, "11").unionByName(of(4000, 6000, "ee"))))
    assert every.count() == 6000
    some = index.probe(index.memtable(of(10_000, 11_000, "11").unionByName(of(5, 6, "11"))))
    assert some.count() == 1


def test_pipeline(spark, sf, empty, frames, run):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = corpus_pipeline.Scratch(spark, "test")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(scratch.table(stage(spark, kept[-1], sf)))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert kept[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    pred = run("op1_langid").set_index("doc_id")
    assert ids[1] == [i for i in ids[0] if pred.lang_pred[i] != "und" and pred.score[i] >= 0.5]
    largest = {text[i]: i for i in ids[1]}
    assert ids[2] == sorted(largest.values())
    # one of each group of texts whose five-word shingles have a similarity of 0.8 or more stays
    comp = _components({i: text[i] for i in ids[2]}, 0.8)
    assert ids[3] == sorted(set(comp.values())) and len(ids[3]) < len(ids[2])
    q = {r.doc_id: r.copies for r in mixing.queue(kept[3]).collect()}
    assert ids[4] == sorted(i for i, n in q.items() for _ in range(n))
    enc = _tiktoken()
    assert all(r.n_tokens == len(enc.encode_ordinary(text[r.doc_id])) for r in kept[5].collect())
    assert ids[5] == ids[4]
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_whole_vectors_and_plans():
    p = embeddings.Plan(16, 1000, 0.95)
    assert p.tables >= 4 and 0 < p.least < embeddings.COUNTED
