"""Detectors on hand-written texts, and their places on random ones against CPython's re."""

import random
import re

import pytest

from veilscan.functions import values as V
from veilscan.operators.detect import DETECTORS, ScanConfig, describe_detectors, detect

ALL = ScanConfig(enabled=frozenset({"foreign"}), reference_year=2026)

#: detector, text, reference year, expected (status, confidence, snippet, suspect)
CASES = [
    ("rrn", "성명 홍길동 900101-1234568 끝", 2026, [("노출", "confirmed", "900101-1******", False)]),
    ("rrn", "9001011234567", 2026, []),
    ("rrn", "900101-1******", 2026, [("마스킹", "confirmed", "900101-1******", False)]),
    ("rrn", "900101-*******", 2026, [("마스킹", "confirmed", "900101-*******", False)]),
    ("rrn", "900101-123****", 2026, [("노출", "추정", "900101-1******", False)]),
    ("rrn", "******-1234567", 2026, [("노출", "추정", "******-1******", False)]),
    ("rrn", "900101-5234561", 2026, []),
    ("rrn", "9013011234565", 2026, []),
    ("rrn", "9901013000007", 2026, []),
    ("rrn", "9901013000007", 2100, [("노출", "confirmed", "990101-3******", False)]),
    ("rrn", "990101-*123456", 2026, [("노출", "추정", "990101-*******", False)]),
    ("rrn", "9001011000006", 2026, [("노출", "추정", "900101-1******", True)]),
    ("rrn", "9001011000011", 2026, [("노출", "confirmed", "900101-1******", False)]),
    ("rrn", "2103153000000", 2026, [("노출", "추정", "210315-3******", False)]),
    ("rrn", "2103153000006", 2026, [("노출", "추정", "210315-3******", True)]),
    ("rrn", "2103153000001", 2026, [("노출", "confirmed", "210315-3******", False)]),
    ("rrn", "2008313000000", 2026, []),
    ("rrn", "2009013000000", 2026, [("노출", "추정", "200901-3******", False)]),
    ("rrn", "*" * 13, 2026, [("마스킹", "confirmed", "******-*******", False)]),
    ("foreign", "등록번호 900101-5234561 입니다", 2026, [("노출", "추정", "900101-5******", False)]),
    ("foreign", "900101-5******", 2026, [("마스킹", "confirmed", "900101-5******", False)]),
    ("foreign", "9901017000008", 2026, []),
    ("foreign", "900101-1234568", 2026, []),
    ("passport", "여권 M12345678 발급", 2026, [("노출", "추정", "M123*****", False)]),
    ("passport", "M123*****", 2026, [("마스킹", "추정", "M123*****", False)]),
    ("passport", "M123A4567", 2026, [("노출", "추정", "M123*****", False)]),
    ("passport", "M123A****", 2026, [("마스킹", "추정", "M123*****", False)]),
    *[("passport", t, 2026, []) for t in ("N11100123", "a12345678", "AM12345678", "M12345678A", "M123456789", "M********")],
    ("driver", "11-12-345678-90", 2026, [("노출", "추정", "1112-******-**", False)]),
    ("driver", "11-12-34****-**", 2026, [("마스킹", "추정", "1112-******-**", False)]),
    ("driver", "202401150001", 2026, []),
    ("driver", "34\n56\n789012\n11-12-345678-90", 2026, [("노출", "추정", "1112-******-**", False)]),
    ("phone", "010-1234-5678", 2026, [("노출", "confirmed", "010-****-5678", False)]),
    ("phone", "010-****-5678", 2026, [("마스킹", "confirmed", "010-****-5678", False)]),
    ("phone", "01012345678999", 2026, []),
    ("landline", "대표번호 02-123-4567", 2026, [("노출", "추정", "02-***-4567", False)]),
    ("landline", "010-123-4567", 2026, []),
    ("email", "hong.gildong@example.com", 2026, [("노출", "confirmed", "ho*****@example.com", False)]),
    ("email", "a@b.com", 2026, [("노출", "confirmed", "a*@b.com", False)]),
    ("email", None, 2026, []),
    ("email", "", 2026, []),
]


@pytest.mark.parametrize("year", [2026, 2100])
def test_cases(spark, year):
    cases = [(i, c[1]) for i, c in enumerate(CASES) if c[2] == year]
    got = detect(spark.createDataFrame(cases, "i int, text string"), config=ScanConfig(enabled=frozenset({"foreign"}), reference_year=year), keep=["i"]).collect()
    for i, _ in cases:
        key, _, _, want = CASES[i]
        assert [(r.status, r.confidence, r.snippet, r.corp_suspect) for r in got if r.i == i and r.pii_type == DETECTORS[key].pii_type] == want, CASES[i]


@pytest.mark.parametrize("key,number", [("rrn", "900101{}1234568"), ("foreign", "900101{}5234561"), ("driver", "11{0}12{0}345678{0}90")])
def test_separators(spark, key, number):
    seps = ["-", " ", "\t", "\xa0", "\n", "\r", "\f", "\v", " ", " "]
    rows = detect(spark.createDataFrame([(i, number.format(s)) for i, s in enumerate(seps)], "i int, text string"), config=ALL, keep=["i"]).collect()
    assert sorted(r.i for r in rows if r.pii_type == DETECTORS[key].pii_type) == [0, 1, 2, 3]


PY = {
    "rrn": r"(?<![0-9A-Za-z])[M]{6}[ \t\-\xa0]?[M]{7}(?![0-9])",
    "passport": r"(?<![A-Za-zM])(?:[MSRODT][M]{3}[A-ZN][M]{4}|[MSRODT][M]{8})(?![A-Za-zM])",
    "driver": r"(?<![0-9A-Za-z])[M]{2}[ \t\-\xa0][M]{2}[ \t\-\xa0][M]{6}[ \t\-\xa0][M]{2}(?![0-9])",
    "phone": r"(?<![0-9])01[016789][-\s]?[M]{3,4}[-\s]?\d{4}(?![0-9])",
    "landline": r"(?<![0-9])0\d{1,2}[-\s]?\d{3,4}[-\s]?\d{4}(?![0-9])",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
}


def _python(key):
    p = PY[key]
    p = p.replace("[MSRODT]", "\0").replace("[A-ZN]", f"[A-Z{V.MASK_CHARS}]").replace("A-Za-zM", f"A-Za-z0-9{V.MASK_CHARS}").replace("[M]", f"[0-9{V.MASK_CHARS}]")
    return re.compile(p.replace("\0", "[MSRODT]"))


def test_places_match_cpython(spark):
    from pyspark.sql import functions as F

    from veilscan.functions.spans import line_label, matches, page_label

    draw = random.Random(5)
    bits = ["900101-1234568", "01", "010", "02-123-4567", "-", " ", "\n", "\f", "\xa0", "\x1c", "😀", "가", "*", "x", "１", "٣", "1", "2345", "678", "M123", "A", "a.b@c.de", "@", ".", "M12345678", "11-12-345678-90", "L"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 40))) for _ in range(400)] + ["".join(draw.choices(bits, k=9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    for key in PY:
        d = DETECTORS[key]
        m = F.transform(matches("text", d.pattern, d.needs), lambda h: F.struct(h["s"], h["e"], h["v"], line_label(h).alias("l"), page_label(h).alias("p")))
        got = {r.i: [tuple(x) for x in r.m] for r in df.select("i", m.alias("m")).collect()}
        for i, t in enumerate(texts):
            want = []
            for x in _python(key).finditer(t):
                before = t[: x.start()]
                page = before[before.rfind("\f") + 1 :]
                want.append((x.start(), x.end(), x.group(), f"L{before.count(chr(10)) + 1}", f"p.{before.count(chr(12)) + 1} L{page.count(chr(10)) + 1}"))
            assert got[i] == want, (key, i)


def test_many_matches_in_one_text(spark):
    import time

    n = 60_000
    df = spark.createDataFrame([("\n".join(f"ab{i}@example.com" for i in range(n)),)], "text string")
    t = time.time()
    rows = detect(df, config=ScanConfig(disabled=frozenset(DETECTORS) - {"email"})).selectExpr("count(*) n", "max(cast(substring(location, 2) as int)) l").first()
    assert (rows.n, rows.l) == (n, n)
    assert time.time() - t < 30


def test_registry():
    on, off = describe_detectors(ScanConfig())
    assert len(on) == 6 and len(off) == 1 and off[0].startswith(V.FOREIGN)
    on, off = describe_detectors(ScanConfig(disabled=frozenset({"foreign"}), enabled=frozenset({"foreign"})))
    assert V.FOREIGN not in on and "--disable foreign" in off[0]
    with pytest.raises(ValueError):
        ScanConfig(disabled=frozenset({"nothing"}))


def test_all_disabled(spark):
    df = spark.createDataFrame([("a@b.com",)], "text string")
    assert detect(df, config=ScanConfig(disabled=frozenset(DETECTORS))).count() == 0
