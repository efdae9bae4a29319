"""Folders, extractors, filters, reports, the state and the command line, end to end."""

import base64
import datetime
import io
import json
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from veilscan import cli
from veilscan.functions import values as V
from veilscan.operators import report as R
from veilscan.operators.corp_filter import mark_corp
from veilscan.operators.detect import ScanConfig
from veilscan.operators.scan import scan_binary, scan_folders, split
from veilscan.sinks.xlsx import write_workbook
from veilscan.sources import cloud, extract
from veilscan.sources.folders import listing
from veilscan.sources.state import State

MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
RAW = ["900101-1234568", "900101-5234561", "M12345678", "11-12-345678-90", "010-1234-5678", "02-123-4567", "hong.gildong@example.com"]


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def hwpx(*sections):
    return zipped(**{f"Contents__section{i}.xml": s for i, s in enumerate(sections)})


def docx(body):
    return zipped(**{"word__document.xml": f'<w:document xmlns:w="{MAIN}"><w:body>{body}</w:body></w:document>'})


def book(tmp_path, rows):
    write_workbook(str(tmp_path / "b.xlsx"), [("Sheet1", rows)])
    return (tmp_path / "b.xlsx").read_bytes()


def test_extractors(tmp_path):
    assert extract.plain("가나".encode("cp949"))[0] == extract.plain("가나".encode())[0] == "가나"
    assert extract.plain(b"\xff\xff\xff")[0] == "�" * 3
    p = lambda *runs: "<hp:p>" + "".join(f"<hp:run><hp:t>{r}</hp:t></hp:run>" for r in runs) + "</hp:p>"
    assert extract.hwpx(hwpx(p("900101") + p("1123459")))[0] == "900101\n1123459\n"
    assert extract.hwpx(hwpx(p("900101", "1123459")))[0] == "9001011123459\n"
    assert extract.hwpx(hwpx(p("900101"), p("a&amp;quot;b")))[0] == '900101\na"b\n'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    assert extract.docx(docx(f"<w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr>{cell('two')}{cell('three')}</w:tr></w:tbl>"))[0] == "one\ntwo\nthree"
    text, kind, cells = extract.xlsx(book(tmp_path, [["x", None, 1.5], [], [None, None, "y"]]))
    assert (text, kind, cells) == ("x\n1.5\ny", "cell", [(0, "Sheet1", 1, 1), (2, "Sheet1", 1, 3), (6, "Sheet1", 3, 3)])
    with pytest.raises(extract.Encrypted):
        extract.xlsx(extract.OLE + b"rest")
    row = extract.extracted("a.docx", lambda: b"PK..")
    assert row["error"] == "추출 실패: BadZipFile" and not row["encrypted"]
    assert extract.extracted("._a.jpg", lambda: extract.APPLE_DOUBLE) is None
    assert extract.extracted("a.doc", lambda: b"") is None
    assert extract.extracted("a.pdf", lambda: b"")["error"] == "추출 실패: ValueError"
    with pytest.raises(TimeoutError):
        extract.timed(lambda: [None for _ in iter(int, 1)], 0.2)


def test_breadcrumb(tmp_path, monkeypatch):
    monkeypatch.setenv("VEILSCAN_BREADCRUMB_DIR", str(tmp_path))
    seen = []
    extract.extracted("a.txt", lambda: seen.append(next(tmp_path.iterdir()).read_text()) or b"x")
    assert seen == ["a.txt"] and not list(tmp_path.iterdir())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / ".git").mkdir(parents=True)
    (root / "sub").mkdir()
    (root / ".git" / "x.txt").write_text(RAW[0])
    (root / "a.txt").write_text("\n".join(RAW), encoding="utf-8")
    (root / ".hidden.TXT").write_text(RAW[6])
    (root / "skip.bin").write_text(RAW[0])
    (root / "sub" / "bad.docx").write_text(RAW[0])
    (root / "sub" / "sealed.xlsx").write_bytes(extract.OLE)
    (root / "sub" / "corp.xlsx").write_bytes(book(tmp_path, [[None, n, None, RAW[6] if i == 0 else None] for i, n in enumerate(["110111-1000481", "110111-1000572", "110111-1000621", "110111-1000663"])]))
    return str(root)


def test_folders(spark, tree, tmp_path):
    rows = {os.path.basename(r.path): r for r in scan_folders(spark, [tree, str(tmp_path / "missing"), f"{tree}/a.txt"], ScanConfig(reference_year=2026)).collect() if not r.unreadable}
    assert set(rows) == {"a.txt", ".hidden.TXT", "bad.docx", "sealed.xlsx", "corp.xlsx"}
    assert [h.pii_type for h in rows["a.txt"].hits] == [V.RRN, V.PASSPORT, V.DRIVER, V.PHONE, V.LANDLINE, V.EMAIL]
    assert [h.location for h in rows["a.txt"].hits] == ["L1", "L3", "L4", "L5", "L6", "L7"]
    assert rows["bad.docx"].error == "추출 실패: BadZipFile" and rows["sealed.xlsx"].encrypted and not rows["sealed.xlsx"].error
    assert rows["corp.xlsx"].corp_filtered == 4 and [(h.pii_type, h.location) for h in rows["corp.xlsx"].hits] == [(V.EMAIL, "Sheet1!D1")]
    gone = listing(spark, [tree, str(tmp_path / "missing"), f"{tree}/a.txt"]).filter("reason is not null").collect()
    assert sorted(r.reason for r in gone) == ["접근 실패: 경로 없음", "접근 실패: 디렉터리가 아님"]


def test_binary(spark):
    df = spark.createDataFrame([("d/a.txt", b"a@b.com"), ("d/b.bin", b"a@b.com")], "path string, content binary")
    assert [(r.path, len(r.hits)) for r in scan_binary(df).collect()] == [("d/a.txt", 1)]


@pytest.mark.parametrize("label,suspects,n,dropped", [("편집 2!AZ", 3, 3, 3), ("Sheet1!C", 1, 10, 0), ("S!A", 2, 2, 0), ("S!A", 4, 5, 4), ("S!A", 13, 15, 13), ("S!A", 2, 3, 0), ("S!A", 7, 10, 7)])
def test_corp_columns(spark, label, suspects, n, dropped):
    rows = [("f", f"{label}{i + 1}", V.RRN, i < suspects) for i in range(n)] + [("f", x, V.RRN, True) for x in ("L5", "p.3 L12", None)] * 3
    df = spark.createDataFrame(rows, "path string, location string, pii_type string, corp_suspect boolean")
    assert mark_corp(df).filter("corp_dropped").count() == dropped


def hits(spark, rows):
    return spark.createDataFrame([("f", i, 0, i, t, s) for i, (t, s) in enumerate(rows)], "path string, file_seq bigint, det_seq int, start int, pii_type string, status string")


def test_budget(spark):
    kept = lambda rows, cap: [(r.pii_type, r.status) for r in R.row_budget(hits(spark, rows), cap).orderBy("file_seq").collect()]
    assert len(kept([(V.PHONE, V.EXPOSED)] * 5, 3)) == 3
    assert (V.RRN, V.EXPOSED) in kept([(V.EMAIL, V.EXPOSED)] * 10 + [(V.RRN, V.EXPOSED)], 3)
    assert (V.RRN, V.EXPOSED) in kept([(V.RRN, V.MASKED)] * 10 + [(V.RRN, V.EXPOSED)], 3)
    rows = [(V.EMAIL, V.EXPOSED), (V.RRN, V.MASKED), (V.RRN, V.EXPOSED), (V.PHONE, V.MASKED)] * 900
    many = R.row_budget(hits(spark, rows), 1900).groupBy("pii_type", "status").count().collect()
    assert {(r.pii_type, r.status): r["count"] for r in many} == {(V.RRN, V.EXPOSED): 900, (V.RRN, V.MASKED): 900, (V.EMAIL, V.EXPOSED): 50, (V.PHONE, V.MASKED): 50}


def placed(spark, rows):
    return spark.createDataFrame([("f", *r) for r in rows], "path string, file_seq bigint, det_seq int, start bigint, pii_type string, status string")


def test_budget_by_places(spark):
    """Files counted, numbered by hashes, without a number and with many findings; each cap against a plain sort."""
    draw = random.Random(7)
    files = [0, 1, 1023, 1024, 5 << 33, (5 << 33) + 1, -3, 2**62 + 12345, 2**62 + 12346, None]
    starts = [None, 0, 1, 65535, 65536, 2**31 - 1, 2**40]
    places = {(f, draw.randrange(6), draw.choice(starts) if draw.random() < 0.5 else draw.randrange(300_000)) for f in files for _ in range(60)}
    rows = [(*p, draw.choice([V.RRN, V.DRIVER, V.EMAIL, V.PHONE, None]), draw.choice([V.EXPOSED, V.MASKED, None])) for p in sorted(places, key=str)]
    last = lambda x: (x is None, x or 0)
    tier = lambda kind, status: 2 if kind not in (*V.KEY_TYPES, None) else 0 if status == V.EXPOSED else 1
    ordered = sorted(rows, key=lambda r: (tier(r[3], r[4]), last(r[0]), r[1], last(r[2])))
    df = placed(spark, rows).cache()
    for cap in (0, 2, 250, len(rows) - 1, len(rows) + 5):
        got = [tuple(r)[1:] for r in R.row_budget(df, cap).collect()]
        assert sorted(got, key=str) == sorted(ordered[:cap], key=str), cap


def test_budget_moves_few_rows(spark):
    """All findings in two files: what moves and is ranked does not grow with them."""
    df = spark.range(0, 400_000, 1, 8).selectExpr("'f' as path", "id % 2 as file_seq", "cast(id % 3 as int) as det_seq", "id as start", f"if(id % 5 = 0, '{V.EMAIL}', '{V.RRN}') as pii_type", f"'{V.EXPOSED}' as status")
    context = spark.sparkContext._jsc.sc()
    store, told = context.statusStore(), lambda: context.listenerBus().waitUntilEmpty(30_000)
    told()
    before = max((s.stageId() for s in _stages(store)), default=-1)
    assert len(R.row_budget(df, 1000).collect()) == 1000
    told()
    assert sum(s.shuffleReadRecords() for s in _stages(store) if s.stageId() > before) < 50_000


def _stages(store):
    every = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [every.apply(i) for i in range(every.size())]


def test_summary(spark):
    files = spark.createDataFrame([("a", None, False, False, 0), ("b", "추출 실패: X", False, False, 0), ("c", None, True, False, 0), ("d", "접근 실패: 경로 없음", False, True, 0)], "path string, error string, encrypted boolean, unreadable boolean, corp_filtered int")
    s = R.summarise(files, hits(spark, [(V.RRN, V.EXPOSED), (V.RRN, V.EXPOSED), (V.EMAIL, V.MASKED)]))
    assert (s.total_files, s.error_files, s.encrypted_files, s.unreadable_paths, s.exposed, s.masked, round(s.masking_rate, 1)) == (3, 1, 1, 1, 2, 1, 33.3)
    assert R.summarise(files.limit(0), hits(spark, []).limit(0) if False else hits(spark, [(V.RRN, V.EXPOSED)]).limit(0)).masking_rate == 100.0
    assert R.stamp(s, ScanConfig(), datetime.datetime(2026, 1, 2, 3, 4, 5, 6)).scanned_at == "2026-01-02T03:04:05"


def read_all(folder):
    out = b""
    for d, _, names in os.walk(folder):
        for n in names:
            data = open(os.path.join(d, n), "rb").read()
            out += data
            if n.endswith(".xlsx"):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    out += b"".join(z.read(x) for x in z.namelist())
    return out


def test_command_line(spark, tree, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli._local([tree, "--out", out, "--enable", "foreign"], spark) == 0
    assert cli._local([tree, str(tmp_path / "no"), "--out", out], spark) == 3
    told = read_all(out)
    assert not [r for r in RAW if r.encode() in told or r.replace("-", "").encode() in told]
    assert "ho*****@example.com".encode() in told and "접근 실패".encode() in told
    assert "접근 실패" in capsys.readouterr().err
    for bad in (["x"], ["x", "--out", out, "--disable", "nothing"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2


def test_html_is_escaped(spark, tmp_path):
    from veilscan.sinks.reports import write_html, write_xlsx

    rows = scan_binary(spark.createDataFrame([("<b>\x01.txt", b"a@b.com")], "path string, content binary"))
    scan = split(rows)
    s = R.summarise(scan.files, scan.hits)
    write_html(scan, s, str(tmp_path / "r.html"))
    write_xlsx(scan, s, str(tmp_path / "r.xlsx"), cap=0)
    page = (tmp_path / "r.html").read_text(encoding="utf-8")
    assert "<b>\x01" not in page and "&lt;b&gt;�" in page
    text, _, _ = extract.xlsx((tmp_path / "r.xlsx").read_bytes())
    assert "findings 생략" in text


def pages(tmp_path, *more):
    folder = tmp_path / "pages"
    folder.mkdir(exist_ok=True)
    for i, entries in enumerate(more):
        (folder / f"{i}.json").write_text(json.dumps({"entries": [{"kind": k, "path": p, "content": base64.b64encode(c).decode()} for k, p, c in entries], "has_more": i + 1 < len(more)}))
    return str(folder)


def test_paged_scan_resumes(spark, tmp_path):
    state_dir, out = str(tmp_path / "state"), str(tmp_path / "out")
    first = [[("folder", "/d", b""), ("file", "/d/a.txt", RAW[0].encode()), ("file", "/d/x.bin", RAW[0].encode())], [], [("file", "/d/b.txt", b"a@b.com"), ("file", "/d/bad.docx", b"PK")]]
    run = lambda folder: cli._dropbox(["--root", "", "--out", out, "--scan-id", "s1"], spark, "json", {"folder": folder}, state_dir)
    assert run(pages(tmp_path, *first)) == 0
    rows = {r.path: r for r in State(spark, "s1", state_dir).results().collect()}
    assert set(rows) == {"/d/a.txt", "/d/b.txt", "/d/bad.docx"} and len(rows["/d/a.txt"].hits) == 1 and rows["/d/bad.docx"].error
    # a file met again isn't read again; a new page is
    assert run(pages(tmp_path, *first, [("file", "/d/a.txt", b"nothing"), ("file", "/d/c.txt", RAW[6].encode())])) == 0
    rows = {r.path: r for r in State(spark, "s1", state_dir).results().collect()}
    assert len(rows) == 4 and len(rows["/d/a.txt"].hits) == 1 and len(rows["/d/c.txt"].hits) == 1
    told = read_all(out) + read_all(state_dir)
    assert not [r for r in RAW if r.encode() in told]


def test_state_tolerates_bad_lines(spark, tmp_path):
    state = State(spark, "old", str(tmp_path))
    folder = tmp_path / "old" / "results" / "batch=0"
    folder.mkdir(parents=True)
    hit = {"pii_type": V.EMAIL, "status": V.EXPOSED, "snippet": "a*@b.com", "start": 0, "end": 7, "confidence": V.CONFIRMED, "risk": V.MEDIUM}
    good = [{"path": "a", "hits": [hit]}, {"path": "b", "error": None, "encrypted": False, "corp_filtered": 2, "hits": []}]
    bad = [{"hits": []}, {"path": "c", "hits": [hit | {"status": "?"}]}]
    (folder / "p.json").write_text("\n".join(map(json.dumps, good + bad)) + '\n{"path": "d", "hi')
    rows = state.results().collect()
    assert sorted(r.path for r in rows) == ["a", "b"] and next(r for r in rows if r.path == "a").hits[0].location is None
    for name in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            State(spark, name, str(tmp_path))


def test_retry():
    class RateLimitError(Exception):
        def __init__(self, backoff):
            self.backoff = backoff

    waits = []

    def failing(*errors):
        left = list(errors)

        def call():
            if left:
                raise left.pop(0)
            return 1

        return call

    assert cloud.retry(failing(RateLimitError(0), RateLimitError(None), ConnectionError(), TimeoutError()), sleep=waits.append, rand=lambda: 0.5) == 1
    assert waits == [0, 1.0, 1.5, 2.5]
    with pytest.raises(KeyError):
        cloud.retry(failing(KeyError()), sleep=waits.append)
    with pytest.raises(ConnectionError):
        cloud.retry(failing(*[ConnectionError()] * 5), sleep=waits.append)
    with pytest.raises(ValueError):
        cloud.retry(lambda: 1, most=0)


def test_members():
    class Team:
        def member(self, i, email, name):
            P = type("P", (), {})
            m = P()
            m.profile = P()
            m.profile.team_member_id, m.profile.email, m.profile.name, m.profile.status = i, email, P(), P()
            m.profile.name.display_name, m.profile.status._tag = name, "active"
            return m

        def team_members_list_v2(self):
            return type("R", (), {"members": [self.member("1", "A@x.com", "홍길동")], "has_more": True, "cursor": "c"})

        def team_members_list_continue_v2(self, cursor):
            return type("R", (), {"members": [self.member("2", "b@x.com", "홍길순")], "has_more": False, "cursor": "d"})

    assert cloud.find_member(Team(), email="a@X.com")["member_id"] == "1"
    assert cloud.find_member(Team(), name="길순")["member_id"] == "2"
    for kw in ({"name": "홍"}, {"email": "none@x.com"}):
        with pytest.raises(ValueError):
            cloud.find_member(Team(), **kw)


def test_credentials(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    path = cloud.save_credentials("k", "t", profile="p")
    assert os.stat(path).st_mode & 0o777 == 0o600 and cloud.load_credentials("p") == {"app_key": "k", "refresh_token": "t"}
    with pytest.raises(FileNotFoundError):
        cloud.load_credentials("q")
    assert cli._dropbox(["--root", "/", "--out", str(tmp_path)]) == 1
