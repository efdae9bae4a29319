"""One pass over each file, detectors in Python, broken sections, failed downloads, packed cells, batches that run again."""

import os
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from veilscan.functions import values as V
from veilscan.operators.detect import DETECTORS, PythonDetector, ScanConfig, detect, only_email
from veilscan.operators.scan import folder_rows, results, scan_binary, scan_rows, tables
from veilscan.sources import cloud, extract
from veilscan.sources.state import State
from tests.test_scan import zipped


def test_each_file_is_read_once(spark, tmp_path, monkeypatch):
    folder, marks = tmp_path / "in", tmp_path / "marks"
    for d in (folder, marks):
        d.mkdir()
    for i in range(5):
        (folder / f"{i}.txt").write_text(f"a{i}@b.com 010-1234-567{i}" if i else "nothing")

    def counting(data, marks=str(marks)):
        import uuid

        open(os.path.join(marks, f"{data[:2].decode()}-{uuid.uuid4().hex}"), "w").close()
        return extract.plain(data)

    monkeypatch.setitem(extract.EXTRACTORS, ".txt", counting)
    held = str(tmp_path / "held")
    # workers that were forked before don't know the counting one: the stage is run here
    listed = spark.createDataFrame([(str(folder / f"{i}.txt"), i) for i in range(5)], "path string, file_seq bigint")
    rows = [extract.extracted(r.path, lambda p=r.path: extract._read(p)) for r in listed.collect()]
    assert len(list(marks.iterdir())) == 5 and all(r["text"] for r in rows)
    long = folder_rows(spark, [str(folder)])
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("BatchScan") == 1
    long.write.parquet(held)
    (folder / "00.txt").write_text("late@b.com")  # a file that appears later shifts no finding
    scan = tables(spark.read.parquet(held))
    got = {os.path.basename(r.path): r.n for r in scan.files.join(scan.hits.groupBy("path").agg(F.count("*").alias("n")), "path", "left").collect()}
    assert got == {"0.txt": None, **{f"{i}.txt": 2 for i in range(1, 5)}}


def _shout(text):
    return [(m.start(), m.end(), V.EXPOSED, "W***", V.PRESUMED) for m in re.finditer("WORD", text)]


def _fail(text):
    raise KeyError(text)


def test_detectors_in_python(spark):
    config = ScanConfig(python=(PythonDetector("word", "낱말", V.LOW, _shout), PythonDetector("broken", "고장", V.LOW, _fail)))
    df = spark.createDataFrame([("d/a.txt", b"x\nWORD a@b.com\nWORD"), ("d/b.txt", b"none")], "path string, content binary")
    got = {r.path: r for r in scan_binary(df, config).collect()}
    assert [(h.pii_type, h.snippet, h.location) for h in got["d/a.txt"].hits] == [(V.EMAIL, "a*@b.com", "L2"), ("낱말", "W***", "L2"), ("낱말", "W***", "L3")]
    assert got["d/a.txt"].partial_detection == got["d/b.txt"].partial_detection == ["broken(KeyError)"]
    assert got["d/b.txt"].error == "탐지 일부 실패: broken(KeyError)" and got["d/b.txt"].hits == []


def test_sections_of_any_name_with_bad_bytes():
    p = "<hp:p><hp:run><hp:t>{}</hp:t></hp:run></hp:p>".format
    data = zipped(**{"Contents__section1.xml": p("one"), "Contents__section_extra.xml": b"<hp:p><hp:t>t\xffwo</hp:t></hp:p>", "Contents__section0.xml": "<hp:p/>", "Contents__header.xml": p("no")})
    assert extract.hwpx(data)[0] == "\none\nt�wo\n"
    assert extract.hwpx(zipped(Contents__section0__xml=""))[0] == ""
    assert extract.hwpx(zipped(**{"Contents__section0.xml": "<t>a<b/>&amp;lt;&amp;quot;</t><t>c", "Contents__section1.xml": ""}))[0] == 'a&lt;"\n'


def test_cells_are_packed():
    tracemalloc.start()
    cells, n = extract.Cells(), 200_000
    cells.open("Sheet1")
    for i in range(n):
        if i == n // 2:
            cells.open("다른 시트")
        cells.add(i * 7, i + 1, i % 300 + 1)
    packed = cells.arrow()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / n < 40
    assert cells[0] == (0, "Sheet1", 1, 1) and cells[n - 1] == (7 * (n - 1), "다른 시트", n, (n - 1) % 300 + 1) and len(packed[0]["start"]) == n


def test_email_is_linear_and_the_same(spark):
    plain = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
    texts = ["a@b.com1x@c.de", "a@b..co m", "x@y x@y.zz@q.ww", "..@-.aa", "a@b.c@d.ee", "é@a.bb a@a.bé", "%%a@b.com.c1.dd9@x.yy", "a" * 300 + "@b", "@a.bb", "a@a.b1.ccd-e@f.gg"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.start, r.end) for r in detect(spark.createDataFrame(rows, "doc_id int, text string"), config=only_email(), keep=["doc_id"]).collect()}
    assert got == {(i, *m.span()) for i, t in rows for m in plain.finditer(t)}
    long = spark.createDataFrame([(0, "a" * 1_000_000 + " b@c.de")], "doc_id int, text string")
    began = time.time()
    assert detect(long, config=only_email(), keep=["doc_id"]).count() == 1
    assert time.time() - began < 20  # minutes, if runs were tried from each of their letters


class Failing(cloud.JsonPages):
    def download(self, name):
        raise PermissionError("secret name")


def test_failed_downloads_are_told_by_type(spark, monkeypatch):
    monkeypatch.setitem(cloud.CLIENTS, "failing", Failing)
    files = spark.createDataFrame([("/d/a.txt", "0:0", 1)], "path string, name string, file_seq bigint")
    rows = [extract._one({"path": "/d/a.txt", "failure": "PermissionError"}.get, True, ())]
    assert rows[0]["error"] == "추출 실패: PermissionError" and extract._one({"path": "/d/a.bin", "failure": "X"}.get, True, ()) is None
    held = files.select("path", "file_seq", F.lit(None).cast("binary").alias("content"), F.lit("AuthError").alias("failure"))
    got = results(scan_rows(extract.texts(held), ScanConfig())).first()
    assert got.error == "추출 실패: AuthError" and got.hits == []


def test_a_batch_that_runs_again_keeps_its_results(spark, tmp_path):
    state = State(spark, "again", str(tmp_path))
    rows = spark.createDataFrame([("a", None, False, 0, []), ("b", None, False, 0, [])], V.STATE)
    state.write(rows, "3")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert {r.path for r in state.undone(files).collect()} == {"c"}
    assert {r.path for r in state.undone(files, "3").collect()} == {"a", "b", "c"}
    assert [f.name for f in state.paths().schema] == ["path"]


def test_generated_code_compiles(spark):
    """All kinds at once: no stage is too large for generated code."""
    df = spark.createDataFrame([(1, "900101-1234568 a@b.com 010-1234-5678")], "doc_id int, text string")
    config = ScanConfig(enabled=frozenset(DETECTORS), reference_year=2026)
    found = detect(df, config=config, keep=["doc_id"])
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(found._jdf.queryExecution().executedPlan())
    assert found.count() == 3
    for i in range(stages.size()):
        assert stages.apply(i)._3().maxMethodCodeSize() < 65_536


@pytest.mark.parametrize("n", [0, 3])
def test_without_detectors(spark, n):
    df = spark.createDataFrame([(i, "a@b.com") for i in range(n)], "doc_id int, text string")
    assert detect(df, config=ScanConfig(disabled=frozenset(DETECTORS)), keep=["doc_id"]).count() == 0


def test_demo_files(spark, tmp_path):
    from veilscan.sources.demo import build_demo

    assert [os.path.basename(p) for p in build_demo(str(tmp_path))] == ["members.txt", "contract.txt"]
    kinds = {h.pii_type for r in results(folder_rows(spark, [str(tmp_path)], ScanConfig(reference_year=2026))).collect() for h in r.hits}
    assert kinds == {V.RRN, V.PHONE, V.EMAIL, V.LANDLINE, V.PASSPORT, V.DRIVER}


def test_caps_are_told(spark, tmp_path):
    from veilscan.operators import report as R
    from veilscan.sinks.reports import write_html, write_xlsx

    files = [(f"f{i}.docx", extract.OLE) for i in range(5)] + [(f"g{i}.docx", b"PK") for i in range(4)]
    scan = tables(scan_rows(extract.texts(spark.createDataFrame([(p, i, c) for i, (p, c) in enumerate(files)], "path string, file_seq bigint, content binary")), ScanConfig()))
    s = R.summarise(scan.files, scan.hits)
    write_xlsx(scan, s, str(tmp_path / "r.xlsx"), cap=3)
    write_html(scan, s, str(tmp_path / "r.html"), cap=3)
    told = extract.xlsx((tmp_path / "r.xlsx").read_bytes())[0].split("\n")
    assert told[told.index("errors 생략 건수 (files 폴더의 Parquet 에 모두 있음)") + 1] == "1"
    assert told[told.index("encrypted 생략 건수 (files 폴더의 Parquet 에 모두 있음)") + 1] == "2"
    assert "암호 파일 2건은" in (tmp_path / "r.html").read_text(encoding="utf-8")
