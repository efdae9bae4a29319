"""Files to texts: each file is read by itself in an Arrow stage; what fails becomes a row that says so by the type of the
exception alone, since messages can quote the file."""

from __future__ import annotations

import datetime
import io
import os
import re
import threading
import zipfile
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame

from ..functions import values as V

OLE, APPLE_DOUBLE = bytes.fromhex("D0CF11E0A1B11AE1"), bytes.fromhex("00051607")
#: Parsers of other people's libraries are stopped after so many seconds.
TIMEOUT = 90
#: Characters of a text layer from which a PDF needs no recognition; pages recognised at most; pixels of a picture at most.
TEXT_LAYER, OCR_PAGES, OCR_PIXELS = 300, 300, 16_000_000


class Undelivered(Exception):
    """The file could not be fetched; kind: the type of what was raised there."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


class Encrypted(Exception):
    """The file has a password."""


class Unsupported(Exception):
    """Not a file of this kind: it isn't recorded."""


class Cells(Sequence):
    """The places of cells as packed numbers, 16 bytes each: (start, sheet, row, column)."""

    def __init__(self):
        self.start, self.row, self.col = array("q"), array("i"), array("i")
        self.first, self.sheet = array("i"), []

    def open(self, sheet: str) -> None:
        """What is added from now on is of this sheet."""
        self.first.append(len(self.start))
        self.sheet.append(sheet)

    def add(self, start: int, row: int, col: int) -> None:
        self.start.append(start)
        self.row.append(row)
        self.col.append(col)

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, i: int) -> tuple[int, str, int, int]:
        return self.start[i], self.sheet[bisect_right(self.first, range(len(self))[i]) - 1], self.row[i], self.col[i]

    def __eq__(self, other) -> bool:
        return list(self) == list(other)

    def arrow(self):
        """One value of CELLS."""
        import pyarrow as pa

        packed = [pa.array(np.frombuffer(a, f"i{a.itemsize}").astype(np.int32) if len(a) else [], pa.int32()) for a in (self.start, self.row, self.col, self.first)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (*packed, pa.array(self.sheet, pa.string()))]
        return pa.StructArray.from_arrays(lists, ["start", "row", "col", "first", "sheet"])


Extracted = tuple[str, str, Sequence]


def plain(data: bytes) -> Extracted:
    for codec in ("utf-8", "cp949", "euc-kr"):
        try:
            return data.decode(codec), "line", []
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "line", []


# The entities, in the order in which they are replaced.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"))


class _Section(HTMLParser):
    """A section's text, whatever its name space and however broken: runs as they follow, a line for each paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.run: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag.rpartition(":")[2] == "t" and self.run is None:
            self.run = []

    def handle_endtag(self, tag):
        name = tag.rpartition(":")[2]
        if name == "t" and self.run is not None:
            text, self.run = "".join(self.run), None
            for entity, char in _ENTITIES:
                text = text.replace(entity, char)
            self.out.append(text)
        elif name == "p" and self.run is None:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag.rpartition(":")[2] == "p" and self.run is None:
            self.out.append("\n")

    def handle_data(self, data):
        if self.run is not None:
            self.run.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def hwpx(data: bytes) -> Extracted:
    """Runs of text, a line for each paragraph, sections in the order of their names; bytes that are no UTF-8 are replaced."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if n.startswith("Contents/section") and n.endswith(".xml")):
            section = _Section()
            section.feed(z.read(name).decode("utf-8", "replace"))
            section.close()
            out += section.out
            if out and not out[-1].endswith("\n"):
                out.append("\n")
    return "".join(out), "line", []


def _sealed(data: bytes) -> None:
    if data[:8] == OLE:
        raise Encrypted


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraph(p) -> str:
    text = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    return "".join((e.text or "") if _local(e.tag) == "t" else text.get(_local(e.tag), "") for e in p.iter() if _local(e.tag) != "tabs")


def docx(data: bytes) -> Extracted:
    """Paragraphs of the body, then the cells of its tables. A merged cell counts in each place that it covers."""
    _sealed(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    out = [_paragraph(p) for p in body if _local(p.tag) == "p"]
    for table in (e for e in body if _local(e.tag) == "tbl"):
        above: list[str] = []
        for row in (e for e in table if _local(e.tag) == "tr"):
            cells: list[str] = []
            for cell in (e for e in row if _local(e.tag) == "tc"):
                prop = {_local(e.tag): next((v for k, v in e.attrib.items() if _local(k) == "val"), "") for t in cell if _local(t.tag) == "tcPr" for e in t}
                text = "\n".join(_paragraph(p) for p in cell if _local(p.tag) == "p")
                if prop.get("vMerge", "restart") != "restart" and len(cells) < len(above):
                    text = above[len(cells)]
                cells += [text] * int(prop.get("gridSpan") or 1)
            out += cells
            above = cells
    return "\n".join(out), "line", []


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _strings(z: zipfile.ZipFile, path: str) -> list[str]:
    if path not in z.namelist():
        return []
    return ["".join(t.text or "" for t in _shown(si)) for si in ElementTree.fromstring(z.read(path)) if _local(si.tag) == "si"]


def _shown(e) -> Iterator:
    """Text elements without phonetic ones."""
    for child in e:
        if _local(child.tag) == "t":
            yield child
        elif _local(child.tag) != "rPh":
            yield from _shown(child)


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    custom = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")) for e in root.iter() if _local(e.tag) == "numFmt"}
    date = lambda i: i in {*range(14, 23), *range(45, 48)} or bool(re.search("[dmhysDMHYS]", custom.get(i, "")))
    formats = [int(x.get("numFmtId", 0)) for e in root if _local(e.tag) == "cellXfs" for x in e]
    return {i for i, f in enumerate(formats) if date(f)}


def _value(cell, strings: list[str], dates: set[int], epoch: datetime.datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for e in cell if _local(e.tag) == "is" for t in _shown(e))
    raw = next((e.text for e in cell if _local(e.tag) == "v"), None)
    if raw is None or raw == "":
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return str(bool(int(raw)))
    if kind != "n":
        return raw
    x = float(raw) if re.search("[.eE]", raw) else int(raw)
    if int(cell.get("s", 0)) in dates:
        at = epoch + datetime.timedelta(seconds=round(x * 86_400))
        return str(at.time() if 0 <= x < 1 else at)
    return str(x)


def xlsx(data: bytes) -> Extracted:
    """Cells that have a value, sheet by sheet and row by row, a line and a place for each."""
    _sealed(data)
    parts, cells, at = [], Cells(), 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {e.get("Id"): (e.get("Type", ""), e.get("Target", "")) for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        at_1904 = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book)
        epoch = datetime.datetime(1904, 1, 1) if at_1904 else datetime.datetime(1899, 12, 30)
        shared = next((t for kind, t in rels.values() if kind.endswith("/sharedStrings")), "sharedStrings.xml")
        where = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        strings, dates = _strings(z, where(shared)), _date_styles(z)
        for sheet in (e for s in book if _local(s.tag) == "sheets" for e in s):
            kind, target = rels[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
            if not kind.endswith("/worksheet"):
                continue
            row = col = 0
            cells.open(sheet.get("name"))
            with z.open(where(target)) as f:
                for event, e in ElementTree.iterparse(f, ("start", "end")):
                    tag = _local(e.tag)
                    if tag == "row" and event == "start":
                        row, col = int(e.get("r", row + 1)), 0
                    elif tag == "row":
                        e.clear()
                    elif tag == "c" and event == "end":
                        m = re.fullmatch(r"([A-Z]+)\d+", e.get("r", ""))
                        col = _number(m.group(1)) if m else col + 1
                        value = _value(e, strings, dates, epoch)
                        if value is not None:
                            cells.add(at, row, col)
                            parts.append(value)
                            at += len(value) + 1
    return "\n".join(parts), "cell", cells


def timed(call: Callable, seconds: float = TIMEOUT):
    """call()'s result, or TimeoutError. It runs in a thread that is told to stop, some times over, when time is up."""
    import ctypes

    out: dict = {}

    def run():
        try:
            out["value"] = call()
        except BaseException as e:
            out["error"] = e

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    for _ in range(6):
        if not t.is_alive():
            break
        ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(t.ident), ctypes.py_object(TimeoutError))
        t.join(5)
    if "value" in out:
        return out["value"]
    raise out.get("error") or TimeoutError()


def xls(data: bytes) -> Extracted:
    import xlrd

    try:
        book = xlrd.open_workbook(file_contents=data)
    except xlrd.XLRDError as e:
        if "encrypt" in str(e).lower():
            raise Encrypted from None
        raise
    parts, cells, at = [], Cells(), 0
    for sheet in book.sheets():
        cells.open(sheet.name)
        for r in range(sheet.nrows):
            for c in range(sheet.ncols):
                value = sheet.cell_value(r, c)
                if value != "":
                    cells.add(at, r + 1, c + 1)
                    parts.append(str(value))
                    at += len(parts[-1]) + 1
    return "\n".join(parts), "cell", cells


def _recognised(picture) -> str:
    import pytesseract
    from PIL import Image

    Image.MAX_IMAGE_PIXELS = None  # large pages are made smaller here, not refused

    if picture.width * picture.height > OCR_PIXELS:
        by = (OCR_PIXELS / (picture.width * picture.height)) ** 0.5
        picture = picture.resize((max(1, int(picture.width * by)), max(1, int(picture.height * by))))
    return pytesseract.image_to_string(picture.convert("RGB"), lang="kor+eng", config="--psm 6")


def image(data: bytes) -> Extracted:
    if data[:4] == APPLE_DOUBLE:
        raise Unsupported
    from PIL import Image

    with Image.open(io.BytesIO(data)) as picture:
        return _recognised(picture), "line", []


def pdf(data: bytes) -> Extracted:
    """The text layer; a page by page recognition where that is short."""
    if not data:
        raise ValueError("empty")
    from pdfminer.high_level import extract_text
    from pdfminer.pdfdocument import PDFEncryptionError, PDFPasswordIncorrect

    try:
        text = timed(lambda: extract_text(io.BytesIO(data)))
    except (PDFEncryptionError, PDFPasswordIncorrect):
        raise Encrypted from None
    except Exception:
        text = ""
    if len(text.strip()) >= TEXT_LAYER:
        return text, "page", []
    from pdf2image import convert_from_bytes, pdfinfo_from_bytes
    from PIL import Image

    Image.MAX_IMAGE_PIXELS = None

    pages, out = pdfinfo_from_bytes(data, timeout=TIMEOUT)["Pages"], []
    for i in range(1, min(pages, OCR_PAGES) + 1):
        try:
            out.append(_recognised(convert_from_bytes(data, first_page=i, last_page=i, timeout=TIMEOUT)[0]))
        except Exception as e:
            out.append(f"[페이지 {i} OCR 실패: {type(e).__name__}]")
    if pages > OCR_PAGES:
        out.append(f"[OCR 생략: 전체 {pages}p 중 {OCR_PAGES}p만 처리(상한 {OCR_PAGES})]")
    return "\f".join([text] * bool(text.strip()) + out), "page", []


def hwp(data: bytes) -> Extracted:
    import tempfile

    from hwp5.hwp5txt import TextTransform
    from hwp5.xmlmodel import Hwp5File

    with tempfile.NamedTemporaryFile(suffix=".hwp") as f:
        f.write(data)
        f.flush()
        out = io.BytesIO()
        TextTransform().transform_hwp5_to_text(Hwp5File(f.name), out)
    return out.getvalue().decode("utf-8"), "line", []


EXTRACTORS: dict[str, Callable[[bytes], Extracted]] = {".txt": plain, ".csv": plain, ".hwpx": hwpx, ".docx": docx, ".xlsx": xlsx, ".xls": xls, ".pdf": pdf, ".hwp": hwp, ".png": image, ".jpg": image, ".jpeg": image}


def suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def extracted(path: str, read: Callable[[], bytes], python: Sequence = ()) -> dict | None:
    """A row of TEXTS without file_seq; None for what isn't recorded. python: detectors to run on the text, each by itself."""
    row = {"path": path, "text": None, "loc_kind": "line", "cells": Cells(), "error": None, "encrypted": False, "unreadable": False, "found": [], "failed": []}
    crumb = None
    if folder := os.environ.get("VEILSCAN_BREADCRUMB_DIR"):
        crumb = os.path.join(folder, f"{os.getpid()}-{threading.get_ident()}")
        try:
            with open(crumb, "w", encoding="utf-8") as f:
                f.write(path)
        except OSError:
            crumb = None
    try:
        if (call := EXTRACTORS.get(suffix(path))) is None:
            return None
        text, row["loc_kind"], row["cells"] = call(read())
        row["text"] = text.encode("utf-8", "replace").decode("utf-8")
        _found(row, python)
    except Unsupported:
        return None
    except Encrypted:
        row["encrypted"] = True
    except Exception as e:
        row["error"] = f"{V.EXTRACTION}{e.kind if isinstance(e, Undelivered) else type(e).__name__}"
    finally:
        if crumb:
            try:
                os.remove(crumb)
            except OSError:
                pass
    return row


def _found(row: dict, python: Sequence) -> None:
    for d in python:
        try:
            row["found"] += [dict(zip(("key", "start", "end", "status", "snippet", "confidence"), (d.key, *f), strict=True)) for f in d.find(row["text"])]
        except Exception as e:
            row["failed"].append(f"{d.key}({type(e).__name__})")


def texts(files: DataFrame, python: Sequence = ()) -> DataFrame:
    """files: path, file_seq; content where it is at hand (else workers open the path), failure (why there is none),
    reason (of a folder that can't be read: its row is passed on). Rows of TEXTS; files of an unknown kind are left
    out. One file at a time is held. python: detectors in Python."""
    columns = ["path", "file_seq", *(c for c in ("content", "failure", "reason") if c in files.columns)]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(V.TEXTS)
        rest = pa.schema([f for f in schema if f.name != "cells"])
        for b in batches:
            for i in range(b.num_rows):
                of = lambda c, b=b, i=i: b.column(columns.index(c))[i].as_py() if c in columns else None
                row = _one(of, "content" in columns, python)
                if row:
                    cells = row.pop("cells")
                    out = pa.RecordBatch.from_pylist([row | {"file_seq": of("file_seq")}], rest)
                    cells = (cells if isinstance(cells, Cells) else Cells()).arrow().cast(schema.field("cells").type)
                    yield pa.RecordBatch.from_arrays([cells if f.name == "cells" else out.column(f.name) for f in schema], schema=schema)

    return files.select(*columns).mapInArrow(run, V.TEXTS)


def _one(of: Callable, held: bool, python: Sequence) -> dict | None:
    path = of("path")
    if reason := of("reason"):
        return {"path": path, "text": None, "loc_kind": "line", "cells": Cells(), "error": reason, "encrypted": False, "unreadable": True, "found": [], "failed": []}

    def read() -> bytes:
        if kind := of("failure"):
            raise Undelivered(kind)
        return of("content") if held else _read(path)

    return extracted(path, read, python)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
