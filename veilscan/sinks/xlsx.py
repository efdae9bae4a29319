"""A workbook written row by row with the standard library; rows come from iterators and are never held together."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def safe(v: str) -> str:
    return _BAD.sub("�", v).encode("utf-8", "replace").decode("utf-8")


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(safe(str(v)))}</t></is></c>'


def write_workbook(path: str, sheets: Iterable[tuple[str, Iterable]]) -> None:
    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, rows) in enumerate(sheets, 1):
            names.append(name)
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                f.write(f"{_HEAD}<worksheet {_MAIN}><sheetData>".encode())
                for row in rows:
                    f.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                f.write(b"</sheetData></worksheet>")
        ids = range(1, len(names) + 1)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_MAIN} xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, names, strict=True)) + "</sheets></workbook>")
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in ids) + "</Types>",
        )
