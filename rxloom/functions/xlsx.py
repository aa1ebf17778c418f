"""Workbooks by the standard library: zip archives of XML parts, read and written row by row."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Characters that XML can't hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def column_name(i: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def cell(value: object) -> object:
    """A plain value for a cell: numbers of numpy as those of Python, what isn't a number as nothing."""
    value = value.item() if hasattr(value, "item") else value
    return None if value is None or value != value else value


def write(path: str, tabs: dict[str, tuple[list[str], Iterable[Iterable[object]]]]) -> None:
    """Tabs of (header, rows), streamed into the archive so that no tab is held at once."""
    names = list(tabs)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{_NS["r"]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="rId{i}" Type="{_NS["r"]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            header, rows = tabs[n]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'<worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
                for k, row in enumerate(_with_header(header, rows), 1):
                    out.write(f'<row r="{k}">{"".join(_cell(column_name(j) + str(k), v) for j, v in enumerate(row))}</row>'.encode())
                out.write(b"</sheetData></worksheet>")


def _with_header(header: list[str], rows: Iterable[Iterable[object]]) -> Iterator[Iterable[object]]:
    yield header
    yield from rows


def _cell(ref: str, value: object) -> str:
    value = cell(value)
    if value is None:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) != float("inf"):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNFIT.sub("", str(value)))}</t></is></c>'


def sheets(path: str) -> dict[str, str]:
    """Part of each sheet by name, in order."""
    with zipfile.ZipFile(path) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        return {s.get("name"): "xl/" + targets[s.get(f"{{{_NS['r']}}}id")].removeprefix("/xl/") for s in book.iterfind(".//m:sheet", _NS)}


def rows(path: str, part: str) -> Iterator[list[str | None]]:
    """Rows of a sheet as text, cells that are left out as None; read as a stream."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        with z.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                out: list[str | None] = []
                for c in row.iterfind("m:c", _NS):
                    at = column_number(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at - len(out))
                    v, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        out.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
                    else:
                        text = None if v is None else v.text
                        out.append(shared[int(text)] if kind == "s" and text else text)
                yield out
                row.clear()
