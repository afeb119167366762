"""Workbooks and word-processor files, read from their XML with the standard library."""

from __future__ import annotations

import datetime
import functools
import html
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@dataclass
class Sheet:
    name: str
    cells: dict[tuple[int, int], str | None] = field(default_factory=dict)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)


#: A part up to this size is parsed at once, and small parts up to the second one, which files of one maker share, only once.
WHOLE, SHARED = 1 << 20, 1 << 14


class Files:
    """The files in an archive by name. Plain archives are read by their directory; all others, and all damage, go to zipfile."""

    def __init__(self, content: bytes):
        self.content = content
        self.places = _places(content)
        self.other = None if self.places is not None else zipfile.ZipFile(io.BytesIO(content))

    def __contains__(self, name: str) -> bool:
        return name in self.places if self.places is not None else name in self.other.NameToInfo

    def read(self, name: str) -> bytes:
        place = self.places.get(name) if self.places is not None else None
        data = None if place is None else _unpacked(self.content, name, *place)
        if data is None:
            self.other = self.other or zipfile.ZipFile(io.BytesIO(self.content))
            return self.other.read(name)
        return data


_END, _ENTRY = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L")


def _places(content: bytes) -> dict[str, tuple[int, int, int, int, int]] | None:
    """(method, checksum, packed size, size, place) by name, or None for an archive that isn't plain: one with a comment, with
    something before it, with extra fields, encrypted, split, of 4 GB or more, or with names beyond ASCII."""
    end = len(content) - _END.size
    if end < 0:
        return None
    mark, disk, first, here, count, size, start, comment = _END.unpack_from(content, end)
    if mark != b"PK\5\6" or disk or first or comment or here != count or count == 0xFFFF or start + size != end:
        return None
    found, at, spans = {}, start, []
    for _ in range(count):
        if at + _ENTRY.size > end:
            return None
        mark, _, version, flags, method, _, _, crc, packed, whole, n, extra, note, disk, _, _, place = _ENTRY.unpack_from(content, at)
        raw = content[at + _ENTRY.size : at + _ENTRY.size + n]
        if mark != b"PK\1\2" or version > 63 or flags & ~0x80E or method not in (0, 8) or extra or note or disk or not raw.isascii() or b"\0" in raw or b"\\" in raw:
            return None
        found[raw.decode("ascii")] = method, crc, packed, whole, place
        spans.append((place, place + 30 + n + packed))
        at += _ENTRY.size + n
    spans.sort()
    if at != end or any(a[1] > b[0] for a, b in zip(spans, [*spans[1:], (start, 0)])):
        return None
    return found


def _unpacked(content: bytes, name: str, method: int, crc: int, packed: int, whole: int, place: int) -> bytes | None:
    """A file's bytes, or None where they aren't what the directory says."""
    n, extra = struct.unpack_from("<2H", content, place + 26)
    at = place + 30 + n + extra
    if content[place : place + 4] != b"PK\3\4" or content[place + 30 : place + 30 + n] != name.encode("ascii") or at + packed > len(content):
        return None
    data = content[at : at + packed]
    if method:
        try:
            data = zlib.decompressobj(-15).decompress(data, whole + 1)
        except zlib.error:
            return None
    return data if len(data) == whole and zlib.crc32(data) == crc else None


def _shared(parse: Callable) -> Callable:
    """``parse`` of a part's bytes, remembered for a few small parts; what it gives must not be changed."""
    remembered = functools.lru_cache(64)(parse)
    return functools.wraps(parse)(lambda part, *more: (remembered if len(part) <= SHARED else parse)(part, *more))


def _relations(files: Files, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    return _targets(files.read(path), folder) if path in files else {}


@_shared
def _targets(part: bytes, folder: str) -> dict[str, str]:
    out = {}
    for r in ET.fromstring(part):
        target = r.get("Target", "")
        out[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else target if r.get("TargetMode") == "External" else posixpath.normpath(f"{folder}/{target}")
    return out


@functools.lru_cache(1 << 14)
def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


#: Numbers of built-in formats that show dates or times.
DATE_FORMATS = frozenset({*range(14, 23), 45, 46, 47})


def is_date_code(code: str) -> bool:
    """Whether a number format's code shows a date or time."""
    return re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())) is not None


@_shared
def _date_styles(part: bytes) -> frozenset[int]:
    """Indices of cell styles that show dates or times."""
    root = ET.fromstring(part)
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_S}numFmt")}
    dated = DATE_FORMATS | {k for k, code in custom.items() if is_date_code(code)}
    formats = root.find(f"{_S}cellXfs")
    return frozenset() if formats is None else frozenset(i for i, x in enumerate(formats) if int(x.get("numFmtId", 0)) in dated)


@_shared
def _book(part: bytes) -> tuple[list[tuple[str | None, str | None]], bool]:
    """(name, relation) of each sheet in order, and whether days are counted from 1904."""
    book = ET.fromstring(part)
    props = book.find(f"{_S}workbookPr")
    return [(node.get("name"), node.get(f"{_R}id")) for node in book.iter(f"{_S}sheet")], props is not None and props.get("date1904") in ("1", "true")


def shown_number(value: float, dated: bool, from_1904: bool) -> str:
    if dated:
        start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
        return str(start + datetime.timedelta(seconds=round(value * 86400)))
    return str(int(value)) if value.is_integer() and abs(value) < 1e16 else repr(value)


def _strings(node: ET.Element) -> str:
    """The text of a string item, without phonetic hints."""
    return "".join(t.text or "" for r in node for t in ([r] if r.tag == f"{_S}t" else r.findall(f"{_S}t") if r.tag == f"{_S}r" else []))


def read_workbook(content: bytes, only: tuple[str, ...] = ()) -> list[Sheet]:
    """The sheets of an ``.xlsx`` file in their order; cells that hold nothing are missing."""
    files = Files(content)
    listed, from_1904 = _book(files.read("xl/workbook.xml"))
    targets = _relations(files, "xl/workbook.xml")
    shared = [_strings(si) for si in ET.fromstring(files.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in files else []
    dated = _date_styles(files.read("xl/styles.xml")) if "xl/styles.xml" in files else frozenset()
    sheets = []
    for name, relation in listed:
        if only and name not in only:
            continue
        sheet = Sheet(name or "")
        row_at = 0
        cells = sheet.cells
        for item in _rows(files.read(targets[relation])):
            if item.tag == _ROW:
                row_at = int(item.get("r", row_at + 1))
                place = row_at, 0
                for c in item.iter(_C):
                    ref = c.get("r")
                    place = _place(ref) if ref else (row_at, place[1] + 1)
                    cells[place] = _cell(c, shared, dated, from_1904)
            else:
                a, _, b = item.get("ref", "").partition(":")
                sheet.merges.append((*_place(a), *_place(b or a)))
        sheets.append(sheet)
    return sheets


_ROW, _C, _V, _IS, _T, _MERGE = (f"{_S}{tag}" for tag in ("row", "c", "v", "is", "t", "mergeCell"))


def _rows(part: bytes) -> Iterator[ET.Element]:
    """The rows and merges of a worksheet; of a large one a row at a time."""
    if len(part) <= WHOLE:
        root = ET.fromstring(part)
        yield from root.iter(_ROW)
        yield from root.iter(_MERGE)
        return
    for _, item in ET.iterparse(io.BytesIO(part)):
        if item.tag in (_ROW, _MERGE):
            yield item
            item.clear()


def _cell(c: ET.Element, shared: list[str], dated: frozenset[int], from_1904: bool) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        node = c.find(_IS)
        if node is None:
            return None
        return node[0].text or "" if len(node) == 1 and node[0].tag == _T else _strings(node)
    v = c.find(_V)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text == "1")
    if kind == "n":
        return shown_number(float(v.text), int(c.get("s", 0)) in dated, from_1904)
    return v.text


def sheet_names(content: bytes) -> list[str]:
    return [name or "" for name, _ in _book(Files(content).read("xl/workbook.xml"))[0]]


# ── word-processor files ─────────────────────────────────────────────────────────────────────────────────────────────────


@dataclass
class WordFile:
    html: str
    paragraphs: int


def _on(props: ET.Element | None, name: str) -> bool:
    node = None if props is None else props.find(f"{_W}{name}")
    return node is not None and node.get(f"{_W}val", "1") not in ("0", "false", "none")


def _run(run: ET.Element) -> str:
    text = ""
    for node in run:
        if node.tag == f"{_W}t":
            text += html.escape(node.text or "", quote=False)
        elif node.tag == f"{_W}tab":
            text += "\t"
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            text += "<br />"
    props = run.find(f"{_W}rPr")
    if text and _on(props, "i"):
        text = f"<em>{text}</em>"
    if text and _on(props, "b"):
        text = f"<strong>{text}</strong>"
    return text


def _inline(p: ET.Element, links: dict[str, str]) -> str:
    out = ""
    for node in p:
        if node.tag == f"{_W}r":
            out += _run(node)
        elif node.tag == f"{_W}hyperlink":
            inner, href = _inline(node, links), links.get(node.get(f"{_R}id", ""), "")
            out += f'<a href="{html.escape(href)}">{inner}</a>' if href else inner
        elif node.tag in (f"{_W}ins", f"{_W}smartTag", f"{_W}sdt", f"{_W}sdtContent"):
            out += _inline(node, links)
    return out


def _block(node: ET.Element, links: dict[str, str], levels: dict[str, int]) -> list[tuple[str, str]]:
    """(kind, html) of a paragraph or table: p, h1 to h6, li or table."""
    if node.tag == f"{_W}tbl":
        rows = []
        for tr in node.findall(f"{_W}tr"):
            cells = ["".join(_joined([b for child in tc for b in _block(child, links, levels)])) for tc in tr.findall(f"{_W}tc")]
            rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
        return [("table", "<table>" + "".join(rows) + "</table>")]
    if node.tag == f"{_W}sdt":
        return [b for content in node.findall(f"{_W}sdtContent") for child in content for b in _block(child, links, levels)]
    if node.tag != f"{_W}p":
        return []
    inner, props = _inline(node, links), node.find(f"{_W}pPr")
    style = None if props is None else props.find(f"{_W}pStyle")
    level = 0 if style is None else levels.get(style.get(f"{_W}val", ""), 0)
    if level:
        return [(f"h{level}", inner)]
    return [("li" if props is not None and props.find(f"{_W}numPr") is not None else "p", inner)]


def _joined(blocks: list[tuple[str, str]]) -> list[str]:
    out: list[str] = []
    for k, (kind, inner) in enumerate(blocks):
        if kind == "table":
            out.append(inner)
        elif inner:
            before, after = k and blocks[k - 1][0] == "li", k + 1 < len(blocks) and blocks[k + 1][0] == "li"
            text = f"<{kind}>{inner}</{kind}>"
            if kind == "li":
                text = ("" if before else "<ul>") + text + ("" if after else "</ul>")
            out.append(text)
    return out


@_shared
def _levels(part: bytes) -> dict[str, int]:
    """The levels of styles that are headings by name."""
    found = {}
    for s in ET.fromstring(part).iter(f"{_W}style"):
        name = s.find(f"{_W}name")
        m = re.fullmatch(r"(?i)heading ([1-6])", "" if name is None else name.get(f"{_W}val", ""))
        if m:
            found[s.get(f"{_W}styleId", "")] = int(m[1])
    return found


def read_word(content: bytes) -> WordFile:
    """The body of a ``.docx`` file as HTML, and how many of its paragraphs aren't blank; no headers or footers."""
    files = Files(content)
    body = ET.fromstring(files.read("word/document.xml")).find(f"{_W}body")
    links = _relations(files, "word/document.xml")
    levels = {f"Heading{n}": n for n in range(1, 7)} | {"Title": 1}
    if "word/styles.xml" in files:
        levels |= _levels(files.read("word/styles.xml"))
    blocks = [b for node in body for b in _block(node, links, levels)]
    count = sum(bool("".join(t.text or "" for t in p.iter(f"{_W}t")).strip()) for p in body.findall(f"{_W}p"))
    return WordFile("".join(_joined(blocks)), count)
