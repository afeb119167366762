"""Binary office files: the compound file that holds them, ``.xls`` workbooks of the 1997 format on, and the text of ``.doc``."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from doclake.sources.ooxml import DATE_FORMATS, Sheet, is_date_code, shown_number

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # sector numbers from here on mark something else
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class CompoundFile:
    """The streams of a compound file, by the last part of their name. Damage raises ValueError."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 0x1E)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        fats, directory, self.cutoff, mini_fat, _, more, _ = (struct.unpack_from("<I", data, at)[0] for at in (0x2C, 0x30, 0x38, 0x3C, 0x40, 0x44, 0x48))
        places = list(struct.unpack_from("<109I", data, 0x4C))
        seen = 0
        while more < _END and seen <= len(data) // self.size:
            *found, more = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            places += found
            seen += 1
        self.fat: list[int] = []
        for at in [p for p in places if p < _END][:fats]:
            self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(at))
        self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw)) if (raw := self._chain(mini_fat)) else []
        self.entries: dict[str, tuple[int, int]] = {}
        self.mini = b""
        listing = self._chain(directory)
        for at in range(0, len(listing) - 127, 128):
            n, kind = struct.unpack_from("<HB", listing, at + 64)
            name = listing[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
            start, length = struct.unpack_from("<II", listing, at + 116)
            if kind == 5:
                self.mini = self._chain(start)[:length]
            elif kind == 2:
                self.entries.setdefault(name, (start, length))

    def _sector(self, k: int) -> bytes:
        got = self.data[(k + 1) * self.size : (k + 2) * self.size]
        if not got:
            raise ValueError("a sector lies outside the file")
        return got.ljust(self.size, b"\0")

    def _chain(self, k: int) -> bytes:
        parts: list[bytes] = []
        while k < _END:
            if k >= len(self.fat) or len(parts) > len(self.fat):
                raise ValueError("a chain of sectors is broken")
            parts.append(self._sector(k))
            k = self.fat[k]
        return b"".join(parts)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ValueError(f"there is no stream {name}")
        start, length = self.entries[name]
        if length >= self.cutoff:
            return self._chain(start)[:length]
        parts: list[bytes] = []
        while start < _END:
            if start >= len(self.mini_fat) or len(parts) > len(self.mini_fat):
                raise ValueError("a chain of small sectors is broken")
            parts.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini_fat[start]
        return b"".join(parts)[:length]


# ── workbooks ────────────────────────────────────────────────────────────────────────────────────────────────────────────


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, data and its continuations) of the records from a place on."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 0x3C and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = kind, [body]
    if held:
        yield held


class _Strings:
    """Reads strings that may go on in further records, where a flag tells anew how characters are stored."""

    def __init__(self, parts: list[bytes], at: int):
        self.parts, self.k, self.at = parts, 0, at

    def _room(self) -> int:
        return len(self.parts[self.k]) - self.at

    def raw(self, n: int) -> bytes:
        out = b""
        while n:
            if not self._room():
                if self.k + 1 >= len(self.parts):
                    raise ValueError("a string ends early")
                self.k, self.at = self.k + 1, 0
            take = min(n, self._room())
            out += self.parts[self.k][self.at : self.at + take]
            self.at, n = self.at + take, n - take
        return out

    def text(self, width: int = 2) -> str:
        n = int.from_bytes(self.raw(width), "little")
        flags = self.raw(1)[0]
        runs = int.from_bytes(self.raw(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.raw(4), "little") if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if not self._room():
                wide = self.raw(1)[0] & 1
            take = min(n, max(1, self._room() // (2 if wide else 1)))
            out.append(self.raw(take * 2).decode("utf-16-le", "replace") if wide else self.raw(take).decode("latin-1"))
            n -= take
        self.raw(4 * runs + extra)
        return "".join(out)


def _rk(n: int) -> float:
    value = float(n >> 2 if n < 1 << 31 else (n >> 2) - (1 << 30)) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return value / 100 if n & 1 else value


def read_workbook(content: bytes, only: tuple[str, ...] = ()) -> list[Sheet]:
    """The worksheets of an ``.xls`` file in their order; encrypted and older files raise ValueError."""
    data = CompoundFile(content).stream("Workbook")
    if data[4:6] != b"\0\x06":
        raise ValueError("a workbook of an older format than 1997's")
    found, shared, styles, codes, from_1904 = [], [], [], {}, False
    for kind, parts in _records(data):
        body = parts[0]
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x85:
            (at,) = struct.unpack_from("<I", body)
            if body[5] == 0:
                found.append((at, _Strings([body], 6).text(1)))
        elif kind == 0xFC:
            reader = _Strings(parts, 8)
            shared = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == 0x22:
            from_1904 = body[:2] == b"\1\0"
        elif kind == 0x41E:
            codes[struct.unpack_from("<H", body)[0]] = _Strings([body], 2).text()
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x0A:
            break
    dated = {k for k, f in enumerate(styles) if f in DATE_FORMATS or is_date_code(codes.get(f, ""))}
    number = lambda value, style: shown_number(value, style in dated, from_1904)
    return [_sheet(Sheet(name), data, at, shared, number) for at, name in found if not only or name in only]


def _sheet(sheet: Sheet, data: bytes, at: int, shared: list[str], number) -> Sheet:
    depth, pending = 0, None
    for kind, parts in _records(data, at):
        body = parts[0]
        depth += (kind == 0x809) - (kind == 0x0A)
        if depth <= 0:
            break
        if depth > 1:  # a chart inside the sheet
            continue
        if kind == 0xE5:
            for r1, r2, c1, c2 in struct.iter_unpack("<4H", body[2 : 2 + 8 * struct.unpack_from("<H", body)[0]]):
                sheet.merges.append((r1 + 1, c1 + 1, r2 + 1, c2 + 1))
            continue
        if kind == 0x207 and pending:
            sheet.cells[pending] = _Strings(parts, 0).text()
            continue
        if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x205, 0x06):
            continue
        row, col, style = struct.unpack_from("<3H", body)
        place = row + 1, col + 1
        if kind == 0xFD:
            sheet.cells[place] = shared[struct.unpack_from("<I", body, 6)[0]]
        elif kind == 0x203:
            sheet.cells[place] = number(struct.unpack_from("<d", body, 6)[0], style)
        elif kind == 0x27E:
            sheet.cells[place] = number(_rk(struct.unpack_from("<I", body, 6)[0]), style)
        elif kind == 0xBD:
            for k, (s, n) in enumerate(struct.iter_unpack("<HI", body[4:-2])):
                sheet.cells[row + 1, col + 1 + k] = number(_rk(n), s)
        elif kind == 0x204:
            sheet.cells[place] = _Strings(parts, 6).text()
        elif kind == 0x205:
            sheet.cells[place] = ERRORS.get(body[6], "#N/A") if body[7] else str(bool(body[6]))
        elif body[12:14] != b"\xff\xff":
            sheet.cells[place] = number(struct.unpack_from("<d", body, 6)[0], style)
        elif body[6] == 0:
            pending = place
        elif body[6] in (1, 2):
            sheet.cells[place] = str(bool(body[8])) if body[6] == 1 else ERRORS.get(body[8], "#N/A")
    return sheet


# ── texts ────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def word_text(content: bytes) -> str:
    """The main text of a ``.doc`` file of the 1997 format on: paragraphs on lines, cells of a row parted by tabs.

    Of fields only the results stay. Footnotes, headers and comments are left out. Encrypted files raise ValueError.
    """
    file = CompoundFile(content)
    head = file.stream("WordDocument")
    if struct.unpack_from("<H", head)[0] != 0xA5EC:
        raise ValueError("not a word-processor file")
    (flags,) = struct.unpack_from("<H", head, 0x0A)
    if flags & 0x100:
        raise ValueError("the file is encrypted")
    (length,) = struct.unpack_from("<I", head, 0x4C)
    at, size = struct.unpack_from("<II", head, 0x1A2)
    pieces = file.stream("1Table" if flags & 0x200 else "0Table")[at : at + size]
    at = 0
    while at < len(pieces) and pieces[at] == 1:
        at += 3 + struct.unpack_from("<H", pieces, at + 1)[0]
    if at >= len(pieces) or pieces[at] != 2:
        raise ValueError("the file has no table of its pieces")
    table = pieces[at + 5 : at + 5 + struct.unpack_from("<I", pieces, at + 1)[0]]
    n = (len(table) - 4) // 12
    bounds, out = struct.unpack_from(f"<{n + 1}I", table), []
    for k in range(n):
        (place,) = struct.unpack_from("<I", table, 4 * (n + 1) + 8 * k + 2)
        chars = min(bounds[k + 1], length) - bounds[k]
        if chars > 0:
            start, narrow = place & 0x3FFFFFFF, place & 0x40000000
            out.append(head[start // 2 : start // 2 + chars].decode("cp1252", "replace") if narrow else head[start : start + 2 * chars].decode("utf-16-le", "replace"))
    return _plain("".join(out))


def _plain(text: str) -> str:
    """Marks as line ends and tabs; instructions of fields go, from the innermost one outwards."""
    before = None
    while before != text:
        before, text = text, re.sub("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x14\x15]*))?\x15", lambda m: m[1] or "", text)
    text = text.replace("\x07\x07", "\n").replace("\x07", "\t").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").replace("\xa0", " ").replace("\x1e", "-")
    return re.sub("[\x00-\x08\x0e-\x1f]", "", text).strip("\n")
