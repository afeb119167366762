"""Small office files for tests; binary ones are put together record by record."""

from __future__ import annotations

import struct

from doclake.sources.office import word, workbook

__all__ = ["word", "workbook", "compound", "xls", "doc"]


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; streams below 4096 bytes lie in its small sectors."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        if not data:
            return end
        first, n = len(sectors), -(-len(data) // 512)
        for k in range(n):
            sectors.append(data[512 * k : 512 * k + 512].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else end)
        return first

    mini, mini_fat, places = b"", [], {}
    for name, data in streams.items():
        if len(data) >= 4096:
            places[name] = put(data)
            continue
        first, n = len(mini_fat), -(-len(data) // 64)
        mini += data.ljust(64 * n, b"\0")
        mini_fat += [first + k + 1 if k + 1 < n else end for k in range(n)]
        places[name] = first
    root, small = put(mini), put(b"".join(struct.pack("<I", x) for x in mini_fat))
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB12x16x20xIII", 2 * len(name) + 2, kind, 1, start, size, 0)
    listing = entry("Root Entry", 5, root, len(mini)) + b"".join(entry(n, 2, places[n], len(d)) for n, d in streams.items())
    directory = put(listing)
    table, n = len(sectors), -(-(len(sectors) + 1) // 127)
    fat += [0xFFFFFFFD] * n
    fat += [free] * (128 * n - len(fat))
    sectors += [struct.pack("<128I", *fat[128 * k : 128 * k + 128]) for k in range(n)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6xII", 0x3E, 3, 0xFFFE, 9, 6, 0, n)
    head += struct.pack("<IIIIIII", directory, 0, 4096, small, 1 if mini else 0, end, 0)
    return head + struct.pack("<109I", *[table + k if k < n else free for k in range(109)]) + b"".join(sectors)


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _text(value: str, width: int = 2) -> bytes:
    wide = any(ord(c) > 255 for c in value)
    return len(value).to_bytes(width, "little") + bytes([wide]) + (value.encode("utf-16-le") if wide else value.encode("latin-1"))


def xls(sheets: dict[str, list[list]], merges: dict[str, list[tuple[int, int, int, int]]] | None = None, split: int = 0) -> bytes:
    """An ``.xls`` file; texts are shared, whole numbers short, booleans as such, and floats plain. Column 0 style is plain, 1 a date.

    A value ``("date", n)`` gets the style of a date, ``("formula", text)`` is a formula's result. With ``split`` the shared
    texts go on in a further record after so many bytes.
    """
    shared: list[str] = []
    bodies = []
    for name, rows in sheets.items():
        body = _record(0x809, struct.pack("<HH12x", 0x600, 0x10))
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                place = struct.pack("<HHH", r, c, 0)
                if isinstance(v, tuple) and v[0] == "date":
                    body += _record(0x203, struct.pack("<HHHd", r, c, 1, v[1]))
                elif isinstance(v, tuple):
                    body += _record(0x06, place + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + _record(0x207, _text(v[1]))
                elif isinstance(v, bool):
                    body += _record(0x205, place + bytes([v, 0]))
                elif isinstance(v, int):
                    body += _record(0x27E, place + struct.pack("<i", v << 2 | 2))
                elif isinstance(v, float):
                    body += _record(0x203, place + struct.pack("<d", v))
                elif v is not None:
                    shared.append(v)
                    body += _record(0xFD, place + struct.pack("<I", len(shared) - 1))
        held = (merges or {}).get(name, [])
        if held:
            body += _record(0xE5, struct.pack("<H", len(held)) + b"".join(struct.pack("<4H", *m) for m in held))
        bodies.append(body + _record(0x0A, b""))
    table = struct.pack("<II", len(shared), len(shared)) + b"".join(map(_text, shared))
    texts = _record(0xFC, table)
    if split:
        # The cut lies inside the characters of a narrow text, whose rest begins with its flag again.
        texts = _record(0xFC, table[:split]) + _record(0x3C, b"\0" + table[split:])
    head = _record(0x809, struct.pack("<HH12x", 0x600, 5)) + _record(0xE0, struct.pack("<HH16x", 0, 0)) + _record(0xE0, struct.pack("<HH16x", 0, 14))
    names = list(sheets)
    size = len(head) + len(texts) + 4 + sum(4 + 6 + len(_text(n, 1)) for n in names)
    bounds = b""
    for n, body in zip(names, bodies):
        bounds += _record(0x85, struct.pack("<IBB", size, 0, 0) + _text(n, 1))
        size += len(body)
    return compound({"Workbook": head + bounds + texts + _record(0x0A, b"") + b"".join(bodies)})


def doc(*pieces: str) -> bytes:
    """A ``.doc`` file of several pieces of text; those of Latin letters are stored narrow."""
    text, table, at, bounds = b"", b"", 1024, [0]
    for p in pieces:
        narrow = all(ord(c) < 128 for c in p)
        raw = p.encode("cp1252") if narrow else p.encode("utf-16-le")
        table += struct.pack("<HIH", 0, (at + len(text)) * 2 | 0x40000000 if narrow else at + len(text), 0)
        text += raw
        bounds.append(bounds[-1] + len(p))
    table = struct.pack(f"<{len(bounds)}I", *bounds) + table
    clx = b"\1\2\0ab" + b"\2" + struct.pack("<I", len(table)) + table
    head = bytearray(1024)
    struct.pack_into("<H", head, 0, 0xA5EC)
    struct.pack_into("<H", head, 0x0A, 0x200)
    struct.pack_into("<I", head, 0x4C, bounds[-1])
    struct.pack_into("<II", head, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(head) + text, "1Table": clx})
