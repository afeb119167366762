"""HTML as Markdown, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "aside", "figure", "table", "ul", "ol", "dl", "blockquote", "pre", "form", "address"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "col", "source", "wbr"}
_DROPPED = {"script", "style", "template", "head"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`"}


class _Writer(HTMLParser):
    """Collects Markdown; nested lists, tables and links keep their text in buffers until they close."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, int, str]] = []
        self.lists: list[list] = []
        self.dropped = self.pre = 0
        self.rows: list[list[list[str]]] = []

    def text(self, start: int) -> str:
        got = "".join(self.out[start:])
        del self.out[start:]
        return got

    def gap(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in _DROPPED:
            self.dropped += 1
        if self.dropped:
            if tag not in _VOID:
                self.stack.append((tag, len(self.out), ""))
            return
        if tag == "br":
            self.out.append("  \n" if not self.rows else "<br>")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "img":
            title = f' "{a["title"]}"' if a.get("title") else ""
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''}{title})")
        if tag in _VOID:
            return
        if tag == "li":
            self.close_open("li", {"ul", "ol"})
        elif tag in ("p", *(f"h{n}" for n in range(1, 7))):
            self.close_open("p", {"td", "th", "li", "blockquote", "div", "article", "section"})
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        self.stack.append((tag, len(self.out), a.get("href") or ""))

    def close_open(self, tag: str, until: set[str]) -> None:
        """Closes a tag that the text left open, unless one of ``until`` was opened since."""
        for name, *_ in reversed(self.stack):
            if name == tag:
                self.handle_endtag(tag)
                return
            if name in until:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID or all(name != tag for name, *_ in self.stack):
            return
        while self.stack:
            name, start, href = self.stack.pop()
            self.end(name, start, href)
            if name == tag:
                return

    def end(self, tag: str, start: int, href: str) -> None:
        if tag in _DROPPED:
            self.dropped -= 1
            self.text(start)
        elif re.fullmatch(r"h[1-6]", tag):
            line = " ".join(self.text(start).split())
            self.out.append(f"\n\n{'#' * int(tag[1])} {line}\n\n" if line else "")
        elif tag in _MARKS and not self.pre:
            inner = self.text(start)
            core = inner.strip()
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            self.out.append(f"{lead}{_MARKS[tag]}{core}{_MARKS[tag]}{tail}" if core else inner)
        elif tag == "a":
            inner = self.text(start).strip()
            self.out.append(f"[{inner}]({href})" if href and inner else inner)
        elif tag == "pre":
            self.pre -= 1
            self.out.append(f"\n\n```\n{self.text(start).strip(chr(10))}\n```\n\n")
        elif tag == "li":
            inner = re.sub(r"\n{2,}", "\n", self.text(start).strip()).replace("\n", "\n  ")
            if self.lists:
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}." if self.lists[-1][0] == "ol" else "*"
            else:
                mark = "*"
            self.out.append(f"\n{mark} {inner}")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            inner = self.text(start).strip("\n")
            self.out.append(f"\n{inner}\n" if self.lists else f"\n\n{inner}\n\n")
        elif tag == "blockquote":
            inner = self.text(start).strip()
            self.out.append("\n\n" + "\n".join(f"> {x}".rstrip() for x in inner.split("\n")) + "\n\n")
        elif tag in ("td", "th"):
            if self.rows and self.rows[-1]:
                self.rows[-1][-1].append(" ".join(self.text(start).split()))
        elif tag == "table":
            self.text(start)
            rows = [r for r in self.rows.pop() if r] if self.rows else []
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.out.append("\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n")
        elif tag in _BLOCK:
            self.out.append(f"\n\n{self.text(start).strip(' ')}\n\n")

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        self.out.append(data if self.pre else re.sub(r"[ \t\r\n\f]+", " ", data))

    def finish(self) -> str:
        self.close_all()
        text = "".join(self.out)
        text = re.sub(r" *\n[ \t]*\n\s*", "\n\n", text)
        return re.sub(r"(?m)^ (?=\S)", "", text).strip()

    def close_all(self) -> None:
        while self.stack:
            self.end(*self.stack.pop())


def html_to_md(html: str) -> str:
    """Markdown of an HTML text: headings with number signs, lists, links, tables, code; no scripts, styles or head.

    Any text is taken; tags that are left open end with the text.
    """
    writer = _Writer()
    writer.feed(html)
    writer.close()
    return writer.finish()
