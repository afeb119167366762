"""Text columns. White space and digits are Unicode's, as in Python, which the regular expressions spell out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character; understood by Spark's and DuckDB's regular expressions alike.
WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = r"[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(col(c), rf"\A{WS}+|{WS}+\z", "")


def rstrip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"{WS}+\z", "")


def is_blank(c: str | Column) -> Column:
    """Whether there is nothing but white space; null counts as blank."""
    return ~F.coalesce(col(c), F.lit("")).rlike(NOT_WS)


def safe_str(c: str | Column) -> Column:
    """A cell as text: null and NaN are empty, and line ends become line feeds."""
    s = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(s == "NaN", "").otherwise(F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def escape_md_cell(c: str | Column) -> Column:
    """Text for a Markdown table cell: bars are escaped and line feeds become breaks."""
    return F.replace(F.replace(col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def escape_html(c: str | Column, quote: bool = True) -> Column:
    out = col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))[: 5 if quote else 3]:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def charset(content_type: str | Column) -> Column:
    """The charset of a Content-Type header, quoted or bare; utf-8 if there is none."""
    found = F.regexp_extract(col(content_type), r"""(?i)charset=\s*["']?([\w-]+)""", 1)
    return F.coalesce(F.when(found != "", found), F.lit("utf-8"))


def decode_text(raw: bytes) -> str:
    """Bytes as text: UTF-8, else GB18030, else Latin-1; a reading with replacement characters doesn't count."""
    for encoding in ("utf-8", "gb18030"):
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        if "�" not in text:
            return text
    return raw.decode("latin-1")
