"""Image references in Markdown, and images as data addresses. A null text is an empty one; null bytes are no image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.text import col, is_blank, strip

REF = r"!\[([^\]]*)\]\(([^)]*)\)"
#: A reference whose alternative text is blank.
BLANK_REF = r"!\[[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\]\(([^)]*)\)"


def image_refs(markdown: str | Column) -> Column:
    """All image references, in order."""
    return F.regexp_extract_all(F.coalesce(col(markdown), F.lit("")), F.lit(r"!\[[^\]]*\]\([^)]*\)"), F.lit(0))


def bare_url(inner: str | Column) -> Column:
    """What stands in a reference's brackets without a quoted title and without angle brackets."""
    s = strip(inner)
    s = strip(F.regexp_replace(s, r"""\s+["'].*["']\z""", ""))
    return F.when(s.rlike(r"(?s)\A<.*>\z") & (F.char_length(s) > 1), strip(F.substring(s, F.lit(2), F.char_length(s) - 2))).otherwise(s)


def describable_refs(markdown: str | Column) -> Column:
    """References without alternative text, each with its bare address."""
    refs = F.regexp_extract_all(F.coalesce(col(markdown), F.lit("")), F.lit(BLANK_REF), F.lit(0))
    return F.transform(refs, lambda r: F.struct(r.alias("ref"), bare_url(F.regexp_extract(r, r"\]\(([^)]*)\)\z", 1)).alias("url")))


def apply_captions(markdown: str | Column, captions: str | Column, label: str = "\U0001f5bc️ 图片描述：") -> Column:
    """The text with a quoted caption below each reference without alternative text, in order; blank ones add nothing.

    The references are cut out with a split, and the parts between them are put together again with the captions.
    """
    text = F.coalesce(col(markdown), F.lit(""))
    refs = F.regexp_extract_all(text, F.lit(BLANK_REF), F.lit(0))
    between = F.split(text, BLANK_REF, -1)
    caption = lambda i: F.coalesce(F.get(col(captions), i), F.lit(""))
    block = lambda r, i: F.concat(r, F.when(caption(i) == "", "").otherwise(F.concat(F.lit(f"\n\n> {label}"), caption(i))))
    pieces = F.transform(between, lambda part, i: F.concat(part, F.coalesce(block(F.get(refs, i), i), F.lit(""))))
    return F.array_join(pieces, "")


def image_mime(head: str | Column) -> Column:
    """The type of an image by its first bytes, or null."""
    h = F.hex(F.substring(col(head), 1, 12))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("424D"), "image/bmp")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    )


def data_uri(url: str | Column, content: str | Column) -> Column:
    """An image's bytes as a data address on one line; anything without bytes of an image keeps its address."""
    mime = image_mime(content)
    plain = col(url).startswith("data:") | mime.isNull()
    return F.when(F.coalesce(plain, F.lit(True)), col(url)).otherwise(F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(col(content)), F.lit("\r\n"), F.lit(""))))


def needs_caption(markdown: str | Column) -> Column:
    return ~is_blank(markdown) & (F.size(describable_refs(markdown)) > 0)
