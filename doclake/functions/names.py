"""Names of sources and files. A null gives a null, except where a name is asked to be blank: that is ``untitled``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.text import col, is_blank

RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def is_url(source: str | Column) -> Column:
    return F.contains(col(source), F.lit("://"))


def base_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"(?s)([^/]*)\z", 1)


def extension(path: str | Column) -> Column:
    """The last suffix with its dot, lower-cased; leading dots of a name start no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1))


def source_format(source: str | Column) -> Column:
    """The suffix of a file without its dot, or the last part of an address's path, or ``url``."""
    s = col(source)
    path = F.regexp_extract(s, r"(?s)\A[^:]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.when(is_url(s), F.lower(F.when(last == "", "url").otherwise(last))).otherwise(F.substr(extension(s), F.lit(2)))


def clean_filename(name: str | Column) -> Column:
    """A name that any file system takes: no control characters or separators, no reserved stem, at most 180 characters."""
    s = F.regexp_replace(F.regexp_replace(col(name), r"[\x00-\x1f]", ""), r'[/\\:*?"<>|]', "_")
    s = F.when(is_blank(s), "untitled").otherwise(s)
    s = F.when(F.upper(F.substring_index(s, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    short = F.regexp_replace(F.substring(s, 1, 180), r"\s+\z", "")
    return F.when(F.char_length(s) > 180, F.when(short == "", "untitled").otherwise(short)).otherwise(s)


def download_stem(source: str | Column) -> Column:
    """A safe stem for what was made of a source: host and path of an address, or a file's name without suffix."""
    s = col(source)
    raw = F.regexp_replace(F.regexp_extract(s, r"(?s)\Ahttps?://([^?#]*)", 1), r"/+\z", "")
    raw = F.when(F.contains(raw, F.lit("/")), F.regexp_replace(raw, r"\.[A-Za-z0-9]{1,5}\z", "")).otherwise(raw)
    file = base_name(F.replace(s, F.lit("\\"), F.lit("/")))
    ext = F.regexp_extract(file, r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1)
    stem = F.substring(file, F.lit(1), F.char_length(file) - F.char_length(ext))
    kept = F.regexp_replace(F.when(s.rlike(r"\Ahttps?://"), raw).otherwise(stem), r"(?U)[^\w.-]+", "_")
    kept = F.regexp_replace(kept, r"\A[._-]+|[._-]+\z", "")
    return F.when(kept == "", "untitled").otherwise(kept)


def download_name(source: str | Column, ext: str = "md") -> Column:
    return F.concat(download_stem(source), F.lit("." + ext))
