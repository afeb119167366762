"""Which engine reads a source, and in which order others are tried; columns only, so nothing is shuffled. A null source is a name without a suffix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.names import extension, is_url
from doclake.functions.text import col

DEEP, BREADTH = "deep", "breadth"
DEEP_EXTENSIONS = (".docx", ".xls", ".xlsx", ".doc")


@dataclass(frozen=True)
class Routing:
    deep_first: bool = True
    allow_fallback: bool = True
    deep_available: bool = True
    breadth_available: bool = True


def deep_supports(source: str | Column) -> Column:
    return ~is_url(source) & extension(source).isin(*DEEP_EXTENSIONS)


def breadth_supports(source: str | Column) -> Column:
    return is_url(source) | (extension(source) != ".doc")


def select_engine(source: str | Column, routing: Routing = Routing()) -> Column:
    """The first engine that wants the source and is there; failing that, the one that would know the format."""
    deep, breadth = deep_supports(source), breadth_supports(source)
    chosen = F.when(F.lit(routing.deep_first and routing.deep_available) & deep, DEEP)
    return chosen.when(F.lit(routing.breadth_available) & breadth, BREADTH).when(deep, DEEP).otherwise(BREADTH)


def fallback_chain(source: str | Column, routing: Routing = Routing()) -> Column:
    """The engines to try in turn; only the first without fallback."""
    deep, breadth = deep_supports(source), breadth_supports(source)
    none = F.array().cast("array<string>")
    chain = F.concat(F.when(F.lit(routing.deep_first) & deep, F.array(F.lit(DEEP))).otherwise(none), F.when(breadth, F.array(F.lit(BREADTH))).otherwise(none))
    chain = F.when(F.size(chain) == 0, F.array(F.lit(DEEP))).otherwise(chain)
    return chain if routing.allow_fallback else F.slice(chain, 1, 1)


def success(status: str | Column, markdown: str | Column, chunks: str | Column, rag_failed: str | Column) -> Column:
    return ~col(rag_failed) & col(status).isin("ok", "degraded") & ((col(markdown) != "") | (col(chunks) > 0))
