"""What the corpus operators share: staged tables, bounded memos and text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from doclake.arrow import text_slices
from doclake.session import shared_folder
from doclake.session import staged as stage
from doclake.session import unstage as drop_stage

__all__ = ["Memo", "drop_stage", "partitions", "plain_words", "released", "scratch", "stage", "text_slices", "tokenizer", "tokenizer_path", "trimmed"]

#: Entries that one generation of a memo may hold, and the longest key it takes: at most some 0.7 KB an entry, 0.2 typically.
MEMO_ENTRIES = 100_000
MEMO_KEY = 64


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path for one written table below the shared folder."""
    return f"{shared_folder(spark)}/doclake/{tag}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """A dictionary for one task that never holds more than two generations of ``limit`` entries.

    ``old`` keeps the previous generation: hot keys move forward when they are met again. Long keys aren't taken, so that
    the bound on entries is one on bytes.
    """

    def __init__(self, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.limit, self.old = limit, {}

    def keep(self, key: str, value: object) -> None:
        if len(key) <= MEMO_KEY:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def forget(self) -> None:
        self.clear()
        self.old = {}


@contextlib.contextmanager
def released(tool=None) -> Iterator:
    """``tool`` for one task; afterwards its memos are empty, and the worker, which may idle for long, gives memory back."""
    try:
        yield tool
    finally:
        if tool is not None:
            tool.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def trimmed(work: Callable) -> Callable:
    """``work`` over a task's batches, which gives memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            yield from work(batches)

    return run


def plain_words(text: str) -> list[str] | None:
    """The words of a text that holds nothing between them but single blanks and line feeds; None for any other text.

    A text with what may be a special string isn't plain either.
    """
    words = text.split()
    if "<|" in text or "\x01" in text or " ".join(words) != text.replace("\n", " "):
        return None
    return words


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path_or_name: str):
    """The loaded tokenizer of a ``.json`` file, one per worker process."""
    if path_or_name not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = path_or_name if "/" in path_or_name else tokenizer_path(path_or_name)
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path_or_name] = t
    return _TOKENIZERS[path_or_name]
