from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"word{i % 977}" for i in range(60_000))

#: Null, empty, blank, very long, repeated, odd white space, special strings, other scripts, one word.
ODD_TEXTS = [None, "", "   \n\t", LONG, "same text here again", "same text here again", "a  b c　d\r\ne\x0bf", "x <|endoftext|> y", "你好，世界。Ünïcödé ẞ ﬁ é", "one", "Tie a b c d", "don't I'll we're 12,345.67 ... --- a_b (x) [y]"]


@pytest.fixture
def odd_documents(spark):
    """Odd texts under ids that repeat and are null, with columns whose names the operators use themselves."""
    rows = [(i // 2 if i % 5 else None, t, "id", "text2", float(i), "x") for i, t in enumerate(ODD_TEXTS * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, component string, llr double, __text string")


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toArrow().to_pylist()
