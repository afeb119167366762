"""Every query of the engine's own operators against its SQL, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from doclake import suite
from oracle import connect, differences


@pytest.mark.parametrize("name", list(suite.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    ours = suite.queries()[name](spark, sf_dir).toArrow()
    if name in suite.oracle_sql():
        theirs = connect(sf_dir).execute(suite.oracle_sql()[name]).to_arrow_table()
        assert differences(ours, theirs) == ""
    assert ours.num_rows > 0


def test_entry_gives_chunks(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "chunk_index", "chunk_count", "start_index", "end_index", "chunk_text"]
