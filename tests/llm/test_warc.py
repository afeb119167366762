from __future__ import annotations

import gzip
from pathlib import Path

import pytest

from doclake.llm import queries, warc
from doclake.llm.common import scratch
from oracle import connect, differences


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    ours = queries.queries()[name](spark, sf_dir).toArrow()
    assert ours.num_rows > 0 and differences(ours, connect(sf_dir).execute(queries.oracle_sql()[name]).to_arrow_table()) == ""


def test_records_can_be_read_by_the_letter():
    data = gzip.decompress(warc.record(7, "http://a/\r\nX: y", "é".encode(), warc.digest_of("é".encode()), None, False)).decode()
    head, http, body = data.split("\r\n\r\n")[:3]
    assert head.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "http://a/  X: y\r\n" in head
    assert f"Content-Length: {len(http.encode()) + 4 + 2}" in head and http.endswith("Content-Length: 2") and body == "é"
    revisit = gzip.decompress(warc.record(8, None, b"e", "D", 7, True)).decode()
    assert "WARC-Refers-To: <urn:doclake:page:7>" in revisit and "WARC-Target-URI" not in revisit
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, None, b"abc", "WRONG", None, False))


def test_selected_records_of_odd_pages(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://d", ""), (5, "http://e", "x" * 3_000_000), (6, "u", "same"), (6, "u", "same"), (None, "n", "only null"), (None, "n", "same"), (9, "a\r\n\r\nb", "é\r\n\r\nö")]
    pages = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, sha string, first int")
    index = warc.write_warc(pages, scratch(spark, "warc"))
    got = warc.read_warc(index).collect()
    want = []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        first = min(ids, default=None)
        revisit = first is not None and first != page_id
        url = None if url is None else url.replace("\r", " ").replace("\n", " ")
        want.append((page_id, url, len(payload), warc.digest_of(payload), "revisit" if revisit else "response", first if revisit else None, None if revisit else payload))
    assert sorted(((*tuple(r)[:6], None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    chosen = warc.read_warc(index.where("record_type = 'revisit' and page_id = 6"))
    assert [r.page_id for r in chosen.collect()] == [6, 6]
    large = warc.read_warc(warc.write_warc(pages, scratch(spark, "warc"), min_revisit_bytes=5)).collect()
    assert sum(r.record_type == "revisit" for r in large) == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(none, scratch(spark, "warc"))).collect() == []


def test_reads_are_joined():
    far = warc.JOIN_GAP + 10
    rows = [("a", 0, 5), ("a", 5, 5), ("a", 10 + far, 5), ("b", 15 + far, 5)]
    assert [(p, s, e, len(h)) for p, s, e, h in warc.ranges(rows)] == [("a", 0, 10, 2), ("a", 10 + far, 15 + far, 1), ("b", 15 + far, 20 + far, 1)]
    assert list(warc.ranges([])) == []


def test_files_hold_whole_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{i}", f"page {i}") for i in range(30)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == 30
