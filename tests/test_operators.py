"""Operators on odd rows: nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; and long texts' time."""

from __future__ import annotations

import json
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doclake import CaptionSettings, ChunkSettings, Settings, cli, suite
from doclake.functions import images
from doclake.operators import chunking, cleaning, metrics, naming, routing, tables, texts
from doclake.plans.convert import run
from doclake.session import shared_folder
from doclake.sources import describe, readers

LONG = "One sentence here. " * 40_000 + "\n# Part\nbody\n" * 2_000
ODD = [None, "", " \n\t", "same", "same", "# A\n\n# B\ntext. more", LONG, "x" * 5_000, "😀é.  ! z\n## H \n\n b"]
CLASH = "start_index string, end_index int, chunk_index string, chunk_count string, chunk_text string, header string, part int, n int, blocks string, i string, c0 string, pos string, line int"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with ids that repeat and are null, in a table whose other columns bear the names that operators use."""
    rows = [(k // 2 if k % 4 else None, t, "a", 1, "b", "c", "d", "e", 2, 3, "f", "g", "h", "i", 4) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, f"id long, text string, {CLASH}")


# ── chunks ───────────────────────────────────────────────────────────────────────────────────────────────────────────────

WAYS = [("fixed", 50, 7), ("fixed", 50, 49), ("sentence", 60, 10), ("sentence", 40, 0), ("markdown", 0, 0), ("markdown", 0, 30)]


@pytest.mark.parametrize("how,size,more", WAYS)
def test_chunks_of_odd_rows(odd, how, size, more):
    kept = {"n", "blocks", "i", "c0", "pos", "line"} | (set() if how == "markdown" else {"header", "part"})
    got = chunking.chunk(odd, how, size or 1, 0 if how == "markdown" else more, more if how == "markdown" else 0)
    assert len(set(got.columns)) == len(got.columns) and kept < set(got.columns)
    counted = chunking.count_chunks(odd, how, size or 1, 0 if how == "markdown" else more, more if how == "markdown" else 0)
    counts = [r.chunk_count for r in counted.collect()]
    by_row: dict = {}
    for r in got.where("length(chunk_text) >= 0").collect():
        by_row.setdefault((r.chunk_count, r.end_index - r.start_index if r.chunk_count == 1 else -1), []).append(r)
        base = r.chunk_text
        assert r.end_index - r.start_index == len(base) and r.n == 3 and r.blocks == "f"
    assert sum(counts) == got.count() and counts[:3] == ([0, 0, 1] if how == "fixed" else [0, 0, 0]) and counts[3] == counts[4] == 1
    assert chunking.chunk(odd.where("false"), how, size or 1, 0).collect() == []


def literal_sentences(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Sentences packed one after the other, from the pieces that a lazy pattern gives."""
    pieces = [m.group() for m in re.finditer(r"(?s).+?(?:[.!?。！？]\s+|\Z)", text)]
    at, spans = 0, []
    start = last = held = None
    for p in pieces:
        own = len(p.rstrip())
        if start is None:
            start, held = at, own
        elif held + own + 1 > size:
            spans.append((start, last))
            begin = max(start, last - overlap) if overlap else at
            held = (last - begin if overlap else 0) + own + 1
            start = begin
        else:
            held += own + 1
        last = at + own
        at += len(p)
    return spans + ([(start, last)] if start is not None else [])


@given(st.text(alphabet="ab.!? \n。", max_size=80), st.integers(1, 30), st.integers(0, 29))
@settings(max_examples=400, deadline=None)
def test_sentences_are_packed_one_by_one(text, size, overlap):
    text, overlap = text.strip(), min(overlap, size - 1)
    assert chunking.sentence_spans(text, size, overlap) == literal_sentences(text, size, overlap)


@given(st.text(alphabet="# a\nb`", max_size=60), st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_sections_lie_in_the_text(text, most):
    base, found = chunking.heading_cutter(most)(text)
    assert base == text and all(0 <= a < b <= len(text) for a, b, _, _ in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    assert not most or all(b - a <= most for a, b, _, _ in found)
    covered = "".join(text[a:b] for a, b, _, _ in found)
    assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", text)


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (1, 2, 4):
        text = ("Some words of a sentence. " * 40 + "\n## Head\nbody text\n") * (900 * n)
        began = time.process_time()
        chunking.sentence_cutter(512, 64)(text)
        chunking.heading_cutter(300)(text)
        cleaning.cleaned(text)
        took.append(time.process_time() - began)
    assert took[2] < 8 * max(took[0], 0.05)


def test_plans_shuffle_no_text(odd):
    for df in (chunking.fixed_chunks(odd), chunking.sentence_chunks(odd), chunking.heading_chunks(odd), cleaning.clean(odd), chunking.count_chunks(odd, "md")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_what_cannot_be_is_refused(odd):
    for size, overlap in ((0, 0), (-1, 0), (5, 5), (5, -1)):
        for how in ("fixed", "sentence"):
            with pytest.raises(ValueError):
                chunking.chunk(odd, how, size, overlap)
            with pytest.raises(ValueError):
                chunking.count_chunks(odd, how, size, overlap)
    with pytest.raises(ValueError):
        chunking.chunk(odd, "markdown", max_size=-1)
    with pytest.raises(ValueError):
        chunking.chunk(odd, "by magic")


# ── cleaning ─────────────────────────────────────────────────────────────────────────────────────────────────────────────


@pytest.mark.parametrize(
    "text,want",
    [
        ("[1]\na\n第3页\n- 1 -\nPage 1\nPAGE 1 of 10\n\\[7\\]\nPage 2/3", "a"),
        ("a\n\n \n\t\nb\n\n", "a\n\nb\n"),
        ("  a   b\t c  \n　x　　y", "  a b c\n x y"),
        ("a\na\nb\na\n\n\na", "a\nb\na\n\na"),
        ("```\nPage 1\n\n\na  b\na  b\n```\n", "```\nPage 1\n\n\na  b\na  b\n```\n"),
        ("    code  x\n    code  x\ny", "    code  x\n    code  x\ny"),
        ("same\n    same\nsame", "same\n    same\nsame"),
        ("", ""),
    ],
)
def test_cleaning_rules(text, want):
    assert cleaning.cleaned(text) == want


def test_cleaning_odd_rows(spark, odd):
    rows = odd.select("id", "text", "line").collect()
    got = cleaning.clean(odd, "text")
    assert got.columns == odd.columns
    assert sorted((repr(r.id), r.text, r.line) for r in got.collect()) == sorted((repr(r.id), cleaning.cleaned(r.text or ""), r.line) for r in rows)
    # Null and repeated keys keep their own texts.
    keyed = spark.createDataFrame([(None, "x\n\n\ny"), (1, "a\n[1]\nc"), (1, "c\nd\nd")], "key long, text string")
    assert sorted(r.text for r in cleaning.clean(keyed).collect()) == ["a\nc", "c\nd", "x\n\ny"]
    tables_stay = cleaning.clean(keyed, "text", cleaning.Rules(), keyed.key.isNotNull())
    assert sorted(r.text for r in tables_stay.collect()) == ["a\nc", "c\nd\nd", "x\n\ny"]
    assert [r.text for r in cleaning.clean(keyed, "text", cleaning.Rules(False, False, False, False)).orderBy("text").collect()] == ["a\n[1]\nc", "c\nd\nd", "x\n\n\ny"]
    assert cleaning.clean(odd.where("false")).collect() == []
    lines = cleaning.to_lines(odd)
    assert lines.columns.count("line") == 1 and lines.count() == sum((r.text or "").count("\n") + 1 for r in rows)


# ── the others ───────────────────────────────────────────────────────────────────────────────────────────────────────────

CELL = "source string, sheet string, row int, col int, value string"
MERGE = "source string, sheet string, min_row int, min_col int, max_row int, max_col int"


def test_tables_of_odd_sheets(spark):
    cells = spark.createDataFrame([("b", "head", 1, 1, "only"), ("b", "head", 1, 2, None), ("b", "full", 1, 1, "h"), ("b", "full", 3, 1, "v\"\\\n"), ("b", "full", 2, 1, None), ("b", "blank", 1, 1, None), (None, None, 1, 1, "x")], CELL)
    merges = spark.createDataFrame([("b", "full", 1, 1, 1, 2), ("b", "head", 1, 1, 1, 2), ("b", "full", 2, 1, 3, 1), ("b", "gone", 1, 1, 2, 2)], MERGE)
    cells, merges = tables.prepare(cells, merges)
    made = {r.sheet: json.loads(r.json) for r in tables.json_table(cells, merges).collect()}
    assert made["head"] == {"metadata": {"sheet": "head", "total_rows": 0, "total_columns": 0, "headers": [], "merged_cells": []}, "data": []}
    full = made["full"]
    assert full["metadata"] == {"sheet": "full", "total_rows": 1, "total_columns": 2, "headers": ["h", ""], "merged_cells": [{"row": 1, "col": 1, "rowspan": 1, "colspan": 2}]}
    assert full["data"] == [{"_row": 2, "_cells": {"1": {"value": "v\"\\\n", "col": 1, "header": "h", "merged": False}, "2": {"value": "", "col": 2, "header": "", "merged": False}}, "h_col1": "v\"\\\n", "_col2": ""}]
    book = json.loads(tables.json_book(tables.json_table(cells, merges).where("source = 'b'")).first().json)
    assert book["source"] == "b" and [s["sheet"] for s in book["sheets"]] == ["full", "head"] and book["sheets"][0]["content"] == full
    assert {r.sheet for r in tables.html_table(cells, merges).collect()} == {r.sheet for r in tables.md_table(cells).collect()} == {"head", "full"}
    nothing = cells.where("false"), merges.where("false")
    for empty in (tables.json_table(*nothing), tables.html_table(*nothing), tables.md_table(*nothing), tables.table_records(*nothing), tables.merge_map(nothing[1])):
        assert empty.collect() == []
    overlap = spark.createDataFrame([("b", "s", 1, 1, 2, 2), ("b", "s", 2, 2, 3, 3)], MERGE)
    shared = [r for r in tables.merge_map(overlap).collect() if (r.row, r.col) == (2, 2)]
    assert len(shared) == 1 and (shared[0].min_row, shared[0].is_master) == (1, False)


def test_order_tables_shuffle_line_items_once(spark, sf_dir):
    """Neither cells nor sheets are dealt out: line items are, once."""
    plan = suite.order_tables(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_whole_sheets_are_rendered_as_their_cells_are(spark):
    """Many sheets, more than a worker takes at once, some with holes, nulls, repeats of a name, and texts that must be escaped."""
    rows = [("s", f"n{k}", r, c, [None, "NaN", "a|b", "x\r\ny", "\\n", " ", "v", "é"][(k + r + c) % 8]) for k in range(1200) for r in (1, 2, 4) for c in (1, 3)]
    cells = spark.createDataFrame(rows, "source string, sheet string, row int, col int, value string").coalesce(1)
    got = {r.sheet: r.markdown for r in tables.md_table(cells).collect()}
    shown = ["&nbsp;", "&nbsp;", "a\\|b", "x<br>y", "<br>", " ", "v", "é"]
    for k in (0, 1, 499, 500, 1199):
        lines = ["| " + " | ".join([shown[(k + r + 1) % 8], "&nbsp;", shown[(k + r + 3) % 8]]) + " |" for r in (1, 2, 4)]
        empty = "| &nbsp; | &nbsp; | &nbsp; |"
        assert got[f"n{k}"].split("\n")[2:] == [lines[0], "| --- | --- | --- |", lines[1], empty, lines[2]]
    assert len(got) == 1200


def test_names_routes_and_images_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a.md"), (4, "a.md"), (5, ".md"), (6, "x" * 300 + ".docx")], "k int, name string")
    named = {r.k: r.unique_name for r in naming.unique_names(df, "name", "k").collect()}
    assert (named[3], named[4]) == ("a.md", "a_1.md") and len(named) == 6
    suffixes = {r.k: r.suffix for r in naming.sheet_suffixes(df.withColumn("g", df.k * 0), "g", "name", "k").collect()}
    assert len(suffixes) == 6 and (suffixes[3], suffixes[4]) == ("a.md", "a.md_2")
    chains = df.select("k", routing.fallback_chain("name").alias("c"), routing.select_engine("name").alias("e")).collect()
    assert {r.k: r.c for r in chains}[6] == ["deep", "breadth"] and len(chains) == 6
    pictures = spark.createDataFrame([(None,), ("",), ("![](a) ![ ](b)",), ("![](a) ![ ](b)",)], "t string")
    assert [len(r.refs) for r in pictures.select(images.image_refs("t").alias("refs")).collect()] == [0, 0, 2, 2]
    shown = texts.html_to_markdown(spark.createDataFrame([(1, None), (1, ""), (1, "<p>a</p>" * 20_000)], "markdown int, html string")).collect()
    assert [len(r.markdown) if r.markdown is not None else None for r in shown] == [None, 0, 20_000 + 2 * 19_999]


def test_html_leaves_a_worker_in_slices():
    """What is turned at once doesn't follow the rows of a batch."""
    pages = [f"<p>{k} " + "x" * 50_000 for k in range(100)] + [None, "", "<b>y</b>" * 300_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["c0", "c1"])
    parts = list(texts.turned(iter([batch]), ["k", "markdown"]))
    assert all(p.num_rows == 1 or p.nbytes < 1.1 * texts.PAGES for p in parts) and len(parts) >= 5
    got = {k: m for p in parts for k, m in zip(p.column("k").to_pylist(), p.column("markdown").to_pylist())}
    assert len(got) == 103 and got[7] == "7 " + "x" * 50_000 and got[100] is None and got[101] == ""


def test_metrics_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: (r.chunk_count, r.coverage, r.redundancy) for r in metrics.structure(docs, chunking.fixed_chunks(docs, 2, 1), "id").collect()}
    assert got == {1: (2, 1.0, 1 / 3), 2: (0, 0.0, 0.0), 3: (0, 0.0, 0.0)}
    ranked = spark.createDataFrame([(1, None, 1.0), (1, True, 0.5), (2, False, 1.0)], "q int, hit boolean, s double")
    assert [tuple(r)[:3] for r in metrics.retrieval(ranked, "q", "hit", ["s"], 5).collect()] == [(1, 1.0, 1.0)]


# ── conversion ───────────────────────────────────────────────────────────────────────────────────────────────────────────


def test_repeated_and_null_sources(spark):
    """Every row is answered with its own content."""
    from office import doc, workbook, xls

    rows = [("a.md", b"one"), ("a.md", b"two"), ("a.md", b"two"), (None, b"text"), ("b.xlsx", workbook({"S": [["h"], ["x"]]})), ("b.xlsx", workbook({"S": [["h"], ["y"]]})), ("c.xls", xls({"S": [["h"], ["z|"]]})), ("d.doc", doc("A & b\rc")), ("e.xlsx", workbook({"Only": [["head"]]}))]
    df = spark.createDataFrame(rows, "source string, content binary")
    results, chunks = run(df, Settings(chunking=ChunkSettings(True)))
    got = results.collect()
    assert len({r.row for r in got}) == len(got) == len(rows)
    assert sorted(r.markdown for r in got if r.source == "a.md") == ["one", "two", "two"]
    books = sorted(r.markdown.rsplit("\n", 1)[1] for r in got if r.source == "b.xlsx")
    assert books == ["| x |", "| y |"]
    of = {r.source: r for r in got}
    assert of["c.xls"].markdown == "<!-- source: c.xls | sheet: S | rows: 1 | cols: 1 -->\n\n| h |\n| --- |\n| z\\| |" and of["c.xls"].engine == "deep"
    assert of["d.doc"].markdown == "<!-- source: d.doc | format: doc -->\n\nA &amp; b\nc" and of["d.doc"].status == "ok"
    assert chunks.groupBy("row").count().count() == sum(r.chunk_count > 0 for r in got)
    pages = {r.source: r for r in run(df, Settings(output="json", cleaning=False))[0].collect()}
    assert json.loads(pages["e.xlsx"].markdown)["data"] == [] and json.loads(pages["d.doc"].markdown) == {"source": "d.doc", "content": "A & b\nc"}
    assert "<pre>\nA &amp; b\nc\n</pre>" in {r.source: r for r in run(df, Settings(output="html", cleaning=False))[0].collect()}["d.doc"].markdown
    empty = run(df.where("false"), Settings(chunking=ChunkSettings(True)))
    assert empty[0].collect() == [] and empty[1].collect() == []


def test_engines_of_ones_own(spark):
    def read(source, content, options):
        if b"bad" in content:
            raise RuntimeError("no")
        return readers.Read(content.decode().upper(), {"by": "shout"})

    shout = readers.Engine("shout", lambda source: source.endswith(".loud"), read)
    df = spark.createDataFrame([("a.loud", b"text"), ("b.loud", b"bad"), ("c.md", b"text")], "source string, content binary")
    got = {r.source: r for r in run(df, engines=(shout,))[0].collect()}
    assert (got["a.loud"].markdown, got["a.loud"].engine, got["a.loud"].metadata) == ("TEXT", "shout", {"by": "shout"})
    assert (got["b.loud"].markdown, got["b.loud"].engine, got["b.loud"].status) == ("bad", "breadth", "degraded") and got["c.md"].engine == "breadth"
    away = readers.Engine("shout", lambda source: True, read, lambda: False)
    assert {r.engine for r in run(df, engines=(away,))[0].collect()} == {"breadth"}


def test_describing_service():
    on = CaptionSettings(True, "ollama", "http://llm/v1/", "", "m", timeout=7)
    asked = []

    def post(url, headers, body, timeout):
        asked.append((url, headers["Authorization"], json.loads(body), timeout))
        return json.dumps({"choices": [{"message": {"content": " a cat "}}]})

    assert describe.describer(on, post)("http://i/1.png") == "a cat" and describe.probe(on, post) == (True, "a cat")
    url, key, body, timeout = asked[0]
    assert (url, key, timeout) == ("http://llm/v1/chat/completions", "Bearer ollama", 7) and body["messages"][0]["content"][1]["image_url"]["url"] == "http://i/1.png"

    def down(*_):
        raise OSError("down")

    assert describe.probe(on, down) == (False, "OSError: down") and not describe.probe(CaptionSettings(), post)[0]
    said: list[str] = []
    assert cli.main(["test-llm", "--llm-model", "m"], out=said.append) == 1 and "missing" in said[0]
    assert cli.main(["engines"], out=said.append) == 0 and ".doc" in said[1]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = spark.conf
        sparkContext = type("Context", (), {"master": "yarn"})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            shared_folder(Elsewhere)
    assert shared_folder(spark)
