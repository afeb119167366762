from __future__ import annotations

import json
from pathlib import Path

import pytest
from office import word, workbook

from doclake import CaptionSettings, ChunkSettings, Settings, cli
from doclake.operators.cleaning import Rules
from doclake.operators.routing import Routing
from doclake.plans import sinks
from doclake.plans.convert import run
from doclake.sources import fetch, readers
from doclake.streaming.inbox import convert_stream, inbox

SALES = {"Sales": [["Region", "Product", "Units"], ["North", "A|x", 12], [None, None, None], ["South", "a\nb", 7.5]], "Empty": [[]]}
WORD = word(("Heading1", "Title"), ("", "First <b> text"), ("b", "Bold"), ("Heading2", "Part"), ("", " "))


@pytest.fixture
def sources(spark):
    rows = [
        ("/in/sales.xlsx", workbook(SALES, {"Sales": ["A1:B1"]})),
        ("/in/note.docx", WORD),
        ("/in/broken.docx", b"garbage-not-a-zip"),
        ("/in/broken.xlsx", b"garbage-not-a-zip"),
        ("/in/old.doc", b"\xd0\xcf"),
        ("/in/page.html", "<html><head><title>x</title><script>1</script></head><body><h1>Hi</h1><p>a <b>b</b></p><ul><li>one</li></ul></body></html>".encode()),
        ("/in/table.csv", b"a,b\n1,2\n1,2\n3\n"),
        ("/in/plain.txt", "中文 text\n\n\n\nPage 1\nsame\nsame\n![ ](http://img/1.png)\n".encode("gb18030")),
        ("/in/blank.txt", b""),
        ("/in/gone.md", None),
        ("/in/slides.pptx", b"PK"),
        ("https://good.example/a/b.html", None),
        ("http://127.0.0.1/x", None),
    ]
    return spark.createDataFrame(rows, "source string, content binary")


def by_source(df):
    return {r.source.rsplit("/", 1)[-1]: r for r in df.collect()}


def test_all_kinds_of_sources(sources):
    def get(url: str) -> str:  # in here, so that workers get it by value
        return fetch.fetch_page(url, lambda host: ["93.184.216.34"], lambda u, ip, t: (200, {"content-type": "text/html; charset=utf-8"}, b"<h2>Web</h2>"))

    results, chunks = run(sources, Settings(chunking=ChunkSettings(True, "fixed", 20, 5)), get=get)
    got = by_source(results)
    assert len(got) == 13
    sales = got["sales.xlsx"]
    assert (sales.status, sales.engine, sales.fallback_used) == ("ok", "deep", False)
    assert sales.markdown == "<!-- source: /in/sales.xlsx | sheet: Sales | rows: 2 | cols: 3 -->\n\n| Region | Product | Units |\n| --- | --- | --- |\n| North | A\\|x | 12 |\n| South | a<br>b | 7.5 |"
    assert sales.warnings == ["sheet Empty left out: the sheet is empty"] and [tuple(s) for s in sales.sheets] == [("Sales", 3, 3)]
    assert got["note.docx"].markdown == "<!-- source: note.docx | paragraphs: 4 -->\n\n# Title\n\nFirst <b> text\n\n**Bold**\n\n## Part"
    assert got["note.docx"].metadata["paragraphs"] == "4" and got["note.docx"].success
    for name in ("broken.docx", "broken.xlsx"):
        assert (got[name].status, got[name].engine, got[name].success) == ("error", "breadth", False) and "BadZipFile" in got[name].errors[0]
    assert got["old.doc"].engine == "deep" and got["old.doc"].status == "error"
    assert got["page.html"].markdown == "# Hi\n\na **b**\n\n* one"
    assert got["table.csv"].markdown == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 1 | 2 |\n| 3 | |"
    assert got["plain.txt"].markdown == "中文 text\n\nsame\n![ ](http://img/1.png)\n"
    assert got["blank.txt"].status == "error" and got["gone.md"].markdown.startswith("## ⚠️ /in/gone.md\n\n_FileNotFoundError")
    assert got["slides.pptx"].status == "error"
    assert got["b.html"].markdown == "## Web" and got["b.html"].source_format == "b.html"
    assert got["x"].status == "error" and got["x"].warnings == [readers.BLOCKED] and got["x"].errors == []
    assert {r.source for r in chunks.collect()} == {r.source for r in got.values() if r.status != "error"}
    for r in chunks.collect():
        assert r.chunk_text == got[r.source.rsplit("/", 1)[-1]].markdown[r.start_index : r.end_index]


def test_fallback_and_availability(spark):
    df = spark.createDataFrame([("/a.docx", WORD), ("/b.doc", b"x"), ("/c.txt", b"text")], "source string, content binary")
    got = by_source(run(df, availability=Routing(deep_available=False))[0])
    assert (got["a.docx"].engine, got["a.docx"].status, got["a.docx"].fallback_used) == ("breadth", "degraded", True)
    assert got["a.docx"].warnings == ["fell back to engine 'breadth'"] and got["a.docx"].markdown.startswith("# Title")
    assert (got["b.doc"].engine, got["b.doc"].status, got["b.doc"].errors) == ("deep", "error", []) and "not available" in got["b.doc"].warnings[0]
    alone = by_source(run(df, Settings(allow_fallback=False), availability=Routing(deep_available=False))[0])
    assert alone["a.docx"].engine == "deep" and alone["a.docx"].status == "error" and alone["c.txt"].status == "ok"
    last = by_source(run(df, Settings(deep_first=False))[0])
    assert last["a.docx"].engine == "breadth" and not last["a.docx"].fallback_used


def test_outputs_and_sheets(spark):
    book = workbook({"One": [["h", "i"], ["x", None]], "Two": [["k"], ["y"]]}, {"One": ["A1:B1"]})
    df = spark.createDataFrame([("/b.xlsx", book)], "source string, content binary")
    named = run(df, Settings(sheets=("Two", "Phantom")))[0].first()
    assert "sheet: Two" in named.markdown and "sheet: One" not in named.markdown and "Phantom" in named.warnings[0]
    page = run(df, Settings(output="html", cleaning=False))[0].first()
    assert page.markdown.count("<table") == 2 and 'colspan="2"' in page.markdown and page.markdown.index("One") < page.markdown.index("Two")
    parts = run(df, Settings(output="json", cleaning=False))[0].first().markdown.split("\n\n")
    assert [json.loads(p)["metadata"]["sheet"] for p in parts] == ["One", "Two"]
    enhanced = run(df, Settings(enhanced_md=True))[0].first()
    assert "| h | &nbsp; |" in enhanced.markdown
    nothing = run(df, Settings(sheets=("Phantom",), allow_fallback=False))[0].first()
    assert nothing.status == "error" and "Phantom" in nothing.errors[0]
    with pytest.raises(ValueError):
        run(df, Settings(output="pdf"))
    with pytest.raises(ValueError):
        run(df, Settings(chunking=ChunkSettings(True, "fixed", 5, 5)))


def test_captions_come_before_chunks(spark):
    df = spark.createDataFrame([("/a.md", "x ![](http://i/1.png) y ![ ](<http://i/2.png>) ![alt](z)".encode()), ("/b.md", b"no image"), ("/c.md", b"![](bad)")], "source string, content binary")
    on = CaptionSettings(True, "ollama", "http://llm", "", "m")

    def describe(url: str) -> str:
        if url == "bad":
            raise RuntimeError("down")
        return {"http://i/1.png": " first ", "http://i/2.png": ""}[url]

    results, chunks = run(df, Settings(captions=on, chunking=ChunkSettings(True, "fixed", 500, 0)), describe)
    got = by_source(results)
    assert got["a.md"].markdown == "x ![](http://i/1.png)\n\n> 🖼️ 图片描述：first y ![ ](<http://i/2.png>) ![alt](z)"
    assert got["b.md"].warnings == [] and "RuntimeError: down" in got["c.md"].warnings[0] and got["c.md"].markdown == "![](bad)"
    assert {r.chunk_text for r in chunks.collect()} == {r.markdown for r in got.values()}
    for settings in (Settings(captions=on, offline=True), Settings(captions=CaptionSettings(False))):
        assert all(r.warnings == [] for r in run(df, settings, describe)[0].collect())
    assert all("describe" in r.warnings[0] for r in run(df, Settings(captions=on))[0].collect())
    incomplete = CaptionSettings(True, "openai", "http://llm", "", "m")
    assert not incomplete.usable() and on.usable() and on.sent_key() == "ollama"
    assert all("missing" in r.warnings[0] for r in run(df, Settings(captions=incomplete), describe)[0].collect())


def test_no_chunks_is_no_success(spark):
    df = spark.createDataFrame([("/a.md", b"text"), ("/b.md", b" \n ")], "source string, content binary")
    got = by_source(run(df, Settings(chunking=ChunkSettings(True, "markdown")))[0])
    assert (got["a.md"].chunk_count, got["a.md"].success) == (1, True)
    assert got["b.md"].chunk_count == 0 and not got["b.md"].rag_failed


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("/x/a b.md", "# H\none".encode()), ("/y/a b.md", b"two"), ("/z/c.doc", b"")], "source string, content binary")
    results, chunks = run(df, Settings(chunking=ChunkSettings(True, "markdown")))
    written = sinks.write_results(results, f"{tmp_path}/out").collect()
    assert sorted(p.name for p in Path(tmp_path, "out").iterdir()) == ["a_b.md", "a_b_1.md"]
    for r in written:
        assert r.output_paths == [] if r.status == "error" else Path(r.output_paths[0]).read_text() == r.markdown
    Path(tmp_path, "file").write_text("in the way")
    broken = {r.source: r for r in sinks.write_results(results, f"{tmp_path}/file").collect()}
    assert broken["/x/a b.md"].status == "degraded" and "failed" in broken["/x/a b.md"].warnings[-1]
    sinks.write_chunks(chunks, f"{tmp_path}/chunks")
    lines = [json.loads(x) for p in Path(tmp_path, "chunks").glob("part-*") for x in p.read_text().splitlines()]
    assert {"source": "/x/a b.md", "engine": "breadth", "start_index": 0, "end_index": 7, "metadata": {"chunk_index": 0, "chunk_count": 1, "header": "H"}, "text": "# H\none"} in lines
    made = {json.loads(r.line)["source"]: json.loads(r.line) for r in sinks.result_lines(results, chunks).collect()}
    assert list(made["/z/c.doc"]) == [*sinks.RESULT_KEYS, "markdown", "chunks"] and made["/z/c.doc"]["chunks"] == []
    assert [c["text"] for c in made["/x/a b.md"]["chunks"]] == ["# H\none"]
    assert "markdown" not in json.loads(sinks.result_lines(results, None, False).first().line)


def test_a_file_for_each_sheet(spark, tmp_path):
    book = workbook({"One": [["h"], ["x"]], "T/wo": [["k"], ["y"]], "T:wo": [["k"], ["z"]], "Empty": [[]]})
    df = spark.createDataFrame([("/in/b.xlsx", book), ("/in/c.xlsx", workbook({"S": [["h"], ["x"]]}))], "source string, content binary")
    results, _ = run(df, Settings(output_dir=str(tmp_path)))
    got = by_source(sinks.write_results(results, str(tmp_path)))
    assert [Path(p).name for p in got["b.xlsx"].output_paths] == ["b_One.md", "b_T_wo.md", "b_T_wo_1.md"] and got["b.xlsx"].status == "ok"
    assert Path(got["b.xlsx"].output_paths[2]).read_text().endswith("| z |") and [Path(p).name for p in got["c.xlsx"].output_paths] == ["c.md"]


def test_command(spark, tmp_path):
    Path(tmp_path, "a.md").write_text("text\n\n\n\nmore")
    said: list[str] = []
    assert cli.main(["convert", f"{tmp_path}/a.md", "--json", "--chunk", "fixed", "--export-chunks", f"{tmp_path}/c"], spark, said.append) == 0
    row = json.loads(said[0])
    assert (row["status"], row["markdown"], row["chunk_count"]) == ("ok", "text\n\nmore", 1) and list(Path(tmp_path, "c").glob("part-*"))
    assert cli.main(["convert", f"{tmp_path}/none.md", "--output-dir", f"{tmp_path}/o"], spark, said.append) == 1
    assert "FileNotFoundError" in said[-1]
    assert cli.main(["convert", "x", "--chunk", "fixed", "--chunk-overlap", "600"], spark, said.append) == 2
    args = cli.parser().parse_args(["convert", "x", "--no-spaces", "--captions", "--llm-model", "m"])
    made = cli.settings(args, {"DOCLAKE_LLM_BASE_URL": "http://l", "DOCLAKE_LLM_MODEL": "other", "DOCLAKE_LLM_PROVIDER": "ollama"})
    assert made.rules == Rules(spaces=False) and made.captions == CaptionSettings(True, "ollama", "http://l", "", "m")
    assert made.flat()["captions.model"] == "m"


def test_watched_folder(spark, tmp_path):
    folder = Path(tmp_path, "in")
    folder.mkdir()
    writer = lambda: convert_stream(inbox(spark, str(folder), max_files=1), f"{tmp_path}/out", f"{tmp_path}/mark", Settings(chunking=ChunkSettings(True)))
    for n in (1, 2):
        Path(folder, f"{n}.txt").write_text(f"file {n}")
        query = writer().trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/results").collect()
    assert sorted(r.markdown for r in got) == ["file 1", "file 2"]
    assert spark.read.parquet(f"{tmp_path}/out/chunks").count() == 2
