"""``python -m doclake.cli convert FILE... [flags]``: converts files and addresses in one Spark job.

``test-llm`` asks the service that describes images whether it answers; ``engines`` tells which engine takes which formats.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Mapping

from doclake.config import CaptionSettings, ChunkSettings, Settings
from doclake.operators.cleaning import Rules


LLM = ("provider", "base-url", "api-key", "model", "prompt")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="doclake")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("engines", help="which engine takes which formats")
    test = commands.add_parser("test-llm", help="ask the service that describes images whether it answers")
    convert = commands.add_parser("convert", help="convert files, folders and addresses")
    for name in LLM:
        test.add_argument(f"--llm-{name}")
    add = convert.add_argument
    add("sources", nargs="+")
    add("--output", choices=("md", "html", "json"), default="md")
    add("--enhanced-md", action="store_true", help="show merged cells in Markdown tables")
    add("--sheet", action="append", default=[], help="only this worksheet; may be repeated")
    add("--output-dir")
    add("--deep-first", action=argparse.BooleanOptionalAction, default=True)
    add("--fallback", action=argparse.BooleanOptionalAction, default=True)
    add("--offline", action="store_true")
    add("--clean", action=argparse.BooleanOptionalAction, default=True)
    for rule in ("page-numbers", "empty-lines", "spaces", "duplicates"):
        add(f"--{rule}", action=argparse.BooleanOptionalAction, default=True)
    add("--chunk", choices=("fixed", "sentence", "markdown"))
    add("--chunk-size", type=int, default=512)
    add("--chunk-overlap", type=int, default=64)
    add("--max-chunk-size", type=int, default=0)
    add("--export-chunks", metavar="FOLDER", help="write chunks as JSON lines")
    add("--json", action="store_true", help="print results as JSON lines")
    add("--captions", action="store_true")
    for name in LLM:
        add(f"--llm-{name}")
    return top


def service(args: argparse.Namespace, enabled: bool, env: Mapping[str, str] = os.environ) -> CaptionSettings:
    """Flags first, then DOCLAKE_LLM_* of the environment."""
    llm = lambda name, default="": getattr(args, f"llm_{name}") or env.get(f"DOCLAKE_LLM_{name.upper()}", default)
    return CaptionSettings(enabled, llm("provider", "openai"), llm("base_url"), llm("api_key"), llm("model"), llm("prompt"))


def settings(args: argparse.Namespace, env: Mapping[str, str] = os.environ) -> Settings:
    """Flags first, then DOCLAKE_LLM_* of the environment."""
    return Settings(
        output=args.output,
        enhanced_md=args.enhanced_md,
        output_dir=args.output_dir,
        sheets=tuple(args.sheet),
        deep_first=args.deep_first,
        allow_fallback=args.fallback,
        offline=args.offline,
        cleaning=args.clean,
        rules=Rules(args.page_numbers, args.empty_lines, args.spaces, args.duplicates),
        chunking=ChunkSettings(bool(args.chunk), args.chunk or "fixed", args.chunk_size, args.chunk_overlap, args.max_chunk_size),
        captions=service(args, args.captions, env),
    )


def main(argv: list[str] | None = None, spark=None, out: Callable[[str], object] = print, describe: Callable[[str], str] | None = None) -> int:
    """0 if any source succeeded or the service answered, 1 if not, 2 for chunk numbers that can't be.

    Images are described by ``describe``, or else by the service that the flags name.
    """
    from doclake.operators.routing import DEEP_EXTENSIONS
    from doclake.sources.describe import describer, probe
    from doclake.sources.readers import BINARY

    args = parser().parse_args(argv)
    if args.command == "engines":
        out(f"deep: {' '.join(DEEP_EXTENSIONS)}")
        out(f"breadth: addresses, .html .htm .csv .docx .xlsx .xls and texts; not {' '.join('.' + b for b in BINARY if b not in ('docx', 'xlsx', 'xls'))}")
        return 0
    if args.command == "test-llm":
        answers, said = probe(service(args, True))
        out(("the service answers: " if answers else "the service doesn't answer: ") + said)
        return 0 if answers else 1
    wanted = settings(args)
    issues = wanted.chunking.issues() if wanted.chunking.enabled else []
    if issues:
        out("; ".join(issues))
        return 2
    from doclake.plans import sinks
    from doclake.plans.convert import run
    from doclake.session import session, staged
    from doclake.sources import readers

    spark = spark or session("doclake-convert")
    urls = [s for s in args.sources if "://" in s]
    there = [s for s in args.sources if "://" not in s and os.path.exists(s)]
    absent = [s for s in args.sources if "://" not in s and not os.path.exists(s)]
    sources = readers.addresses(spark, urls + absent)
    if there:
        sources = sources.unionByName(readers.files(spark, *there))
    if describe is None and wanted.captions.usable():
        describe = describer(wanted.captions)
    results, chunks = run(sources, wanted, describe)
    if wanted.output_dir:
        results = sinks.write_results(results, os.path.abspath(wanted.output_dir), wanted.output)
    results = staged(results, "printed")
    if args.export_chunks:
        sinks.write_chunks(chunks, os.path.abspath(args.export_chunks))
    shown = sinks.result_lines(results, chunks).orderBy("source").select("line") if args.json else results.orderBy("source").select("source", "engine", "status", "warnings", "errors", "markdown")
    for row in shown.toLocalIterator():
        if args.json:
            out(row.line)
        else:
            out("\n".join([f"[{row.status}] {row.source} ({row.engine})", *(f"  warning: {w}" for w in row.warnings), *(f"  error: {e}" for e in row.errors), "", row.markdown]))
    return 0 if results.where("success").limit(1).count() else 1


if __name__ == "__main__":
    sys.exit(main())
