"""Command line: index, query, stats, clear.

    python -m lodebook.cli index [path]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator

from pyspark.sql import functions as F

from lodebook import render, validate
from lodebook.functions import text
from lodebook.operators import stats
from lodebook.plans.index import Index
from lodebook.plans.retriever import Retriever
from lodebook.session import build_session
from lodebook.sources.filetree import read_tree
from lodebook.sources.ignore import INDEX_FOLDER
from lodebook.sources.languages import ALIASES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodebook")
    top.add_argument("--project", default=".", help="project folder (its index lies below it)")
    top.add_argument("--index", help="index folder, if elsewhere")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("index", help="build or update the index")
    p.add_argument("path", nargs="?", default=None)
    p.add_argument("--clear", action="store_true", help="clear the index first")
    p.add_argument("--languages", help="part of a language, extension or path, separated by commas")
    p.add_argument("--max-size", default="1024", help="largest file in KB")
    p.add_argument("--force", "--update", action="store_true", help="index unchanged files again")
    p.add_argument("--quiet", action="store_true")
    p = commands.add_parser("query", help="search for symbols, files and relationships")
    p.add_argument("term")
    p.add_argument("--tokens", default="8000")
    p.add_argument("--format", default="ai")
    p.add_argument("--depth", default="1")
    p.add_argument("--include-tests", action="store_true")
    p.add_argument("--include-callers", action="store_true")
    p.add_argument("--show-graph", action="store_true")
    p.add_argument("--impact", action="store_true")
    p.add_argument("--recent")
    p.add_argument("--blame", action="store_true")
    p.add_argument("--languages")
    p = commands.add_parser("stats", help="state of the index")
    p.add_argument("--json", action="store_true")
    p.add_argument("--detailed", action="store_true")
    p = commands.add_parser("clear", help="delete the index")
    p.add_argument("-f", "--force", action="store_true")
    return top


def run_index(spark, args, root: str, folder: str) -> str:
    index = Index(spark, folder)
    out = []
    if args.clear:
        total = index.table("files").count()
        if total:
            out += ["⚠️  Clearing existing index:", f"   • {total:,} files", f"   • {index.table('symbols').count():,} symbols"]
            index.clear()
            out.append("✓ Index cleared")
    include = [n.strip() for n in args.languages.split(",") if n.strip()] if args.languages else None
    size = validate.positive_int(args.max_size, "--max-size") * 1024
    report = index.build(read_tree(spark, root, include=include, max_file_size=size), force=args.force)
    if args.quiet:
        return json.dumps({"indexed": report.files_indexed, "symbols": report.symbols_extracted,
                           "tokens": report.total_tokens, "time_ms": report.time_ms, "errors": report.errors})
    out += [f"🔍 Indexing codebase: {root}", "", "✅ Indexing complete!", "📊 Summary:",
            f"  • Files indexed: {report.files_indexed}", f"  • Symbols extracted: {report.symbols_extracted}",
            f"  • Total tokens: {report.total_tokens:,}", f"  • Time elapsed: {report.time_ms / 1000:.2f}s"]
    if report.errors:
        out.append(f"  • Errors: {report.errors}")
    return "\n".join([*out, "", '💡 Next: lodebook query "search term"'])


def run_query(spark, args, root: str, folder: str) -> str | Iterator[str]:
    term = validate.search_term(args.term)
    tokens = validate.positive_int(args.tokens, "--tokens")
    form = validate.output_format(args.format)
    depth = validate.positive_int(args.depth, "--depth")
    languages = validate.languages(args.languages, ALIASES) if args.languages else None
    days = validate.positive_int(args.recent, "--recent") if args.recent else None
    retriever = Retriever(spark, folder, root)
    symbols = retriever.find_symbol(term, languages)
    result = {
        "symbols": symbols,
        "search": retriever.query(term, tokens, include_content=True, include_symbols=True, include_imports=True,
                                  languages=languages),
    }
    if args.include_callers and not symbols.isEmpty():
        result["usages"] = retriever.find_usages(term, languages, max_tokens=2000)
    if args.show_graph:
        result["graph"] = retriever.dependency_graph(term)
        if depth > 1:
            result["neighbourhood"] = retriever.call_graph(term, depth)
    if args.impact:
        result["impact"] = retriever.impact_analysis(term)
    if days or args.blame:
        result["history"] = retriever.git_history(term, blame=args.blame)
    if days:
        result["recent"] = retriever.recent_changes(days)
    if form == "json":
        return render.as_json(result)
    if form == "human":
        return render.as_text(term, result)
    return render.as_markdown(term, result, args.include_tests, args.blame, days)


def run_stats(spark, args, root: str, folder: str) -> str:
    retriever = Retriever(spark, folder, root)
    found = retriever.stats()
    if args.json:
        return render.stats_json(found)
    totals = found["totals"].withColumn("size_text", text.human_bytes(F.col("total_size"))).withColumn(
        "age_text", text.time_ago(F.col("last_indexed"), F.current_timestamp()))
    largest = found["largest_files"].withColumn("size_text", text.human_bytes(F.col("size")))
    return render.stats_text(found, stats.language_share(retriever.files), totals, largest, folder, args.detailed)


def run_clear(spark, args, root: str, folder: str) -> str:
    Index(spark, folder).clear()
    return "✅ Index cleared successfully!\n\n💡 Next step:\n  Run lodebook index to rebuild the index"


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "clear" and not args.force:
        print("⚠️  This will delete all indexed data.\nUse --force to skip this confirmation.")
        return 0
    root = os.path.abspath(getattr(args, "path", None) or args.project)
    folder = args.index or os.path.join(root, INDEX_FOLDER)
    run = {"index": run_index, "query": run_query, "stats": run_stats, "clear": run_clear}[args.command]
    try:
        shown = run(spark or build_session(master=os.environ.get("SPARK_MASTER", "local[*]")), args, root, folder)
        for piece in [shown] if isinstance(shown, str) else shown:
            print(piece, end="")
        print()
        return 0
    except validate.ValidationError as problem:
        print(f"❌ Validation error: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
