"""Reports as JSON, Markdown or plain text.

A report takes the first rows it shows from each result; only the JSON form reads
results to the end, row by row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows(df: DataFrame | None, count: int) -> list:
    return [] if df is None else df.take(count)


def json_rows(df: DataFrame | None) -> Iterator[dict]:
    if df is not None:
        for row in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            yield json.loads(row.j)


def json_text(value, margin: str = "") -> Iterator[str]:
    """A value as indented JSON, piece by piece; an iterator is a list whose members are read one by one."""
    if isinstance(value, dict):
        opened, closed, members = "{", "}", ((json.dumps(k, ensure_ascii=False) + ": ", v) for k, v in value.items())
    elif isinstance(value, Iterator):
        opened, closed, members = "[", "]", (("", v) for v in value)
    else:
        yield json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n" + margin)
        return
    yield opened
    lead = "\n"
    for name, member in members:
        yield f"{lead}{margin}  {name}"
        yield from json_text(member, margin + "  ")
        lead = ",\n"
    yield closed if lead == "\n" else f"\n{margin}{closed}"


def as_json(result: dict) -> Iterator[str]:
    """The report as pieces of JSON text. Long results (calls, callers, usages, commits) pass through row by row; only the
    symbols, at most 20, are held."""
    graph, impact, history = result.get("graph"), result.get("impact"), result.get("history")
    symbols = list(json_rows(result["symbols"]))
    out = {
        "primarySymbol": symbols[0] if symbols else None,
        "allSymbols": symbols,
        "files": json_rows(result["search"].files),
        "symbols": json_rows(result["search"].symbols),
        "usages": json_rows(result.get("usages")),
        "dependencyGraph": graph and {
            "root": next(json_rows(graph.root), None), "calls": json_rows(graph.calls), "calledBy": json_rows(graph.called_by)},
        "impactAnalysis": impact and {
            **next(json_rows(impact.summary)), "affectedFiles": json_rows(impact.affected_files),
            "testFiles": (r["path"] for r in json_rows(impact.test_files))},
        "gitHistory": history and {
            "filePath": history.file_path, "recentCommits": json_rows(history.recent_commits),
            "fileChanges": json_rows(history.file_changes), "blame": json_rows(history.blame),
            **next(json_rows(history.summary)), "authors": json_rows(history.authors),
            "changeFrequency": next(json_rows(history.change_frequency)), "relatedFiles": json_rows(history.related_files)},
        "recentChanges": None if result.get("recent") is None else json_rows(result["recent"]),
        "totalTokens": result["search"].total_tokens,
        "truncated": result["search"].truncated,
    }
    return json_text(out)


def _section(title: str, lines: list[str]) -> list[str]:
    return [title, *lines, ""] if lines else []


def _more(values: list, count: int) -> str:
    return ", ".join(str(v) for v in values[:count]) + ("..." if len(values) > count else "")


def recent_files(recent: DataFrame | None, count: int) -> list:
    """The newest commit of each of the most changed files."""
    if recent is None:
        return []
    newest = recent.groupBy("path", "commits").agg(F.min_by(F.struct("message", "author"), "ordinal").alias("c"))
    return rows(newest.select("path", "commits", "c.*").orderBy(F.desc("commits"), "path"), count)


def as_markdown(term: str, result: dict, include_tests: bool = False, blame: bool = False, days: int | None = None) -> str:
    out = [f"# Context for: {term}", ""]
    symbols = rows(result["symbols"], 6)
    if symbols:
        first = symbols[0]
        out += [f"## {first.name} ({first.type})", f"📍 {first.file_path}:{first.line_start}-{first.line_end}", ""]
        if first.signature:
            out += ["### Signature", "```typescript", first.signature, "```", ""]
    out += _section("### Related Symbols", [
        f"- **{s.name}** ({s.type}) - {s.file_path}:{s.line_start}" for s in symbols[1:6]])
    files = rows(result["search"].files, 10)
    out += _section("### Found in Files", [line for f in files[:5] for line in _file_lines(term, f)])
    out += _graph_lines(result.get("graph")) + _impact_lines(result.get("impact"))
    out += _history_lines(result.get("history"), blame)
    recent = recent_files(result.get("recent"), 10)
    out += _section(f"### 🔄 Recent Changes (last {days or 7} days)", [
        line for r in recent for line in (
            f"- **{r.path}** ({r.commits} commits)",
            f'  Last: "{r.message}" by {r.author}')])
    out += _section("### Text References", [
        line for u in rows(result.get("usages"), 10) for line in (
            f"- **{u.relative_path}**", f"  Lines: {_more(u.lines, 3)}")])
    if include_tests and any("test" in f.relative_path for f in files):
        tests = [f for f in files if "test" in f.relative_path or "spec" in f.relative_path]
        out += _section("### Test Files", [f"- **{f.relative_path}**" for f in tests[:3]])
    out += ["### Token Usage", f"- Total tokens: {result['search'].total_tokens}"]
    if result["search"].truncated:
        out.append("- ⚠️ Results truncated (increase --tokens for more context)")
    return "\n".join(out)


def _file_lines(term: str, file) -> list[str]:
    wanted = term.lower()
    lines = [f"- **{file.relative_path}** ({file.tokens} tokens)"]
    imports = [i for i in file.imports or [] if i.lower() in wanted or wanted in i.lower()]
    exports = [e for e in file.exports or [] if wanted in e.lower()]
    inside = [f"{s.name} ({s.type})" for s in file.symbols or [] if wanted in s.name.lower()]
    for label, found in (("Imports", imports), ("Exports", exports), ("Contains", inside)):
        if found:
            lines.append(f"  - {label}: {', '.join(found)}")
    return lines


def _graph_lines(graph) -> list[str]:
    if graph is None:
        return []
    calls, callers = [], []
    for e in graph.calls.toLocalIterator():
        place = e.file_path if e.file_path == "external" else f"{e.file_path}:{e.line}"
        calls += [f"- **{e.name}** ({e.call_type}) - {place}", f"  Called at line {e.call_line}"]
    for e in graph.called_by.toLocalIterator():
        callers += [f"- **{e.name}** in {e.file_path}:{e.line}", f"  Calls at line {e.call_line}"]
    return _section("### Calls (Outgoing Dependencies)", calls) + _section("### Called By (Incoming Dependencies)", callers)


def _impact_lines(impact) -> list[str]:
    if impact is None:
        return []
    s = impact.summary.first()
    out = ["### 🎯 Impact Analysis", f"**Risk Level: {s.risk_level}**", ""]
    out += _section("#### Impact Summary", [
        f"- **Direct references:** {s.direct_references}", f"- **Files affected:** {s.files_affected}",
        f"- **Symbols affected:** {s.symbols_affected}", f"- **Tests affected:** {s.tests_affected}"])
    out += _section("#### Risk Factors", [f"- {f}" for f in s.risk_factors])
    out += _section("#### Most Affected Files", [
        line for f in rows(impact.affected_files, 10) for line in (
            f"- **{f.path}** {'(test)' if f.is_test else ''}", f"  {f.reference_count} references at lines: {_more(f.lines, 5)}")])
    return out + _section("#### Suggestions", [f"- {t}" for t in s.suggestions])


def _history_lines(history, blame: bool) -> list[str]:
    if history is None:
        return []
    s, often = history.summary.first(), history.change_frequency.first()
    out = ["### 📜 Git History", f"**Last modified:** {_day(s.last_modified)}", f"**First seen:** {_day(s.first_seen)}",
           f"**Total commits:** {s.total_commits}", f"**Unique authors:** {s.unique_authors}", ""]
    out += _section("#### Change Frequency", [
        f"- Last {d} days: {often[f'last_{d}_days']} commits" for d in (7, 30, 90)])
    out += _section("#### Recent Commits", [
        line for c in rows(history.recent_commits, 5) for line in (
            f"- **{c.hash[:7]}** - {c.message}", f"  {c.author} on {_day(c.date)}")])
    if blame:
        out += _section("#### Git Blame", [
            line for b in rows(history.blame, 10) for line in (
                f"- Line {b.line}: {b.author} ({_day(b.date)})", f"  `{b.content.strip()}`")])
    return out + _section("#### Files Often Changed Together", [
        f"- **{r.path}** ({r.co_change_count} co-changes)" for r in rows(history.related_files, 5)])


def _day(moment) -> str:
    return "" if moment is None else f"{moment.month}/{moment.day}/{moment.year}"


def as_text(term: str, result: dict) -> str:
    symbols, files = rows(result["symbols"], 20), rows(result["search"].files, 100)
    out = [f'🔍 Context for: "{term}"', "━" * 60]
    if not symbols and not files:
        return "\n".join([*out, "No results found.", "", "💡 Try:", "  • Different search terms",
                          "  • Check indexed files: lodebook stats"])
    if symbols:
        s = symbols[0]
        out += ["", "🎯 Primary Match:", f"   {s.name} ({s.type})", f"   📍 {s.file_path}:{s.line_start}-{s.line_end}"]
        if s.signature:
            out.append(f"   Signature: {s.signature[:100]}{'...' if len(s.signature) > 100 else ''}")
    if len(symbols) > 1:
        out += ["", "🏷️ Other Matches:"]
        for i, s in enumerate(symbols[1:6], start=2):
            out += [f"   {i}. {s.name} ({s.type})", f"      {s.file_path}:{s.line_start}"]
    if files:
        out += ["", "📁 Found in Files:"]
        for i, f in enumerate(files[:5], start=1):
            out += [f"   {i}. {f.relative_path}", f"      {f.language or 'unknown'} | {f.tokens} tokens"]
    out += ["", "━" * 60, "📊 Summary:", f"  • Symbols found: {len(symbols)}", f"  • Files found: {len(files)}",
            f"  • Total tokens: {result['search'].total_tokens:,}"]
    if result["search"].truncated:
        out += ["", "  ⚠️ Results truncated due to token limit"]
    return "\n".join([*out, "", "💡 Tips:", "  • Use --format ai for AI-optimized markdown output",
                      "  • Use --include-tests to include test files",
                      "  • Use --include-callers to find usage locations"])


def stats_json(stats: dict[str, DataFrame]) -> str:
    total = stats["totals"].first()
    return json.dumps({
        "status": "indexed" if total.file_count else "empty", "files": total.file_count, "symbols": total.symbol_count,
        "tokens": total.total_tokens, "last_indexed": total.last_indexed and total.last_indexed.isoformat() + "Z",
        "languages": list(json_rows(stats["languages"])),
        "largest_files": [{"path": f.relative_path, "size": f.size, "tokens": f.tokens} for f in rows(stats["largest_files"], 5)],
    }, indent=2)


def stats_text(stats: dict[str, DataFrame], share: DataFrame, totals: DataFrame, largest: DataFrame,
               location: str, detailed: bool) -> str:
    """`totals` and `largest` carry the sizes and ages as text."""
    t = totals.first()
    out = ["📊 lodebook Index Statistics", "━" * 50]
    if not t.file_count:
        return "\n".join([*out, "No files indexed yet.", "", "💡 Get started:", "  lodebook index - Index current directory",
                          "  lodebook index /path/to/project - Index specific path"])
    out += ["", "📁 Overview:", f"  • Total files: {t.file_count:,}", f"  • Total symbols: {t.symbol_count:,}",
            f"  • Total size: {t.size_text}", f"  • Total tokens: {t.total_tokens:,}", f"  • Last indexed: {t.age_text}"]
    languages = share.collect()
    if languages:
        out += ["", "🗣️ Languages:"]
        for r in languages if detailed else languages[:10]:
            out.append(f"  {r.language.ljust(12)} {str(r['count']).rjust(5)} files ({r.percentage:.1f}%) {'█' * r.bar}")
        if not detailed and len(languages) > 10:
            out.append(f"  ... and {len(languages) - 10} more languages")
    out += ["", "📄 Largest Files:"]
    for i, f in enumerate(rows(largest, 10 if detailed else 5), start=1):
        path = f.relative_path if len(f.relative_path) <= 50 else "..." + f.relative_path[-47:]
        out += [f"  {str(i).rjust(2)}. {path}", f"      Size: {f.size_text} | Tokens: {f.tokens:,}"]
    if detailed:
        out += ["", "🗄️ Index:", f"  • Location: {location}"]
    return "\n".join([*out, "", "💡 Quick Tips:", '  • Search: lodebook query "search term"',
                      "  • Update index: lodebook index"])
