"""Everything an index can be asked. All methods return DataFrames or small reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodebook import cache
from lodebook.functions import text
from lodebook.functions.match import match_of
from lodebook.operators import extraction, graph, history, impact, packing, postings, related, resolve, search, stats, usages
from lodebook.operators import symbols as symbol_ops
from lodebook.plans.index import Index
from lodebook.session import materialize
from lodebook.sources import gitlog


MOST_LITERALS = 1000


@dataclass
class SearchResult:
    files: DataFrame
    symbols: DataFrame
    total_tokens: int
    truncated: bool


@dataclass
class DependencyGraph:
    root: DataFrame
    calls: DataFrame
    called_by: DataFrame


@dataclass
class Impact:
    summary: DataFrame
    affected_files: DataFrame
    test_files: DataFrame


@dataclass
class History:
    file_path: str
    recent_commits: DataFrame
    file_changes: DataFrame
    blame: DataFrame | None
    summary: DataFrame
    authors: DataFrame
    change_frequency: DataFrame
    related_files: DataFrame


class Retriever:
    def __init__(self, spark: SparkSession, index_folder: str, project_root: str | None = None):
        self.spark = spark
        self.index = Index(spark, index_folder)
        self.project_root = project_root
        self.version = self.index.version()
        self.files = self.index.table("files", self.version)
        self.symbols = self.index.table("symbols", self.version)
        self.edges = self.index.table("call_graph", self.version)
        self.cache = cache.ResultCache(spark, self.index.folder, self.version)

    def _ranked(self, kind: str, term: str, **keys) -> DataFrame:
        """Scores from the postings of the term's words."""
        found = self.index.postings(kind, match_of(term).words(), self.version)
        total, length = self.index.corpus(kind, self.version)
        return postings.ranked(found, term, max(1, total), max(1, length), bucketed=False, **keys)

    def _with_text(self, term: str, wildcards: bool = False) -> DataFrame:
        """The files whose text may hold a term."""
        return self.index.files_with(term, self.version, wildcards)

    # -- search ---------------------------------------------------------------------

    def _ranked_files(self, term: str, sort_by: str, languages, limit: int) -> DataFrame:
        """The top files with `position`, `file_id`: from the inverted index where it applies."""
        if match_of(term) is None:
            hits = search.like_files(self._with_text(term, wildcards=True), term, limit=limit, languages=languages)
            order = [F.col("relative_path"), F.col("file_id")]
            return hits.withColumn("position", F.row_number().over(_window(order))).select("file_id", "position")
        hits = self._ranked("files", term)
        if languages or sort_by != "relevance":
            narrow = self.files.select("file_id", "relative_path", "language", "size", "last_modified")
            if languages:
                narrow = narrow.filter(F.col("language").isin(languages))
            hits = hits.join(narrow, "file_id")
        order = [*search.SORT_KEYS[sort_by](), F.col("file_id")]
        top = hits.orderBy(*order).limit(limit)
        return top.withColumn("position", F.row_number().over(_window(order))).select("file_id", "position")

    def _file_results(self, ranked: DataFrame, include_content=False, include_symbols=False,
                      include_imports=False) -> DataFrame:
        """Result rows for the (few) chosen files, in order, with their token estimate.

        The ids of a top-k result are literals in the filter, which lets the scan skip row groups.
        """
        chosen = {r.file_id: r.position for r in ranked.collect()}
        ids = list(chosen)
        wanted = self.files.filter(F.col("file_id").isin(ids))
        shown = ["file_id", "path", "relative_path", "language", "tokens"]
        body = F.col("content") if include_content else text.preview(F.col("content"))
        result = wanted.select(
            *shown, body.alias("content" if include_content else "preview"),
            *(["imports", "exports"] if include_imports else []))
        if include_symbols:
            nested = symbol_ops.symbols_per_file(self.symbols.filter(F.col("file_id").isin(ids)))
            result = result.join(nested, "file_id", "left")
        position = F.element_at(F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair]), F.col("file_id")) \
            if chosen else F.lit(0)
        cost = text.estimate_tokens(F.to_json(F.struct(*result.columns)))
        return result.withColumn("result_tokens", cost).withColumn("position", position)

    def _packed(self, files: DataFrame, symbols: DataFrame, max_tokens: int) -> SearchResult:
        symbols = symbols.withColumn(
            "result_tokens", text.estimate_tokens(F.to_json(F.struct(*symbol_ops.RESULT))))
        plan = packing.pack_two_stage(
            files.select(F.col("file_id").alias("item_id"), "position", "result_tokens"),
            symbols.select(F.col("symbol_id").alias("item_id"), "position", "result_tokens"),
            max_tokens, [F.col("position")], [F.col("position")], tokens="result_tokens").collect()
        kept = [r for r in plan if r.kept]
        kept_files = [r.item_id for r in kept if r.kind == "file"]
        kept_symbols = [r.item_id for r in kept if r.kind == "symbol"]
        return SearchResult(
            files.filter(F.col("file_id").isin(kept_files)).orderBy("position"),
            symbols.filter(F.col("symbol_id").isin(kept_symbols)).orderBy("position"),
            sum(r.tokens for r in kept), len(kept) < len(plan))

    def query(self, term: str, max_tokens: int = 4000, include_content=False, include_symbols=False,
              include_imports=False, languages=None, sort_by: str = "relevance") -> SearchResult:
        """Files and symbols for a term, best first, under one token budget."""
        limit = 10 if match_of(term) else 100
        files = self._file_results(
            self._ranked_files(term, sort_by, languages, limit), include_content, include_symbols, include_imports)
        symbols = self._ranked_symbols(term, languages, 15)
        return self._packed(files, symbols, max_tokens)

    def search_full_text(self, term: str, max_tokens: int = 4000, languages=None, **include) -> SearchResult:
        """As `query`, with up to 20 symbols, 10 files also without a searchable word, and snippets."""
        files = self._file_results(self._ranked_files(term, "relevance", languages, 10), **include)
        match = match_of(term)
        if match is not None:
            content = self.files.select("file_id", search.snippet(
                F.col("content"), list(match.phrases[0])).alias("snippet"))
            files = files.join(content, "file_id", "left")
        symbols = self._ranked_symbols(term, languages, 20)
        return self._packed(files, symbols, max_tokens)

    def _symbol_hits(self, term: str) -> DataFrame:
        """symbol_id, name and score from the inverted index of the symbols."""
        return self._ranked("symbols", term, key="symbol_id", carry=("name",))

    def _ranked_symbols(self, term: str, languages, limit: int) -> DataFrame:
        hits = self._symbol_hits(term) if match_of(term) else None
        return symbol_ops.search_symbols(self.symbols, self.files, term, languages, limit, hits=hits)

    def find_symbol(self, name: str, languages=None) -> DataFrame:
        """The best symbols for a name: by relevance, then exact name, then short names."""
        hits = self._symbol_hits(name) if match_of(name) else None
        return symbol_ops.find_symbol(self.symbols, self.files, name, languages, hits=hits).drop("position")

    def find_usages(self, name: str, languages=None, max_tokens: int = 4000) -> DataFrame:
        return usages.find_usages(self._with_text(name, wildcards=True), self.symbols, name, max_tokens, languages)

    def file_context(self, path: str, **include) -> DataFrame:
        """One file by its path or relative path."""
        found = self.files.filter((F.col("path") == path) | (F.col("relative_path") == path)).limit(1)
        return self._file_results(found.select("file_id", F.lit(1).alias("position")), **include)

    def related_files(self, path: str, max_tokens: int = 4000, **include) -> DataFrame:
        """Files the imports of one file point to, five per import, under a token budget.

        A file that does not fit ends its import only, so this is a fold over the few rows found.
        """
        own = self.files.filter((F.col("path") == path) | (F.col("relative_path") == path)).select("imports").first()
        found = related.imported_files(self.files, own.imports if own else []).collect()
        numbered = self.spark.createDataFrame(
            [(r.file_id, i) for i, r in enumerate(found)], "file_id string, position int")
        shown = self._file_results(numbered.dropDuplicates(["file_id"]), **include).drop("position")
        cost = {r.file_id: r.result_tokens for r in shown.select("file_id", "result_tokens").collect()}
        kept, total, stopped = [], 0, None
        for i, row in enumerate(found):
            if row.import_no == stopped:
                continue
            if total + cost[row.file_id] > max_tokens:
                stopped = row.import_no
                continue
            total += cost[row.file_id]
            kept.append((row.file_id, i))
        chosen = self.spark.createDataFrame(kept, "file_id string, position int")
        return shown.join(chosen, "file_id").orderBy("position")

    # -- graph and impact -------------------------------------------------------------

    def _root(self, name: str):
        """The symbol that a name stands for: found by its definition, read from the bucket of its file."""
        exact = self.index.lookup("definitions", [name], self.version).filter(F.col("rank") < resolve.DOTTED)
        first = exact.agg(F.min(F.struct("file_id", "rank")).alias("first")).select(
            F.col("first.file_id").alias("file_id"),
            extraction.symbol_id_of(F.col("first.file_id"), F.col("first.rank").cast("decimal(21,0)")).alias("symbol_id")).first()
        if first is None or first.file_id is None:
            return None
        return self.index.lookup("symbols", [first.file_id], self.version).filter(F.col("symbol_id") == first.symbol_id).first()

    def _edges_to(self, name: str) -> DataFrame:
        """The edges that a name may be the callee of."""
        return self.index.lookup("call_graph", [name.rsplit(".", 1)[-1]], self.version)

    def _edges_from(self, root) -> DataFrame:
        """The edges of a symbol: the names that it calls lead to their buckets."""
        called = self.index.lookup("callers", [root.name], self.version).filter(F.col("file_id") == root.file_id)
        names = _few(called.select(resolve.last_part("callee").alias("name")))
        edges = self.edges if names is None else self.index.lookup("call_graph", names, self.version)
        return edges.filter(F.col("caller_symbol_id") == root.symbol_id)

    def _around(self, edges: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
        """The symbols and files at one end of some edges, read by their ids where these are few."""
        ids = _few(edges.select(F.col(f"{end}_file_id").alias("name")))
        if ids is None:
            return self.symbols, self.files
        return self.index.lookup("symbols", ids, self.version), self.files.filter(F.col("file_id").isin(ids))

    def dependency_graph(self, name: str) -> DependencyGraph | None:
        root = self._root(name)
        if root is None:
            return None
        own = self.index.lookup("symbols", [root.file_id], self.version).filter(F.col("symbol_id") == root.symbol_id)
        node = symbol_ops.with_file(own, self.files.filter(F.col("file_id") == root.file_id))
        made, received = self._edges_from(root), self._edges_to(name).filter(graph.refers_to(name, root.symbol_id))
        calls = graph.outgoing(made, *self._around(made, "callee"), root.symbol_id)
        called_by = graph.incoming(received, *self._around(received, "caller"), name, root.symbol_id)
        keep = cache.GRAPH_MINUTES
        return DependencyGraph(
            node.select("symbol_id", "file_id", "name", "type", "file_path", F.col("line_start").alias("line")),
            self.cache.through(f"calls {name}", calls, keep).orderBy("call_line", "name"),
            self.cache.through(f"called by {name}", called_by, keep).orderBy("file_path", "call_line", "name"))

    def call_graph(self, name: str, depth: int = 1) -> DataFrame:
        """caller, callee, distance around a name."""
        def pairs_of(names: list[str] | None) -> DataFrame:
            rows = self.index.table("callers", self.version) if names is None else self.index.lookup("callers", names, self.version)
            return rows.select("caller", "callee").distinct()

        return graph.walk(pairs_of, name, depth)

    def impact_analysis(self, name: str) -> Impact | None:
        root = self._root(name)
        if root is None:
            affected = impact.unindexed(self._with_text(name), name)
            summary = impact.unindexed_totals(affected).select(
                F.lit(name).alias("symbol"), F.lit("unknown").alias("type"), F.lit("not indexed").alias("location"),
                "*", F.lit(0).cast("long").alias("symbols_affected"))
            if summary.isEmpty():
                return None
            return Impact(summary, impact.top_affected(affected, limit=None), _tests(affected))
        edges = self._edges_to(name)
        affected = self.cache.through(
            f"impact {name}",
            impact.affected_files(
                self.files, edges, name, root.symbol_id, root.file_id, self._with_text(name)), cache.IMPACT_MINUTES)
        callers = impact.symbols_affected(edges, self.symbols, name, root.symbol_id)
        path = self.files.filter(F.col("file_id") == root.file_id).select("relative_path").first()[0]
        summary = impact.with_risk(impact.totals(affected), F.lit(root.name), F.lit(root.type)).select(
            F.lit(root.name).alias("symbol"), F.lit(root.type).alias("type"),
            F.lit(f"{path}:{root.line_start}").alias("location"), "*",
            callers.agg(F.count(F.lit(1)).alias("n")).scalar().alias("symbols_affected"))
        return Impact(summary, impact.top_affected(affected), _tests(affected))

    # -- history ------------------------------------------------------------------------

    def git_history(self, name: str, blame: bool = True) -> History | None:
        """History of the file of a symbol, or of the first file that holds the text."""
        if not self.project_root or not gitlog.run_git(self.project_root, "rev-parse", "HEAD"):
            return None
        root = self._root(name)
        if root is not None:
            row = self.files.filter(F.col("file_id") == root.file_id).select("relative_path").first()
        else:
            row = self._with_text(name, wildcards=True).filter(text.like_ci(F.col("content"), name)).select(
                F.min_by("relative_path", "file_id").alias("relative_path")).first()
        if row is None or row.relative_path is None:
            return None
        path = row.relative_path
        changes = materialize(gitlog.changes_of(gitlog.read_log(self.spark, self.project_root)), "git-log")
        own = history.commits_for(changes, path)
        origin = None
        if blame and root is not None:
            origin = gitlog.read_blame(self.spark, self.project_root, path, root.line_start, root.line_end)
        return History(
            path, history.recent_commits(changes, path).select(*history.COMMIT), history.file_changes(changes, path),
            origin, history.summary(own), history.authors(own),
            history.change_frequency(own, F.current_timestamp()), history.co_changed(changes, path))

    def recent_changes(self, days: int = 7) -> DataFrame:
        """The commits of each file changed in the last days; empty outside a repository."""
        log = gitlog.read_log(self.spark, self.project_root or "")
        return history.recent_changes(gitlog.changes_of(log), F.current_timestamp(), days)

    # -- statistics -----------------------------------------------------------------------

    def stats(self) -> dict[str, DataFrame]:
        return {
            "totals": stats.totals(self.files).withColumn(
                "symbol_count", self.symbols.agg(F.count(F.lit(1)).alias("n")).scalar()),
            "languages": stats.counts_by(self.files, "language"),
            "largest_files": stats.largest_files(self.files),
        }

    def context_summary(self) -> str:
        """A short text: counts, top languages and top symbol types."""
        info = self.stats()["totals"].first()
        out = ["📊 Project Context Summary", "━" * 22, f"📁 Files indexed: {info.file_count}",
               f"🔤 Symbols extracted: {info.symbol_count}", ""]
        languages = stats.counts_by(self.files, "language", 5).collect()
        if languages:
            out += ["🗣️ Languages:", *[f"  • {r.language}: {r['count']} files" for r in languages], ""]
        types = stats.counts_by(self.symbols, "type", 5).collect()
        if types:
            out += ["🏷️ Symbol Types:", *[f"  • {r.type}: {r['count']}" for r in types]]
        return "\n".join(out) + "\n"


def _few(names: DataFrame) -> list[str] | None:
    """The distinct values of the column `name` where they are few enough for literals."""
    rows = names.filter("name IS NOT NULL").distinct().limit(MOST_LITERALS + 1).collect()
    return [r.name for r in rows] if len(rows) <= MOST_LITERALS else None


def _window(order):
    """A window over a top-k result."""
    return Window.orderBy(*order)


def _tests(affected: DataFrame) -> DataFrame:
    return affected.filter("is_test").select("path").orderBy("path")
