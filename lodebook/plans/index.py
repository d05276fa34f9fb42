"""An index on disk: log-structured tables below one folder (see `segments`).

A build extracts what is new or changed and writes that as one segment. Calls in files that did not change are resolved
again only where a definition that came or went changes what their name stands for.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodebook import schema
from lodebook.functions import text
from lodebook.operators import extraction, postings, ranges, resolve
from lodebook.operators.search import SYMBOL_COLUMNS
from lodebook.plans.segments import KEYS, SegmentStore

BYTES_PER_FILE = 256 * 1024 * 1024
DETAILS = "details"  # imports, exports and structure in `files`
SYMBOLS = {"symbols", "symbol_postings"}
CALLS = {"call_graph", "callers"}
PLACES = ("symbol_id", "file_id", "name", "line_start", "line_end")  # of a symbol, all that calls and definitions need
# Tables that an index can do without; `files` and `sizes` are always kept.
PARTS = {*SYMBOLS, *CALLS, "definitions", "comments", "postings", "grams", DETAILS}


@dataclass
class BuildReport:
    files_indexed: int
    symbols_extracted: int
    total_tokens: int
    errors: int
    time_ms: int


def compare(scanned: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """path and state (new, changed, unchanged, deleted) from the path and hash columns.

    Only the narrow columns are shuffled. A known file with an `error` has failed before and counts as
    changed; a scanned one with an `error` could not be read: its old version stays, or it is `unreadable`.
    """
    def error_of(table: DataFrame):
        return F.col("error") if "error" in table.columns else F.lit(None).cast("string")

    left = scanned.select("path", F.col("hash").alias("new_hash"), error_of(scanned).isNotNull().alias("unreadable"))
    right = known.select("path", F.when(error_of(known).isNull(), F.col("hash")).otherwise("").alias("old_hash"))
    state = (
        F.when(F.col("unreadable"), F.when(F.col("old_hash").isNull(), "unreadable").otherwise("unchanged"))
        .when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when((F.col("old_hash") != F.col("new_hash")) | F.lit(force), "changed")
        .otherwise("unchanged")
    )
    return left.join(right, "path", "full").select("path", state.alias("state"))


def merge_metadata(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Merge-patch of flat string maps: a value replaces, a NULL value removes, others stay."""
    merged = F.map_filter(
        F.map_zip_with(
            "metadata", F.coalesce("patch", F.create_map().cast("map<string,string>")),
            lambda k, old, new: F.when(F.array_contains(F.map_keys("patch"), k), new).otherwise(old)),
        lambda k, v: v.isNotNull())
    return base.join(patch, key, "left").withColumn("metadata", merged).drop("patch")


class Index:
    def __init__(self, spark: SparkSession, folder: str, only: Iterable[str] | None = None):
        """`only` names the PARTS that the first build begins with and every later one keeps up; by default all.

        Of `files` in an index without details imports, exports and structure are empty; without symbols there are none in `sizes`.
        """
        if only is not None and not set(only) <= PARTS:
            raise ValueError(f"no parts of an index: {sorted(set(only) - PARTS)}")
        self.only = None if only is None else {*only, *(["definitions"] if "call_graph" in only else [])}
        self.spark = spark
        self.store = SegmentStore(spark, folder)
        self.folder = self.store.folder

    # -- versions -----------------------------------------------------------------

    def versions(self) -> list[str]:
        """Complete versions, oldest first."""
        return self.store.versions()

    def version(self) -> str | None:
        return self.store.version()

    def parts(self, version: str | None = None) -> set[str]:
        """The parts that this index keeps."""
        version = version or self.version()
        kept = self.only if version is None else self.store.manifest(version).get("parts")
        kept = PARTS if kept is None else set(kept)
        if self.only is not None and kept != self.only:
            raise ValueError(f"the index has other parts: {sorted(kept)}")
        return kept

    def table(self, name: str, version: str | None = None) -> DataFrame:
        return self.store.live(name, version or self.version()).drop("segment")

    def corpus(self, kind: str, version: str | None = None) -> tuple[int, int]:
        """Number of documents (files or symbols) and of their tokens."""
        total, length = self.store.manifest(version or self.version())["corpus"][kind]
        return total, length

    def postings(self, kind: str, words: list[str], version: str | None = None) -> DataFrame:
        """The postings of a few words in files or symbols."""
        return self.store.postings("postings" if kind == "files" else "symbol_postings", version or self.version(), words)

    def files_with(self, term: str, version: str | None = None, wildcards: bool = False) -> DataFrame:
        """Files whose text may hold a term, without reading the others; whether it does is for the caller to see."""
        return self.store.files_with(version or self.version(), term, wildcards)

    def lookup(self, name: str, keys: list[str], version: str | None = None) -> DataFrame:
        """Rows of a table with one of a few keys (symbols by file, definitions by name, edges by the last part of the
        callee, callers by their name); only the buckets of these keys are opened."""
        return self.store.lookup(name, version or self.version(), keys)

    def clear(self) -> None:
        self.store.clear()

    def vacuum(self, keep: int = 1, grace_hours: float = 24) -> None:
        self.store.vacuum(keep, grace_hours)

    # -- build --------------------------------------------------------------------

    def build(self, scanned: DataFrame, force: bool = False, whole: bool = True) -> BuildReport:
        """Bring the index to the state of a scan (columns as in `filetree.with_derived`).

        With `whole` files that the scan does not have leave the index; otherwise only those that it has are looked at.
        """
        started = time.time()
        store, old = self.store, self.version()
        manifest = store.manifest(old)
        segment, parts = store.new_segment(), self.parts(old)

        live_files = store.live("files", old).select("path", "file_id", "hash", "error", "segment")
        if not whole:
            live_files = live_files.join(scanned.select("path"), "path", "left_semi")
        unreadable = scanned.filter("error IS NOT NULL").count() if "error" in scanned.columns else 0
        if old is None:
            dead = live_files.select("file_id", F.col("segment").alias("of"))
            fresh = scanned.filter("error IS NULL") if "error" in scanned.columns else scanned
            fresh = fresh.drop("error").filter("path IS NOT NULL")
            nothing = fresh.isEmpty()
        else:
            state = store.work("state", segment, compare(scanned, live_files.drop("segment", "file_id"), force))
            gone = state.filter(F.col("state").isin("changed", "deleted")).select("path")
            dead = store.save("dead_files", segment, live_files.join(gone, "path").select("file_id", F.col("segment").alias("of")))
            # Stored, so that its size is known: where few files changed no text is shuffled to find them.
            touched = store.work("touched", segment, state.filter(F.col("state").isin("new", "changed")).select("path"))
            fresh = scanned.drop("error").join(touched, "path", "left_semi")
            nothing = state.filter("state NOT IN ('unchanged', 'unreadable')").isEmpty()
        if nothing:
            store.forget(segment)
            return BuildReport(0, 0, 0, unreadable, int((time.time() - started) * 1000))

        fresh = fresh.withColumn("file_id", F.md5("path"))
        matches = plain = symbols = calls = own = None
        rows, again = dict.fromkeys(KEYS, 0), {}
        kinds = _kinds_of(parts)
        if kinds is None or kinds:
            matches = store.work("matches", segment, extraction.find_matches(fresh, kinds))
        if parts & {*SYMBOLS, *CALLS, "definitions", DETAILS}:
            found = extraction.symbols_of(matches)
            plain = store.work("plain_symbols", segment, found if parts & {*SYMBOLS, DETAILS} else found.select(*PLACES))
            rows["symbols"] = rows["definitions"] = plain.count()
        if parts & SYMBOLS:
            tasks = ranges.tasks_for(plain, matches.count())
            symbols = extraction.with_members(plain, extraction.class_members(matches, plain, tasks), tasks)
            symbols = store.save("symbols", segment, symbols, rows["symbols"]) if "symbols" in parts else store.work("symbols", segment, symbols)
        if "comments" in parts:
            store.save("comments", segment, extraction.comments_of(matches))
        size = int(fresh.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        files = self._save_files(segment, size, fresh, matches, plain if DETAILS in parts else None)
        if "grams" in parts:
            store.save_grams(segment, files, size)
        if "definitions" in parts:
            own = store.save("definitions", segment, resolve.definitions_of(plain), rows["definitions"])
        if parts & CALLS:
            calls = store.work("calls", segment, resolve.calls_in_place(extraction.calls_of(matches), plain, own))
            rows["callers"] = calls.count()
        if "callers" in parts:
            names = plain.select("file_id", extraction.order_text("symbol_id").alias("caller_order"), F.col("name").alias("caller"))
            store.save("callers", segment, calls.join(names, ["file_id", "caller_order"]).select(
                "caller", F.col("callee_name").alias("callee"), "file_id").distinct(), rows["callers"])
        if "call_graph" in parts:
            again, rows["call_graph"] = self._save_edges(segment, old, dead, own, calls, rows["callers"])
        sizes = store.save("sizes", segment, _sizes_of(files, symbols))
        totals = _totals(sizes)
        store.save_postings(
            segment, postings.build(files) if "postings" in parts else None,
            postings.build(symbols, "symbol_id", SYMBOL_COLUMNS, carry=("name",)) if "symbol_postings" in parts else None)

        done = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count("error")).first()
        gone = _per_segment(dead) if old is not None else {}
        lost = _totals(store.live("sizes", old).join(
            dead.withColumnRenamed("of", "segment"), ["file_id", "segment"], "left_semi")) if gone else {k: [0, 0] for k in totals}
        entries = [{**s, "dead_files": s["dead_files"] + gone.get(s["id"], 0),
                    "dead_edges": s["dead_edges"] + again.get(s["id"], 0)} for s in manifest["segments"]]
        entries.append(store.entry(segment, totals, size, rows, [n for n, c in (("dead_files", gone), ("dead_edges", again)) if c]))
        corpus = {kind: [manifest["corpus"][kind][i] + totals[kind][i] - lost[kind][i] for i in (0, 1)] for kind in totals}
        store.commit(old, {"segments": entries, "corpus": corpus, **({} if parts == PARTS else {"parts": sorted(parts)})})
        store.delete(f"work/{segment}")
        self.compact()
        return BuildReport(
            files_indexed=done[0] - done[2], symbols_extracted=totals["symbols"][0], total_tokens=done[1],
            errors=done[2] + unreadable, time_ms=int((time.time() - started) * 1000))

    def _save_files(self, segment: str, size: int, fresh: DataFrame, matches: DataFrame | None, symbols: DataFrame | None) -> DataFrame:
        none = F.array().cast("array<string>")
        if matches is None:
            found = fresh.withColumn("error", F.when(F.col("content").isNull(), F.lit("no text")))  # as extraction reports it
        else:
            details = self.store.work("errors", segment, matches.filter(F.col("kind") == "error").select("file_id", "error"))
            if symbols is not None:
                details = extraction.imports_exports_of(matches).join(
                    extraction.structure_of(symbols), "file_id", "full").join(details, "file_id", "full")
            found = fresh.join(details, "file_id", "left")
        if symbols is None:
            found = found.withColumns({"imports": none, "exports": none, "structure": F.lit(None).cast(schema.STRUCTURE)})
        new = found.select(
            "file_id", "path", "relative_path", "content", "hash", "size", "language", "last_modified",
            F.current_timestamp().alias("indexed_at"), text.estimate_tokens(F.col("content")).alias("tokens"),
            postings.document_length().alias("index_tokens"),
            F.coalesce("imports", none).alias("imports"), F.coalesce("exports", none).alias("exports"),
            "structure", "error")
        return self.store.save("files", segment, _in_ranges(new, size))

    def _save_edges(self, segment: str, old: str | None, dead: DataFrame, own: DataFrame, calls: DataFrame,
                    new: int) -> tuple[dict[str, int], int]:
        """Write the edges of the new calls and of the old calls whose name stands for something else now.

        Gives the number of replaced rows by segment and the number of edges. Only the definitions of names that the new files call or define, or that the dead ones defined, are looked at.
        """
        store = self.store
        moved, edges, winners = {}, calls, None
        if old is None:
            winners = store.work("winners", segment, resolve.winners_of(own))
        else:
            dead = dead.withColumnRenamed("of", "segment")
            known = store.live("definitions", old)
            lost = known.join(dead, ["file_id", "segment"], "left_semi").select("name")
            asked = store.work("names", segment, lost.union(own.select("name")).union(
                calls.select(resolve.last_part("callee_name"))).distinct())
            around = store.work("definitions", segment, known.join(asked, "name", "left_semi").join(
                dead.withColumn("dead", F.lit(True)), ["file_id", "segment"], "left").drop("segment"))
            stay = around.filter("dead IS NULL").drop("dead").unionByName(own)
            winners = store.work("winners", segment, resolve.winners_of(stay))
            # Stored, so that its size is known: where few names changed no edge is shuffled to find those that lead to them.
            changed = store.work("changed", segment, resolve.changed_names(resolve.winners_of(around.drop("dead")), winners))
            concerned = store.work("moved", segment, resolve.edges_to_resolve(store.live("call_graph", old), changed).join(
                dead.withColumnRenamed("file_id", "caller_file_id"), ["caller_file_id", "segment"], "left_anti"))
            moved = _per_segment(concerned.withColumnRenamed("segment", "of"))
            if moved:
                store.save("dead_edges", segment, concerned.select("call_id", F.col("segment").alias("of")))
                # Their files do not define the name, so that they have no rank of their own.
                edges = calls.unionByName(concerned.select(
                    F.col("caller_file_id").alias("file_id"), extraction.order_text("call_id").alias("call_order"), "callee_name", "call_type",
                    "line_number", "column_number", extraction.order_text("caller_symbol_id").alias("caller_order")), allowMissingColumns=True)
        count = new + sum(moved.values())
        store.save("call_graph", segment, resolve.resolve_in_place(edges, winners), count, resolve.edge_columns())
        return moved, count

    # -- upkeep -------------------------------------------------------------------

    def compact(self) -> None:
        """Merge segments as long as a size class is full or a segment is mostly dead; a new version each time."""
        store = self.store
        while True:
            old = self.version()
            manifest = store.manifest(old)
            chosen = store.mergeable(manifest["segments"])
            if not chosen:
                return
            segment = store.new_segment()

            def live(name: str) -> DataFrame:
                return store.live(name, old, only=chosen).drop("segment")  # noqa: B023

            parts = self.parts(old)
            totals = _totals(store.save("sizes", segment, live("sizes")))
            size = int(live("files").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
            files = store.save("files", segment, _in_ranges(live("files"), size))
            if "grams" in parts:
                store.save_grams(segment, files, size)
            if "comments" in parts:
                store.save("comments", segment, live("comments"))
            rows = {name: sum(s["rows"][name] for s in manifest["segments"] if s["id"] in chosen) for name in KEYS}
            for name, count in rows.items():
                if name in parts:
                    store.save(name, segment, live(name), count)
            store.save_postings(segment, *(
                live(name) if name in parts else None for name in ("postings", "symbol_postings")), ordered=False)
            entries = [s for s in manifest["segments"] if s["id"] not in chosen]
            kills = []
            for name in ("dead_files", "dead_edges"):  # of segments that stay
                dead = store.read(name, store.with_kills(manifest, name, chosen)).filter(~F.col("of").isin(chosen)).drop("segment")
                if not dead.isEmpty():
                    store.save(name, segment, dead)
                    kills.append(name)
            store.commit(old, {**manifest, "segments": [*entries, store.entry(segment, totals, size, rows, kills)]})


def _per_segment(dead: DataFrame) -> dict[str, int]:
    return {r.of: r.n for r in dead.groupBy("of").agg(F.count(F.lit(1)).alias("n")).collect()}


def _kinds_of(parts: set[str]) -> tuple[str, ...] | None:
    """The kinds of matches that some parts are made from; None stands for all."""
    if parts == PARTS:
        return None
    kinds: dict[str, None] = {}
    for needed, some in (
            ({*SYMBOLS, *CALLS, "definitions", DETAILS}, extraction.SYMBOL_RULES), (SYMBOLS, extraction.PROPERTY_RULES),
            (CALLS, extraction.CALL_RULES), ({"comments"}, ("comment",)), ({DETAILS}, extraction.IMPORT_RULES)):
        if parts & needed:
            kinds.update(dict.fromkeys(some))
    return tuple(kinds)


def _sizes_of(files: DataFrame, symbols: DataFrame | None) -> DataFrame:
    if symbols is None:
        return files.select("file_id", "index_tokens", F.lit(0).cast("long").alias("symbols"), F.lit(0).cast("long").alias("symbol_tokens"))
    length = postings.document_length(SYMBOL_COLUMNS)
    per_file = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"), F.sum(length).alias("symbol_tokens"))
    return files.select("file_id", "index_tokens").join(per_file, "file_id", "left").fillna(0)


def _in_ranges(files: DataFrame, total: int) -> DataFrame:
    """In ranges of ids, sorted, so that fetching a few files by id skips nearly all of the table.

    Ids are hexadecimal digests, so that ranges of equal width are of one size and no sample is read first.
    """
    tasks = max(1, -(-total // BYTES_PER_FILE))
    place = F.floor(F.conv(F.substring("file_id", 1, 6), 16, 10).cast("long") * tasks / 16 ** 6).cast("int")
    return files.repartitionById(tasks, place).sortWithinPartitions("file_id")


def _totals(sizes: DataFrame) -> dict[str, list[int]]:
    """Numbers and tokens of the files and symbols of a table of sizes."""
    names = ("index_tokens", "symbols", "symbol_tokens")
    row = sizes.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    return {"files": [row.files, row.index_tokens], "symbols": [row.symbols, row.symbol_tokens]}
