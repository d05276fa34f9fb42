"""Log-structured tables below one folder: immutable segments, sets of dead rows, and manifests.

A change writes one segment with its new rows and the keys of the rows it replaces in older segments; nothing else is
written. A manifest lists the segments of a version and is put in place last, under the next number, so that readers see
either the old version or the new one, and the second of two writers that began from one version fails.

    <table>/segment=<id>/...    rows of one segment
    manifests/<version>.json    segments of a version with their sizes, and the totals of the corpus
    work/<id>/                  intermediate tables of a running change
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodebook import schema
from lodebook.operators import grams, postings

# The file that a row of a table belongs to.
OWNER = {
    "files": "file_id", "symbols": "file_id", "comments": "file_id", "definitions": "file_id", "callers": "file_id", "sizes": "file_id",
    "postings": "file_id", "call_graph": "caller_file_id", "symbol_postings": "substring_index(symbol_id, '#', 1)",
}
# What rows are found by: such tables lie in buckets of this key, sorted by it.
KEYS = {"symbols": "file_id", "definitions": "name", "callers": "caller", "call_graph": "substring_index(callee_name, '.', -1)"}
BUCKET_ROWS = 1000  # buckets grow with the root of the rows: n rows make sqrt(n / 1000) of them
CODEC = "zstd"  # ids are hexadecimal digests, which only a codec with entropy coding makes smaller
FANOUT = 8  # segments of one size class that are merged into one
MOST_RANGES = 200  # blocks that a scan gets as literal ranges; more are joined
LEAST_TOKENS = 1_000_000  # smaller segments are one size class


def bucket_of(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, math.isqrt(count // BUCKET_ROWS)))).cast("int")


class ConcurrentChange(RuntimeError):
    """Another writer has put its version in place first."""


class SegmentStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._manifests: dict[str, dict] = {}

    # -- files and manifests --------------------------------------------------------

    def path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def fs(self):
        return self.path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        fs, path = self.fs(), self.path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def delete(self, name: str) -> None:
        self.fs().delete(self.path(name), True)

    def versions(self) -> list[str]:
        """Complete versions, oldest first."""
        return [n.removesuffix(".json") for n in self.names("manifests") if n.startswith("v") and n.endswith(".json")]

    def version(self) -> str | None:
        return (self.versions() or [None])[-1]

    def manifest(self, version: str | None) -> dict:
        if version is None:
            return {"segments": [], "corpus": {"files": [0, 0], "symbols": [0, 0]}}
        if version not in self._manifests:
            stream = self.fs().open(self.path(f"manifests/{version}.json"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._manifests[version] = json.loads(text)
        return self._manifests[version]

    def commit(self, parent: str | None, manifest: dict) -> str:
        """Put a version in place whose number follows its parent's; fails if that number exists."""
        version = f"v{int(parent[1:]) + 1 if parent else 1:010d}"
        draft = self.path(f"manifests/draft-{uuid.uuid4().hex}")
        fs = self.fs()
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        none = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        files = hadoop.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(self.path(f"manifests/{version}.json")), none)
        except Exception as problem:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(problem):
                raise ConcurrentChange(f"{version} was written by another writer") from None
            raise
        return version

    @staticmethod
    def with_kills(manifest: dict, name: str, only: list[str] | None = None) -> list[str]:
        """Segments that bring a set of dead rows."""
        return [s["id"] for s in manifest["segments"] if name in s["kills"] and (only is None or s["id"] in only)]

    def forget(self, segment: str) -> None:
        """Delete what a change that came to nothing has written."""
        for name in (*schema.TABLES, "work"):
            self.delete(f"{name}/{segment}" if name == "work" else f"{name}/segment={segment}")

    @staticmethod
    def new_segment() -> str:
        return f"s{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"

    # -- rows -------------------------------------------------------------------------

    @staticmethod
    @cache
    def columns(name: str) -> list[str]:
        return StructType.fromDDL(schema.TABLES[name]).names

    def save(self, name: str, segment: str, rows: DataFrame, count: int = 0, late: dict[str, Column] | None = None) -> DataFrame:
        """Write the rows of a segment's table, and read them back. `count` rows decide the buckets of a table with a key.

        Adaptive execution splits a bucket that a very common key has filled over several tasks and files. `late` columns
        are made from others where the rows are written, so that they are not shuffled.
        """
        path, columns = f"{self.folder}/{name}/segment={segment}", self.columns(name)
        if name in KEYS:
            rows = rows if late else rows.select(*columns)
            placed = rows.withColumn("bucket", bucket_of(F.expr(KEYS[name]), count)).withColumn("key", F.expr(KEYS[name]))
            ordered = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key")
            ordered.withColumns(late or {}).select(*columns, "bucket").write.option("compression", CODEC).partitionBy("bucket").parquet(path)
        else:
            rows.withColumns(late or {}).select(*columns).write.option("compression", CODEC).parquet(path)
        return self.read(name, [segment]).select(*self.columns(name))

    def work(self, name: str, segment: str, rows: DataFrame) -> DataFrame:
        """Write an intermediate table of a change, and read it back."""
        path = f"{self.folder}/work/{segment}/{name}"
        rows.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read(self, name: str, segments: list[str]) -> DataFrame:
        """Rows of some segments, dead ones too, with the column `segment`."""
        columns = f"{schema.TABLES[name]}, segment string" + (", bucket int" if name in KEYS else "")
        if not segments:
            return self.spark.createDataFrame([], columns)
        paths = [f"{self.folder}/{name}/segment={s}" for s in segments]
        return self.spark.read.schema(columns).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def live(self, name: str, version: str | None, only: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """Rows of a version (of `only` some segments), with the column `segment`.

        Segments without dead rows are read as they are; the others lose theirs by a join with the narrow sets of dead
        keys. `where` is applied to the scan.
        """
        segments = self.manifest(version)["segments"]
        chosen = [s for s in segments if only is None or s["id"] in only]
        edges = name == "call_graph"
        dirty = [s["id"] for s in chosen if s["dead_files"] or (edges and s["dead_edges"])]
        clean = [s["id"] for s in chosen if s["id"] not in dirty]

        columns = [*self.columns(name), "segment"]

        def scan(ids: list[str]) -> DataFrame:
            rows = self.read(name, ids)
            return (rows if where is None else rows.where(where)).select(*columns)

        if not dirty:
            return scan(clean)
        rows = scan(dirty).withColumn("owner", F.expr(OWNER[name]))
        dead = self.read("dead_files", self.with_kills(self.manifest(version), "dead_files")).select(F.col("file_id").alias("owner"), F.col("of").alias("segment"))
        if edges:
            # Looked up by file together with the dead files, so that edges are shuffled once and by their file.
            replaced = self.read("dead_edges", self.with_kills(self.manifest(version), "dead_edges")).select(
                F.substring_index("call_id", "#", 1).alias("dead_owner"), F.col("of").alias("dead_segment"), F.col("call_id").alias("dead_call"))
            gone = dead.select(F.col("owner").alias("dead_owner"), F.col("segment").alias("dead_segment"), F.lit(None).cast("string").alias("dead_call")).unionByName(replaced)
            rows = rows.join(gone, (F.col("owner") == F.col("dead_owner")) & (F.col("segment") == F.col("dead_segment"))
                             & (F.col("dead_call").isNull() | (F.col("dead_call") == F.col("call_id"))), "left_anti")
        else:
            rows = rows.join(dead, ["owner", "segment"], "left_anti")
        return scan(clean).unionByName(rows.select(*columns)) if clean else rows.select(*columns)

    def lookup(self, name: str, version: str | None, keys: list[str]) -> DataFrame:
        """Live rows with one of a few keys: of every segment only the buckets of these keys are opened."""
        places = []
        for s in self.manifest(version)["segments"]:
            own = F.col("bucket").isin([bucket_of(F.lit(k), s["rows"][name]) for k in keys])
            places.append((F.col("segment") == s["id"]) & own)
        if not places or not keys:
            return self.live(name, version, where=F.lit(False)).drop("segment")
        place = reduce(lambda a, b: a | b, places)
        return self.live(name, version, where=place & F.expr(KEYS[name]).isin(keys)).drop("segment")

    def postings(self, name: str, version: str | None, words: list[str]) -> DataFrame:
        """The live postings of a few words: of every segment only the stretches of these words are read."""
        return self.live(name, version, where=F.col("term").isin(words)).drop("segment")

    def save_postings(self, segment: str, files: DataFrame | None, symbols: DataFrame | None, ordered: bool = True) -> None:
        """Write a segment's postings, of files and of symbols if there are any; `ordered` as in `postings.write`."""
        for name, rows in (("postings", files), ("symbol_postings", symbols)):
            if rows is not None:
                postings.write(rows, f"{self.folder}/{name}/segment={segment}", ordered)

    def save_grams(self, segment: str, files: DataFrame, size: int) -> None:
        """Write which blocks of a segment's files hold which sequences of bytes."""
        grams.write(grams.build(files, grams.digits_of(size)), f"{self.folder}/grams/segment={segment}", size)

    def files_with(self, version: str | None, term: str, wildcards: bool = False) -> DataFrame:
        """Live files whose text may hold a term: those of the blocks that have all its sequences of three bytes.

        Sequences of replaced files count until their segment is merged. Of a term with less than three bytes all files.
        """
        wanted = grams.grams_of(term, wildcards)
        if not wanted:
            return self.live("files", version).drop("segment")
        segments = {s["id"]: s for s in self.manifest(version)["segments"]}

        def union(parts: list[DataFrame]) -> DataFrame:
            return reduce(DataFrame.unionByName, parts)

        if not segments:
            return self.live("files", version).drop("segment")
        hits = union([self.read("grams", [i]).where(grams.bucket_filter(wanted, s["bytes"])) for i, s in segments.items()])
        blocks = hits.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).drop("n")
        few = blocks.limit(MOST_RANGES + 1).collect()
        if len(few) <= MOST_RANGES:
            own: dict[str, list[str]] = {}
            for r in few:
                own.setdefault(r.segment, []).append(r.block)
            if not own:
                return self.live("files", version, where=F.lit(False)).drop("segment")
            return union([self.live("files", version, only=[i], where=grams.in_blocks(b)) for i, b in own.items()]).drop("segment")
        return union([
            self.live("files", version, only=[i]).withColumn("block", grams.block_of(F.col("file_id"), grams.digits_of(s["bytes"])))
            for i, s in segments.items()]).join(blocks, ["segment", "block"], "left_semi").drop("segment", "block")

    @staticmethod
    def entry(segment: str, totals: dict[str, list[int]], size: int, rows: dict[str, int], kills: list[str]) -> dict:
        """A segment in a manifest; kills: which sets of dead rows it brings, dead_files and dead_edges: its own dead rows."""
        return {"id": segment, "kills": kills, "files": totals["files"][0], "bytes": size, "rows": rows,
                "tokens": {k: v[1] for k, v in totals.items()}, "dead_files": 0, "dead_edges": 0}

    # -- upkeep -------------------------------------------------------------------------

    def mergeable(self, segments: list[dict]) -> list[str]:
        """Segments to merge: those of a size class that is full, smaller ones with them, and ones with mostly dead rows."""
        def tier(s: dict) -> int:
            return int(math.log(max(1, s["tokens"]["files"] / LEAST_TOKENS), FANOUT))

        full = [t for t in {tier(s) for s in segments} if sum(tier(s) == t for s in segments) >= FANOUT]
        chosen = [s["id"] for s in segments if full and tier(s) <= max(full)]
        return chosen or [s["id"] for s in segments if 2 * s["dead_files"] > s["files"] > 0]

    def vacuum(self, keep: int = 1, grace_hours: float = 24) -> None:
        """Delete all but the newest versions, and segments that no version has.

        Segments younger than the grace time stay, since a running build may be about to use them; leftovers of failed
        builds go once they are older.
        """
        if keep < 1:
            raise ValueError("at least one version must stay; use clear() to delete all")
        versions = self.versions()
        for version in versions[:-keep]:
            self.delete(f"manifests/{version}.json")
        used = {s["id"] for v in versions[-keep:] for s in self.manifest(v)["segments"]}
        oldest = time.time() * 1000 - grace_hours * 3_600_000

        def unused(segment: str) -> bool:
            return segment not in used and int(segment[1:].split("-")[0]) <= oldest

        for name in schema.TABLES:
            for folder in self.names(name):
                if folder.startswith("segment=") and unused(folder.removeprefix("segment=")):
                    self.delete(f"{name}/{folder}")
        for segment in self.names("work"):
            if unused(segment):
                self.delete(f"work/{segment}")
        for name in self.names("manifests"):
            if name.startswith("draft-") and self.fs().getFileStatus(self.path(f"manifests/{name}")).getModificationTime() <= oldest:
                self.delete(f"manifests/{name}")

    def clear(self) -> None:
        """Delete all versions and the cache; manifests first, so that no reader meets half a version."""
        for name in ("manifests", *schema.TABLES, "work", "cache"):
            self.delete(name)
        self._manifests.clear()
