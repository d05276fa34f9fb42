"""Query results kept for a few minutes, as small tables next to the index."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodebook import schema

DEFAULT_MINUTES = 15
GRAPH_MINUTES = 5
IMPACT_MINUTES = 10


def live(entries: DataFrame, now) -> DataFrame:
    """Entries that have not run out (one that runs out right now is gone)."""
    return entries.filter(F.col("expires_at") > now)


class ResultCache:
    """Rows of a result as JSON, one folder per key. Keys carry the index version, so a
    result never outlives the index it came from."""

    def __init__(self, spark: SparkSession, folder: str, version: str | None):
        self.spark, self.folder, self.version = spark, folder, version

    def _path(self, key: str) -> str:
        digest = hashlib.sha256(f"{self.version}\0{key}".encode()).hexdigest()
        return f"{self.folder}/cache/{digest}"

    def get(self, key: str) -> DataFrame | None:
        """JSON rows of a live entry; None when there is none."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(key))
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return None
        rows = live(self.spark.read.schema(schema.CACHE).parquet(self._path(key)), F.current_timestamp())
        return None if rows.isEmpty() else rows.filter("result IS NOT NULL").select("result")

    def put(self, key: str, result: DataFrame, minutes: int = DEFAULT_MINUTES) -> None:
        now = F.current_timestamp()

        def entry(rows: DataFrame, value) -> DataFrame:
            return rows.select(
                F.lit(key).alias("query_key"), value.cast("string").alias("result"), now.alias("created_at"),
                (now + F.make_interval(mins=F.lit(minutes))).alias("expires_at"))

        # The row without a result marks an empty answer as known.
        marker = entry(self.spark.range(1), F.lit(None))
        rows = entry(result, F.to_json(F.struct(*result.columns)))
        rows.unionByName(marker).write.mode("overwrite").parquet(self._path(key))

    def purge(self) -> int:
        """Delete the folders of entries that have run out; how many there were."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/cache")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root) or not fs.listStatus(root):
            return 0
        entries = self.spark.read.schema(schema.CACHE).parquet(f"{self.folder}/cache/*")
        name = F.element_at(F.split(F.input_file_name(), "/"), -2)
        ends = entries.select(name.alias("name"), "expires_at").groupBy("name").agg(F.max("expires_at").alias("expires_at"))
        gone = [r.name for r in ends.filter(F.col("expires_at") <= F.current_timestamp()).collect()]
        for folder in gone:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/cache/{folder}"), True)
        return len(gone)

    def through(self, key: str, result: DataFrame, minutes: int) -> DataFrame:
        """The cached rows, or the result after storing it."""
        stored = self.get(key)
        if stored is None:
            self.purge()
            self.put(key, result, minutes)
            stored = self.get(key)
        return stored.select(F.from_json("result", result.schema).alias("r")).select("r.*")
