"""Files that the imports of a file point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodebook.functions import text
from lodebook.session import materialize


def imported_files(files: DataFrame, imports: list[str], per_import: int = 5, key: str = "file_id") -> DataFrame:
    """For each import, the first files whose path holds it (ASCII case-blind).

    The imports of one file are few and known on the driver, so all are tested in one scan
    of the paths; there is no join. The top rows per import are cut before the shuffle.
    """
    if not imports:
        return files.select(F.lit(0).alias("import_no"), F.lit("").alias("import"), key, "relative_path").limit(0)
    tests = F.array_compact(F.array(*[
        F.when(text.like_ci(F.col("relative_path"), name), F.struct(F.lit(i).alias("import_no"), F.lit(name).alias("import")))
        for i, name in enumerate(imports)
    ]))
    hits = files.select(key, "relative_path", F.explode(tests).alias("hit")).select("hit.*", key, "relative_path")
    rank = F.row_number().over(Window.partitionBy("import_no").orderBy(key))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= per_import).orderBy("import_no", "rank")


PIECE = 3


def _lowered(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pieces(column: Column, length: int) -> Column:
    """The distinct substrings of a length; none of a shorter text."""
    starts = F.when(F.length(column) >= length, F.sequence(F.lit(1), F.length(column) - (length - 1)))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substr(column, i, F.lit(length))))


def import_targets(imports: DataFrame, files: DataFrame, per_import: int = 5) -> DataFrame:
    """The same for the imports of all files: `imports` has a distinct `import` column.

    Every import is looked up by one piece of three letters that a path with it must hold, the one that fewest paths have (or
    by its longest literal part, if that is shorter; an import of wildcards only is compared with all paths). LIKE
    decides, and tasks keep the first files of each import before they are shuffled.
    """
    wanted = imports.select("import", _lowered(F.col("import")).alias("needle")).filter(F.length("needle") > 0)
    parts = F.filter(F.split("needle", "[%_]"), lambda p: F.length(p) > 0)
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("part")))), 1)["part"]
    wanted = materialize(wanted.withColumn("part", F.coalesce(F.when(F.size(parts) > 0, longest), F.lit(""))), "imports")
    paths = files.select("file_id", "relative_path", _lowered(F.col("relative_path")).alias("lowered"))
    sizes = sorted({min(PIECE, r["n"]) for r in wanted.select(F.length("part").alias("n")).distinct().collect()})
    size = F.least(F.length("part"), F.lit(PIECE))
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.length("part") - size + 1, F.lit(1))), lambda i: F.substr(F.col("part"), i, size))
    asked = wanted.select("import", "needle", F.explode(F.array_distinct(keys)).alias("piece"))
    found = paths.select("file_id", "relative_path", "lowered", F.explode(F.concat(*[
        _pieces(F.col("lowered"), n) if n else F.array(F.lit("")) for n in sizes or [PIECE]])).alias("piece"))
    held = found.join(asked.select("piece").distinct(), "piece", "left_semi")
    counts = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # Stored, so that its size is known: where imports are few the paths stay in the tasks that read them.
    rarest = materialize(asked.join(counts, "piece", "left").groupBy("import", "needle").agg(
        F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece")), "rarest")
    pattern = F.concat(F.lit("%"), F.replace("needle", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    hits = found.join(rarest, "piece").filter(F.like(F.col("lowered"), pattern))
    rank = F.row_number().over(Window.partitionBy("import").orderBy("file_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= per_import).select("import", "file_id", "relative_path", "rank")
