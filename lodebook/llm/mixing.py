"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets an exponential key, -ln(u) / quality, where u follows from the document's id,
so reruns agree and better documents tend to come first. A source's target is met by complete
epochs over the source, then by the documents of smallest key up to what is left; the document
that crosses the budget is taken in part.

The prefix sums are built in two levels: buckets of the key, whose sums are added up per source, and
rows within a bucket. A source with a third of all rows is therefore spread over many buckets;
only one row per bucket meets in a task.

Null text has size 0 and takes nothing. A null source is a source of its own, the last one. Rows without
a quality weight count 1; weights are kept within `QUALITY_RANGE`. Repeated rows have equal keys and
follow each other. Columns besides the named ones are dropped by `mix_sources`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodebook.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1000
QUALITY_RANGE = (0.25, 4.0)
EXACT = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that follows from the id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"#{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], repeats: int) -> DataFrame:
    """One row per source: its size, number of rows and target.

    Sources in order of code points, null last, weigh `weights`, repeating. Together they get share[0] / share[1]
    of all sizes, none more than `repeats` times its own; the excess goes to the others by weight.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    limit, weight = F.col("source_limit"), F.col("weight")
    by_room = (Window.orderBy(limit / weight, F.col("source").asc_nulls_last())
               .rowsBetween(Window.unboundedPreceding, -1))
    ranked = own.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1))
        .cast(EXACT)).withColumn("source_limit", (F.col("source_size") * repeats).cast(EXACT))
    ranked = (ranked.withColumn("total", (F.sum("source_size").over(everything) * share[0]).cast(EXACT))
              .withColumn("all_weights", F.sum("weight").over(everything).cast(EXACT))
              .withColumn("limits_before", F.coalesce(F.sum(limit).over(by_room), F.lit(0)).cast(EXACT))
              .withColumn("weights_before", F.coalesce(F.sum(weight).over(by_room), F.lit(0)).cast(EXACT)))
    left = F.col("total") - F.col("limits_before") * share[1]
    ranked = ranked.withColumn(
        "full", limit * share[1] * (F.col("all_weights") - F.col("weights_before")) < left * weight)
    ranked = (ranked
              .withColumn("full_limits", F.coalesce(F.sum(F.when(F.col("full"), limit)).over(everything), F.lit(0)).cast(EXACT))
              .withColumn("open_weights", F.sum(F.when(~F.col("full"), weight)).over(everything).cast(EXACT)))
    target = F.when(F.col("full"), limit.cast("double")).otherwise(
        (weight * (F.col("total") - F.col("full_limits") * share[1])).cast("double")
        / (F.col("open_weights") * share[1]).cast("double"))
    return ranked.select("source", "source_size", "source_rows", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2),
                repeats: int = 2, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs and taken for every row of docs.

    docs has doc_id, source, size (whole number) and quality (the weight of a document's key).
    """
    low, high = QUALITY_RANGE
    quality = F.least(F.greatest(F.coalesce(F.col("quality").cast("double"), F.lit(1.0)), F.lit(low)), F.lit(high))
    rows = materialize(docs.select(
        "doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"),
        (-F.log(uniform(F.col("doc_id"), seed)) / quality).alias("key")), "mix-rows")
    sources = source_targets(rows, weights, share, repeats)
    # The distribution of keys at the lowest quality: no quality is denser than high / low in a bucket.
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / bucket_rows))
    bucket = F.least(F.floor((1 - F.exp(-low * F.col("key"))) * buckets), buckets - 1)
    placed = (rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
              .select("r.*", "source_size", "target", bucket.alias("bucket")))
    in_order = (Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
               .select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"),
                       F.coalesce(F.sum("bucket_size").over(in_order), F.lit(0)).alias("offset")))
    by_key = (Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    before = F.col("offset") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("words") - F.col("epochs") * F.col("source_size")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return (joined.withColumn("before", before).withColumn("words", words).withColumn("epochs", epochs)
            .select("doc_id", "source", "size", "source_size", "target", "epochs",
                    (F.col("epochs") * F.col("size") + partly).cast("long").alias("taken")))


def label_quality(labels: DataFrame) -> DataFrame:
    """Weights by label: good documents 2, poor ones 0.5; one row per labelled id."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
            .agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("quality")))


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix of a table with doc_id, source and text, with quality weights from its labels."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(sizes.join(label_quality(labels), "doc_id", "left"))


SQL = r"""
WITH sizes AS (
  SELECT d.doc_id, d.source,
         coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(q.quality, 1.0) AS quality
  FROM documents d LEFT JOIN (
    SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS quality
    FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) q ON q.doc_id = d.doc_id),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#0'), 1, 13))::BIGINT::DOUBLE + 0.5)
                / 4503599627370496.0) / quality AS key FROM sizes),
own AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w,
         (SELECT sum(source_size)::HUGEINT FROM own) AS s FROM own),
ordered AS (
  SELECT *, sum(w) OVER () AS all_w,
         coalesce(sum(2 * source_size) OVER prior, 0) AS c_before, coalesce(sum(w) OVER prior, 0) AS w_before
  FROM weighed
  WINDOW prior AS (ORDER BY 2 * source_size::DOUBLE / w::DOUBLE, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (
  SELECT *, 4 * source_size * (all_w - w_before) < (3 * s - 2 * c_before) * w AS is_full FROM ordered),
targets AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN is_full THEN (2 * source_size)::DOUBLE
              ELSE (w * (3 * s - 2 * coalesce(sum(CASE WHEN is_full THEN 2 * source_size END) OVER (), 0)))::DOUBLE
                   / (2 * sum(CASE WHEN NOT is_full THEN w END) OVER ())::DOUBLE END AS target
  FROM flagged),
joined AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM joined
"""
