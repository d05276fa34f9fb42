"""History over orders as commits and parts as files; snapshots, cache entries and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook import cache
from lodebook.functions import text
from lodebook.functions.jsonpatch import merge_patch
from lodebook.operators import history
from lodebook.plans import index
from lodebook.session import ship_package
from lodebook.sources.tables import document_files, order_changes, order_commits, read_table


def _newest(spark, sf):
    """The clock of the history: the date of the newest commit, as a scalar subquery."""
    return read_table(spark, sf, "orders").agg(F.max("o_orderdate").alias("now")).scalar()


# A commit is newer the later its date, then the greater its key; both fit one number.
ORDINAL = "CAST(unix_date(CAST(date AS DATE)) AS BIGINT) * 10000000000 + hash"


def _changes(spark, sf) -> DataFrame:
    return order_changes(spark, sf).withColumn("ordinal", -F.expr(ORDINAL))


def busiest_part(spark, sf) -> int:
    row = read_table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "l_partkey").first()
    return row.l_partkey


def co_change(spark, sf):
    return history.co_changed(_changes(spark, sf), busiest_part(spark, sf))


def recent_commits(spark, sf):
    return history.recent_commits(_changes(spark, sf), busiest_part(spark, sf)).select(
        "hash", "author", F.col("date").cast("date").alias("date"))


def change_frequency(spark, sf):
    return history.change_frequency(order_commits(spark, sf), _newest(spark, sf))


def recent_changes(spark, sf):
    found = history.recent_changes(_changes(spark, sf), _newest(spark, sf), 30)
    return found.select("path", "commits", "hash", "author")


def authors(spark, sf):
    return history.authors(order_commits(spark, sf))


LINES_PER_TASK = 500_000


def first_last_seen(spark, sf):
    """Per file: commits, authors, first and last change, in one aggregation.

    Lines and orders are made distinct where they meet, in as many tasks as the lines ask for, so that the memory of a task
    does not grow with the tables.
    """
    lines = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_PER_TASK))
    commits = lines.repartition(tasks, "hash").distinct().join(order_commits(spark, sf).repartition(tasks, "hash").distinct(), "hash")
    per_author = commits.groupBy("path", "author").agg(
        F.count(F.lit(1)).alias("commits"), F.min("date").alias("first"), F.max("date").alias("last"))
    return per_author.repartition(tasks, "path").groupBy("path").agg(
        F.sum("commits").alias("total_commits"), F.count("author").alias("unique_authors"),
        F.min("first").cast("date").alias("first_seen"), F.max("last").cast("date").alias("last_modified"))


def history_summary(spark, sf):
    commits = order_commits(spark, sf).withColumn("ordinal", -F.expr(ORDINAL))
    return history.summary(commits).select(
        "total_commits", "unique_authors", F.col("last_modified").cast("date").alias("last_modified"),
        F.col("first_seen").cast("date").alias("first_seen"))


def blame_lines(spark, sf):
    """Line numbers from the first line of a range on: here all lines of a document, from 10."""
    return document_files(spark, sf).select(
        "file_id", F.posexplode(text.lines(F.col("content"))).alias("i", "content")).select(
        "file_id", (F.col("i") + 10).cast("long").alias("line"), "content")


def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(scanned, known): the documents now, and an index of an earlier state of them.

    Earlier, runs of blanks were kept as they are; toxic documents have been deleted since,
    and the conversations are new.
    """
    documents = document_files(spark, sf).select(F.col("file_id").alias("doc_id"), F.col("relative_path").alias("path"), "content")
    toxic = read_table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    now = documents.join(toxic, "doc_id", "left_anti").select(
        "path", F.sha2(text.collapse_spaces(F.col("content")), 256).alias("hash"))
    talk = read_table(spark, sf, "conversations").select(
        F.concat_ws("/", F.lit("talk"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"),
        F.sha2("text", 256).alias("hash"))
    return now.unionByName(talk), documents.select("path", F.sha2("content", 256).alias("hash"))


def incremental_diff(spark, sf):
    return index.compare(*snapshots(spark, sf))


def forced_diff(spark, sf):
    states = index.compare(*snapshots(spark, sf), force=True)
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("files"))


def deleted_files(spark, sf):
    return index.compare(*snapshots(spark, sf)).filter(F.col("state") == "deleted").select("path")


def metadata_merge(spark, sf):
    """Metadata of documents patched with their labels; language is removed, quality replaced."""
    base = read_table(spark, sf, "documents").select(
        "doc_id", F.create_map(F.lit("source"), F.col("source"), F.lit("language"), F.col("lang"), F.lit("quality"), F.lit("?")).alias("metadata"))
    patch = read_table(spark, sf, "labels").dropDuplicates(["doc_id"]).select(
        "doc_id", F.create_map(
            F.lit("language"), F.lit(None).cast("string"), F.lit("quality"), F.col("quality").cast("string"),
            F.lit("toxic"), F.col("toxic").cast("string")).alias("patch"))
    merged = index.merge_metadata(base, patch, "doc_id")
    entries = F.array_sort(F.map_entries("metadata"))
    return merged.select("doc_id", F.array_join(
        F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


def metadata_nested(spark, sf):
    """Nested metadata of documents patched with their labels: members of the inner object are kept, replaced and removed."""
    ship_package(spark)
    base = read_table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(
        F.struct(F.col("source").alias("name"), F.col("lang").alias("language")).alias("origin"),
        F.array("lang").alias("tags"), F.lit("?").alias("quality"))).alias("metadata"))
    patch = read_table(spark, sf, "labels").dropDuplicates(["doc_id"]).select("doc_id", F.concat(
        F.lit('{"origin":{"language":null,"checked":{"toxic":'), F.col("toxic").cast("string"), F.lit('}},"tags":["'),
        F.col("quality").cast("string"), F.lit('"],"quality":null}')).alias("patch"))
    return base.join(patch, "doc_id", "left").select("doc_id", merge_patch(F.col("metadata"), F.col("patch")).alias("metadata"))


def cache_entries(spark, sf):
    """Events as cache entries of so many minutes as their value; the clock is the last event."""
    now = read_table(spark, sf, "events").agg(F.max("ts").alias("now")).scalar()
    entries = read_table(spark, sf, "events").withColumn(
        "expires_at", F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value") * 60).cast("int")))
    return cache.live(entries, now).select("event_id", "event_type")


def time_ago_text(spark, sf):
    """How long before the last event each event was, in words (days only below 30)."""
    events = read_table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now")).scalar()
    return events.select("event_id", text.time_ago(F.col("ts").cast("timestamp"), now.cast("timestamp")).alias("ago"))


CHANGES = """
changes AS (SELECT l_orderkey AS hash, l_partkey AS path, o_custkey AS author, o_orderdate AS date
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
newest AS (SELECT max(o_orderdate) AS now FROM orders),
busiest AS (SELECT l_partkey AS k FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
# Blanks as Java's \s and trim() see them.
COLLAPSED = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
STATES = f"""
now AS (SELECT source || '/' || doc_id AS path, sha256({COLLAPSED}) AS h FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
        UNION ALL SELECT 'talk/' || conv_id || '/' || turn, sha256(text) FROM conversations),
old AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents),
states AS (SELECT coalesce(n.path, o.path) AS path,
             CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN n.h <> o.h THEN 'changed' ELSE 'unchanged' END AS state
           FROM now n FULL JOIN old o ON n.path = o.path)"""

QUERIES = {
    "co_change_top10": (co_change, f"""
WITH {CHANGES}, own AS (SELECT DISTINCT hash FROM (SELECT c.hash FROM changes c, busiest WHERE path = k ORDER BY date DESC, hash DESC LIMIT 50))
SELECT path, count(*) AS co_change_count
FROM (SELECT DISTINCT c.hash, c.path FROM changes c JOIN own USING (hash), busiest WHERE path <> k)
GROUP BY path ORDER BY 2 DESC, 1 LIMIT 10"""),
    "recent_commits": (recent_commits, f"""
WITH {CHANGES} SELECT hash, author, CAST(date AS DATE) AS date FROM changes, busiest WHERE path = k
ORDER BY changes.date DESC, hash DESC LIMIT 20"""),
    "change_frequency": (change_frequency, f"""
WITH {CHANGES}
SELECT count(*) FILTER (o_orderdate > now - INTERVAL 7 DAY) AS last_7_days,
       count(*) FILTER (o_orderdate > now - INTERVAL 30 DAY) AS last_30_days,
       count(*) FILTER (o_orderdate > now - INTERVAL 90 DAY) AS last_90_days FROM orders, newest"""),
    "recent_changes": (recent_changes, f"""
WITH {CHANGES}
SELECT path, count(*) OVER (PARTITION BY path) AS commits, hash, author
FROM changes, newest WHERE date > now - INTERVAL 30 DAY"""),
    "unique_authors": (authors, "SELECT o_custkey AS author, count(*) AS commits FROM orders GROUP BY 1"),
    "first_last_seen": (first_last_seen, f"""
WITH {CHANGES}
SELECT path, count(*) AS total_commits, count(DISTINCT author) AS unique_authors,
       CAST(min(date) AS DATE) AS first_seen, CAST(max(date) AS DATE) AS last_modified
FROM (SELECT DISTINCT * FROM changes) GROUP BY path"""),
    "history_summary": (history_summary, """
SELECT count(*) AS total_commits, count(DISTINCT o_custkey) AS unique_authors,
       CAST(max(o_orderdate) AS DATE) AS last_modified, CAST(min(o_orderdate) AS DATE) AS first_seen FROM orders"""),
    "blame_line_numbers": (blame_lines, """
SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS content,
       9 + generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"""),
    "incremental_diff": (incremental_diff, f"WITH {STATES} SELECT * FROM states"),
    "incremental_diff_forced": (forced_diff, f"""
WITH {STATES}
SELECT CASE WHEN state = 'unchanged' THEN 'changed' ELSE state END AS state, count(*) AS files FROM states GROUP BY 1"""),
    "deleted_files": (deleted_files, f"WITH {STATES} SELECT path FROM states WHERE state = 'deleted'"),
    "metadata_merge_patch": (metadata_merge, """
WITH l AS (SELECT DISTINCT ON (doc_id) * FROM labels)
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'language=' || lang || ';quality=?;source=' || source
                 ELSE 'quality=' || quality || ';source=' || source || ';toxic=' || toxic END AS metadata
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id"""),
    "metadata_nested_patch": (metadata_nested, """
WITH l AS (SELECT DISTINCT ON (doc_id) * FROM labels),
d AS (SELECT doc_id, to_json({'origin': {'name': source, 'language': lang}, 'tags': [lang], 'quality': '?'}) AS metadata FROM documents),
p AS (SELECT doc_id, ('{"origin":{"language":null,"checked":{"toxic":' || toxic || '}},"tags":["' || quality || '"],"quality":null}')::JSON AS patch FROM l)
SELECT d.doc_id, CAST(CASE WHEN p.doc_id IS NULL THEN metadata ELSE json_merge_patch(metadata, patch) END AS VARCHAR) AS metadata
FROM d LEFT JOIN p ON p.doc_id = d.doc_id"""),
    "cache_live_entries": (cache_entries, """
SELECT event_id, event_type FROM events
WHERE ts + CAST(floor(value * 60) AS INTEGER) * INTERVAL 1 MINUTE > (SELECT max(ts) FROM events)"""),
    "time_ago_text": (time_ago_text, """
WITH e AS (SELECT event_id, epoch(date_trunc('second', m)) - epoch(date_trunc('second', ts)) AS s
           FROM events, (SELECT max(ts) AS m FROM events)),
p AS (SELECT event_id, CAST(floor(s / 60) AS BIGINT) AS mi, CAST(floor(s / 3600) AS BIGINT) AS h, CAST(floor(s / 86400) AS BIGINT) AS d FROM e)
SELECT event_id, CASE WHEN mi < 1 THEN 'just now'
  WHEN mi < 60 THEN mi || ' minute' || CASE WHEN mi > 1 THEN 's' ELSE '' END || ' ago'
  WHEN h < 24 THEN h || ' hour' || CASE WHEN h > 1 THEN 's' ELSE '' END || ' ago'
  ELSE d || ' day' || CASE WHEN d > 1 THEN 's' ELSE '' END || ' ago' END AS ago FROM p"""),
}
