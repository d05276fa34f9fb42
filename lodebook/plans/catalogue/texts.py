"""Statistics, scans, full-text search, packing and usages over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodebook.functions import paths, text
from lodebook.operators import impact, packing, postings, search, stats, symbols, usages
from lodebook.plans.catalogue.sqltext import DOCUMENTS, bm25, fold, tokens
from lodebook.session import new_scratch_path
from lodebook.sources import filetree, languages
from lodebook.sources.ignore import ignored
from lodebook.sources.tables import document_files, page_files, part_symbols, read_table

FIELDS = ["t1", "t2", "t3"]
KEEP = "file_id, relative_path, language, size"


def joined(numbers: Column) -> Column:
    """A list of numbers as text."""
    return F.array_join(numbers.cast("array<string>"), ",")


# -- statistics -------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def stats_totals(spark, sf):
    files = document_files(spark, sf).select(
        "size", text.estimate_tokens(F.col("content")).alias("tokens"), F.lit(None).cast("timestamp").alias("indexed_at"))
    counted = stats.totals(files).select("file_count", "total_size", "total_tokens")
    symbol_count = part_symbols(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    last = read_table(spark, sf, "events").agg(F.max("ts").alias("ts")).scalar()
    return counted.select("*", symbol_count.alias("symbol_count"), last.cast("date").alias("last_indexed"))


def language_share(spark, sf):
    return stats.language_share(_documents(spark, sf).select(F.col("lang").alias("language")))


def stats_largest10(spark, sf):
    files = document_files(spark, sf).withColumn("tokens", text.estimate_tokens(F.col("content")))
    return stats.largest_files(files)


# -- scan ---------------------------------------------------------------------------------

# Parts as file names: the type picks the kind of name, case and unknown endings included.
PART_SUFFIX = {"ECONOMY": ".ts", "PROMO": ".PY", "STANDARD": ".config.json", "MEDIUM": ".xyz", "LARGE": ".test.js"}
SUFFIX_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PART_SUFFIX.items()) + " ELSE '' END"
PART_PATHS = f"""
paths AS (
  SELECT p_partkey, lower(p_brand) || '/' || replace(p_name, ' ', '/') || '_' || p_partkey || {SUFFIX_SQL} AS relative_path
  FROM part)"""


def part_paths(spark, sf):
    suffix = F.lit("")
    for kind, ending in PART_SUFFIX.items():
        suffix = F.when(F.col("p_type") == kind, ending).otherwise(suffix)
    return read_table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lower("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("_"),
                 F.col("p_partkey").cast("string"), suffix).alias("relative_path"))


SPECIAL = {"red": "Dockerfile", "hot": "dockerfile.prod", "old": "Makefile", "blue": "Gemfile", "small": "Pipfile"}


def detect_special(spark, sf):
    """The first word of the part name picks a special file name, others keep the path."""
    path = F.col("relative_path")
    word = F.element_at(F.split(path, "/"), 2)
    for key, name in SPECIAL.items():
        path = F.when(word == key, F.concat(F.lit(f"{key}/"), F.col("p_partkey").cast("string"), F.lit(f"/{name}"))).otherwise(path)
    named = part_paths(spark, sf).select("p_partkey", path.alias("path"))
    return named.select("p_partkey", "path", languages.detect_language(F.col("path")).alias("language"))


SPECIAL_SQL = "CASE split_part(relative_path, '/', 2) " + " ".join(
    f"WHEN '{k}' THEN '{k}/' || p_partkey || '/{v}'" for k, v in SPECIAL.items()) + " ELSE relative_path END"

IGNORE_RULES = ["# comment", "old/", "brand#1/hot/**", "widget_*", "!brand#2/**/widget_*", "*.json", "!**/gear_*.config.json"]


def scan_table_rules(spark, sf):
    """Size, ignore and include rules over a columnar corpus."""
    files = document_files(spark, sf).select(
        F.concat(F.col("relative_path"), F.lit("."), F.when(F.col("language") == "en", "md").otherwise("rst")).alias("relative_path"),
        "content", "size").withColumn("path", F.col("relative_path")).withColumn("last_modified", F.lit(None).cast("timestamp"))
    kept = filetree.scan_table(files, include=["markdown"], ignore=["src1/", "src1?/**"], max_file_size=10000)
    return kept.select("relative_path", "size", "language", "hash")


# -- full-text search ------------------------------------------------------------------------


def file_search(term: str, **options):
    def query(spark, sf):
        found = search.search_files(document_files(spark, sf), term, **options)
        return found.withColumn("score", F.round("score", 6))

    return query


def sorted_by_modified(spark, sf):
    """The newest matching documents; the day of change follows from the id."""
    modified = F.timestamp_seconds((F.col("file_id") * 7 % 1000) * 86400)
    found = search.search_files(document_files(spark, sf).withColumn("last_modified", modified), "tion", sort_by="modified")
    return found.select("file_id", "relative_path", F.round("score", 6).alias("score"))


def search_sql(phrases: list[list[str]], match: str, order: str = "score", extra: str = "") -> str:
    return f"""
WITH {DOCUMENTS}, {bm25("tok", FIELDS, KEEP, phrases, match)}
SELECT {KEEP}, round(score, 6) AS score FROM scored {extra} ORDER BY {order}, file_id LIMIT 10"""


def postings_top10(spark, sf):
    """The same search from an inverted index that is built, written in sorted runs and read back first."""
    files = document_files(spark, sf)
    corpus = files.agg(F.count(F.lit(1)).alias("total"), F.sum(postings.document_length()).alias("length")).first()
    path = new_scratch_path(spark, "postings")
    postings.write(postings.build(files), path)
    hits = postings.ranked(spark.read.parquet(path), "the tion OR of_the", corpus.total, corpus.length)
    return hits.orderBy("score", "file_id").limit(10).withColumn("score", F.round("score", 6))


def like_fallback(spark, sf):
    return search.like_files(document_files(spark, sf), "@").drop("score")


def snippet_first_hit(spark, sf):
    files = document_files(spark, sf)
    found = files.filter(search.has_word(F.col("content"), "estion"))
    return found.select("file_id", search.snippet(F.col("content"), ["estion"]).alias("snippet"))


def nation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as the files that the parts stand in."""
    return read_table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("relative_path"), F.col("n_regionkey").cast("string").alias("language"))


def placed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_size").alias("line_start"))
    return part_symbols(spark, sf).join(lines, "symbol_id").select(
        "*", (F.col("symbol_id") % 25).alias("file_id"), (F.col("line_start") + 5).alias("line_end"))


FOUND = ["symbol_id", "name", "type", "file_path", "line_start", "line_end", "signature", "position"]


def find_symbol_query(term: str, **options):
    return lambda spark, sf: symbols.find_symbol(placed_symbols(spark, sf), nation_files(spark, sf), term, **options).select(*FOUND)


def search_symbols_query(term: str, **options):
    return lambda spark, sf: symbols.search_symbols(placed_symbols(spark, sf), nation_files(spark, sf), term, **options).select(*FOUND)


def ranked_parts(spark: SparkSession, sf: str, term: str) -> DataFrame:
    exact = F.when(F.col("name") == term, 0).otherwise(1)
    hits = symbols.scan_hits(part_symbols(spark, sf), term).withColumn("score", F.round("score", 6))
    return hits.orderBy("score", exact, F.length("name"), "symbol_id").limit(20)


PLACED = """
placed AS (SELECT p_partkey AS symbol_id, n_name AS file_path, CAST(n_regionkey AS VARCHAR) AS language, p_brand AS signature,
                  p_size AS line_start, p_size + 5 AS line_end FROM part JOIN nation ON n_nationkey = p_partkey % 25)"""


def found_sql(hits: str, order: str, limit: int) -> str:
    """The result rows of hits (symbol_id, name, type and what the order needs)."""
    return f"""
SELECT symbol_id, name, type, file_path, line_start, line_end, signature, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position
FROM ({hits}) JOIN placed USING (symbol_id) QUALIFY position <= {limit}"""


PARTS = f"""
tok AS (
  SELECT p_partkey AS symbol_id, p_name AS name, p_type AS type,
         {tokens("p_name")} AS t1, {tokens("p_brand")} AS t2 FROM part)"""


# -- packing ----------------------------------------------------------------------------------


def ranked_with_tokens(spark, sf, term: str) -> DataFrame:
    found = search.search_files(document_files(spark, sf), term)
    return found.select("file_id", "relative_path", F.round("score", 6).alias("score"),
                        F.ceil(F.col("size") / 4).cast("long").alias("tokens"))


def pack_token_budget(spark, sf):
    found = ranked_with_tokens(spark, sf, "tion")
    return packing.pack(found, 4000, [F.col("score"), F.col("file_id")])


def pack_two_stage(spark, sf):
    files = ranked_with_tokens(spark, sf, "tion").withColumnRenamed("file_id", "item_id")
    parts = ranked_parts(spark, sf, "small widget").select(
        F.col("symbol_id").alias("item_id"), "score", F.length("name").cast("long").alias("tokens"))
    return packing.pack_two_stage(
        files, parts, 2500, [F.col("score"), F.col("item_id")], [F.col("score"), F.col("item_id")])


# -- usages -----------------------------------------------------------------------------------


def usage_lines(spark, sf):
    found = usages.usage_lines(document_files(spark, sf), "the")
    return found.select("file_id", "relative_path", joined(F.col("lines")).alias("lines"))


def first_words(spark, sf):
    """The first word of a document is taken as the symbol it defines."""
    return document_files(spark, sf).select(
        "file_id", F.regexp_extract("content", r"[A-Za-z]+", 0).alias("name"))


def usage_files(spark, sf):
    return usages.candidate_files(
        document_files(spark, sf), first_words(spark, sf), "The", limit=None).select("file_id", "relative_path", "is_test")


def usages_packed(spark, sf):
    found = usages.find_usages(document_files(spark, sf).drop("size"), first_words(spark, sf), "The", max_tokens=2500)
    return found.select("file_id", "relative_path", "language", "preview", joined(F.col("lines")).alias("lines"), "is_test",
                        "result_tokens", "running_tokens")


def preview_first10(spark, sf):
    return document_files(spark, sf).select("file_id", text.preview(F.col("content")).alias("preview"))


def human_sizes(spark, sf):
    """File sizes as text; the customer balance in cents stands for larger ones."""
    documents = document_files(spark, sf).select(F.lit("document").alias("kind"), F.col("file_id").alias("id"), "size")
    pages = page_files(spark, sf).select(F.lit("page").alias("kind"), F.col("file_id").alias("id"), "size")
    return documents.unionByName(pages).select("kind", "id", text.human_bytes(F.col("size")).alias("size_text"))


def unindexed_files(spark, sf):
    found = impact.unindexed(document_files(spark, sf), "tion")
    return impact.top_affected(found, limit=None).select(
        "file_id", "path", "reference_count", joined(F.col("lines")).alias("lines"), "is_test")


def unindexed_totals(spark, sf):
    return impact.unindexed_totals(impact.unindexed(document_files(spark, sf), "tion")).select(
        "direct_references", "files_affected", "tests_affected", "implementation", "risk_level",
        F.array_join("risk_factors", "|").alias("risk_factors"), F.array_join("suggestions", "|").alias("suggestions"))


LINES = """
lines AS (
  SELECT doc_id, source || '/' || doc_id AS relative_path, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""
USAGE = " OR ".join(f"contains(line, '{s.format('NAME')}')" for s in (
    "new {}", "{}(", "{}.", "<{}", ": {}", "extends {}", "implements {}"))
FIRST_WORD = "regexp_extract(text, '[A-Za-z]+')"
CANDIDATES = f"""
defining AS (SELECT doc_id FROM documents WHERE {FIRST_WORD} = 'The'),
candidates AS (
  SELECT doc_id AS file_id, source || '/' || doc_id AS relative_path,
         CASE WHEN regexp_matches(source || '/' || doc_id, '(?i)test|spec') THEN 1 ELSE 0 END AS is_test
  FROM documents WHERE text ILIKE '%The%' AND doc_id NOT IN (SELECT doc_id FROM defining))"""
MENTIONS = f"""
{LINES}, mentions AS (
  SELECT doc_id AS file_id, any_value(relative_path) AS path, count(*) AS reference_count,
         string_agg(n, ',' ORDER BY n) AS lines FROM lines WHERE contains(line, 'tion') GROUP BY doc_id)"""
WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}\\p{Co}]+')"

def path_categories(spark, sf):
    """Parts as file names, some of them tests and configurations."""
    path = F.col("relative_path")
    return part_paths(spark, sf).select(
        "p_partkey", paths.is_test(path).alias("is_test"), paths.loosely_test(path).alias("loosely_test"), paths.category(path).alias("category"))


QUERIES = {
    "path_categories": (path_categories, f"""
WITH {PART_PATHS}
SELECT p_partkey, contains(relative_path, '.test.') AS is_test, regexp_matches(relative_path, '(?i)test|spec') AS loosely_test,
  CASE WHEN contains(relative_path, '.test.') THEN 'tests' WHEN relative_path LIKE '%config%' OR relative_path LIKE '%.json' THEN 'configs'
       WHEN relative_path LIKE '%.ts' THEN 'implementation' ELSE 'other' END AS category FROM paths"""),
    "fts_sort_modified": (sorted_by_modified, f"""
WITH {DOCUMENTS}, {bm25("tok", FIELDS, KEEP, [["tion"]], "f0 > 0")},
seen AS (SELECT file_id, epoch_ms(0) + INTERVAL 1 DAY * (file_id * 7 % 1000) AS last_modified FROM tok)
SELECT s.file_id, relative_path, round(score, 6) AS score FROM scored s JOIN seen USING (file_id)
ORDER BY last_modified DESC, s.file_id LIMIT 10"""),
    "stats_totals": (stats_totals, """
SELECT count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_size,
       CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS total_tokens,
       (SELECT count(*) FROM part) AS symbol_count, (SELECT CAST(max(ts) AS DATE) FROM events) AS last_indexed
FROM documents"""),
    "stats_languages": (
        lambda spark, sf: stats.counts_by(_documents(spark, sf).select(F.col("lang").alias("language")), "language"),
        "SELECT lang AS language, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY 2 DESC, 1"),
    "stats_sources_top5": (
        lambda spark, sf: stats.counts_by(_documents(spark, sf), "source", 5),
        "SELECT source, count(*) AS count FROM documents GROUP BY source ORDER BY 2 DESC, 1 LIMIT 5"),
    "stats_symbol_types_top5": (
        lambda spark, sf: stats.counts_by(part_symbols(spark, sf), "type", 5),
        "SELECT p_type AS type, count(*) AS count FROM part GROUP BY p_type ORDER BY 2 DESC, 1 LIMIT 5"),
    "stats_largest10": (stats_largest10, """
SELECT source || '/' || doc_id AS relative_path, n_chars AS size, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens
FROM documents ORDER BY n_chars DESC, 1 LIMIT 10"""),
    "language_share": (language_share, """
WITH per AS (SELECT lang AS language, count(*) AS count FROM documents GROUP BY lang)
SELECT language, count, round(count * 100.0 / (SELECT sum(count) FROM per), 1) AS percentage,
       CAST(floor(count * 20.0 / (SELECT max(count) FROM per WHERE language IS NOT NULL) + 0.5) AS BIGINT) AS bar
FROM per WHERE language IS NOT NULL"""),
    "token_sum_estimate": (
        lambda spark, sf: document_files(spark, sf).groupBy("language").agg(
            F.sum(text.estimate_tokens(F.col("content"))).alias("tokens")),
        "SELECT lang AS language, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY lang"),
    "human_sizes": (human_sizes, """
WITH sizes AS (SELECT 'document' AS kind, doc_id AS id, n_chars AS size FROM documents
               UNION ALL SELECT 'page', page_id, length(html) FROM pages)
SELECT kind, id, CASE WHEN size = 0 THEN '0 B' WHEN size < 1024 THEN size || ' B'
  ELSE regexp_replace(printf('%.1f', round(size / 1024.0, 1)), '\\.0$', '') || ' KB' END AS size_text FROM sizes"""),
    "scan_table_rules": (scan_table_rules, """
WITH f AS (SELECT source || '/' || doc_id || '.' || CASE WHEN lang = 'en' THEN 'md' ELSE 'rst' END AS relative_path,
                  n_chars AS size, source, lang, text FROM documents)
SELECT relative_path, size, 'markdown' AS language, sha256(text) AS hash FROM f
WHERE size <= 10000 AND lang = 'en' AND source <> 'src1' AND NOT regexp_matches(source, '^src1.$')"""),
    "scan_include_substring": (
        lambda spark, sf: part_paths(spark, sf).filter(languages.included(F.col("relative_path"), ["script", "10"])),
        f"""
WITH {PART_PATHS}
SELECT p_partkey, relative_path FROM paths
WHERE regexp_matches(relative_path, '\\.(ts|js|json|PY)$')
  AND (regexp_matches(relative_path, '\\.(ts|js)$') OR contains(relative_path, '10'))"""),
    "scan_ignore_rules": (
        lambda spark, sf: part_paths(spark, sf).filter(~ignored(F.col("relative_path"), IGNORE_RULES)),
        f"""
WITH {PART_PATHS}, b AS (SELECT *, regexp_extract(relative_path, '[^/]+$') AS name FROM paths)
SELECT p_partkey, relative_path FROM b
WHERE NOT contains(relative_path, '/old/') 
  AND (NOT starts_with(relative_path, 'brand#1/hot/') OR (starts_with(name, 'gear_') AND ends_with(name, '.config.json')))
  AND (NOT starts_with(name, 'widget_') OR starts_with(relative_path, 'brand#2/'))
  AND (NOT ends_with(name, '.json') OR starts_with(name, 'gear_'))"""),
    "content_hash": (
        lambda spark, sf: document_files(spark, sf).select("file_id", F.sha2("content", 256).alias("hash")),
        "SELECT doc_id AS file_id, sha256(text) AS hash FROM documents"),
    "detect_language": (detect_special, f"""
WITH {PART_PATHS}, named AS (SELECT p_partkey, {SPECIAL_SQL} AS path FROM paths)
SELECT p_partkey, path, CASE
  WHEN path LIKE '%/Dockerfile' OR path LIKE '%/dockerfile.prod' THEN 'dockerfile'
  WHEN path LIKE '%/Makefile' THEN 'makefile' WHEN path LIKE '%/Gemfile' THEN 'ruby' WHEN path LIKE '%/Pipfile' THEN 'toml'
  WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.PY' THEN 'python' WHEN path LIKE '%.json' THEN 'json'
  WHEN path LIKE '%.js' THEN 'javascript' END AS language FROM named"""),
    "fts_bm25_top10": (file_search("tion"), search_sql([["tion"]], "f0 > 0")),
    "fts_and_two_terms": (file_search("estion ing"), search_sql([["estion"], ["ing"]], "f0 > 0 AND f1 > 0")),
    "fts_or": (file_search("keit OR estion"), search_sql([["keit"], ["estion"]], "f0 > 0 OR f1 > 0")),
    "fts_not": (file_search("tion NOT the"), f"""
WITH {DOCUMENTS}, {bm25("tok", FIELDS, KEEP + ", t2", [["tion"]], "f0 > 0")}
SELECT {KEEP}, round(score, 6) AS score FROM scored WHERE NOT list_contains(t2, 'the') ORDER BY score, file_id LIMIT 10"""),
    "fts_phrase": (file_search("of_the"), search_sql([["of", "the"]], "f0 > 0")),
    "fts_grouped": (file_search("estion ing OR keit NOT en AND ver"), f"""
WITH {DOCUMENTS}, {bm25("tok", FIELDS, KEEP + ", t1, t2, t3",
                        [["estion"], ["ing"], ["keit"], ["ver"]], "(f0 > 0 AND f1 > 0) OR (f2 > 0 AND f3 > 0)")},
again AS (SELECT *, len(list_filter(t2, lambda x: x = 'estion')) > 0 AND len(list_filter(t2, lambda x: x = 'ing')) > 0 AS left_side FROM scored)
SELECT {KEEP}, round(score, 6) AS score FROM again
WHERE left_side OR NOT (list_contains(t1, 'en') OR list_contains(t2, 'en') OR list_contains(t3, 'en'))
ORDER BY score, file_id LIMIT 10"""),
    "fts_lang_filter": (file_search("la", languages=["es"]), search_sql([["la"]], "f0 > 0 AND language = 'es'")),
    "fts_sort_size": (file_search("tion", sort_by="size"), search_sql([["tion"]], "f0 > 0", "size DESC")),
    "fts_sort_path": (file_search("tion", sort_by="path"), search_sql([["tion"]], "f0 > 0", "relative_path")),
    "fts_postings_top10": (postings_top10, f"""
WITH {DOCUMENTS}, {bm25("tok", FIELDS, "file_id", [["the"], ["tion"], ["of", "the"]], "(f0 > 0 AND f1 > 0) OR f2 > 0")}
SELECT file_id, round(score, 6) AS score FROM scored ORDER BY scored.score, file_id LIMIT 10"""),
    "like_fallback": (like_fallback, """
SELECT doc_id AS file_id, source || '/' || doc_id AS relative_path, lang AS language, n_chars AS size
FROM documents WHERE text LIKE '%@%' ORDER BY relative_path, file_id LIMIT 100"""),
    "snippet_first_hit": (snippet_first_hit, f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
p AS (SELECT doc_id, words, list_position(list_transform(words, lambda x: {fold("x")}), 'estion') AS pos FROM w),
q AS (SELECT doc_id, words, pos, greatest(1, pos - 16) AS a FROM p WHERE pos > 0)
SELECT doc_id AS file_id,
  CASE WHEN a > 1 THEN '...' ELSE '' END
  || array_to_string(list_transform(range(a, least(a + 32, len(words) + 1)),
       lambda i: CASE WHEN i = pos THEN '<mark>' || words[i] || '</mark>' ELSE words[i] END), ' ')
  || CASE WHEN a + 32 <= len(words) THEN '...' ELSE '' END AS snippet FROM q"""),
    "find_symbol_ranked": (find_symbol_query("small widget"), f"""
WITH {PARTS}, {PLACED}, {bm25("tok", ["t1", "t2"], "symbol_id, name, type", [["small"], ["widget"]], "f0 > 0 AND f1 > 0")}
""" + found_sql("SELECT * FROM scored", "score, CASE WHEN name = 'small widget' THEN 0 ELSE 1 END, length(name), symbol_id", 20)),
    "find_symbol_like": (find_symbol_query("% _"), f"WITH {PLACED}" + found_sql(
        "SELECT p_partkey AS symbol_id, p_name AS name, p_type AS type FROM part WHERE p_name ILIKE '%% _%'", "length(name), symbol_id", 20)),
    "find_symbol_language": (find_symbol_query("small widget", languages=["2", "3"]), f"""
WITH {PARTS}, {PLACED}, {bm25("tok", ["t1", "t2"], "symbol_id, name, type", [["small"], ["widget"]], "f0 > 0 AND f1 > 0")}
""" + found_sql("SELECT s.* FROM scored s JOIN placed USING (symbol_id) WHERE language IN ('2', '3')",
                "score, CASE WHEN name = 'small widget' THEN 0 ELSE 1 END, length(name), symbol_id", 20)),
    "search_symbols_top15": (search_symbols_query("red OR widget"), f"""
WITH {PARTS}, {PLACED}, {bm25("tok", ["t1", "t2"], "symbol_id, name, type", [["red"], ["widget"]], "f0 > 0 OR f1 > 0")}
""" + found_sql("SELECT * FROM scored", "score, symbol_id", 15)),
    "search_symbols_like": (search_symbols_query("#"), f"WITH {PLACED}" + found_sql(
        "SELECT p_partkey AS symbol_id, p_name AS name, p_type AS type FROM part WHERE p_name ILIKE '%#%' OR p_brand ILIKE '%#%'",
        "name, symbol_id", 100)),
    "pack_token_budget": (pack_token_budget, f"""
WITH {DOCUMENTS}, {bm25("tok", FIELDS, KEEP, [["tion"]], "f0 > 0")},
top AS (SELECT file_id, relative_path, round(score, 6) AS score, CAST(ceil(size / 4.0) AS BIGINT) AS tokens
        FROM scored ORDER BY scored.score, file_id LIMIT 10),
run AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY score, file_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens FROM top)
SELECT * FROM run WHERE running_tokens <= 4000"""),
    "pack_two_stage": (pack_two_stage, f"""
WITH {DOCUMENTS}, {bm25("tok", FIELDS, KEEP, [["tion"]], "f0 > 0")},
f AS (SELECT 'file' AS kind, file_id AS item_id, round(score, 6) AS score, CAST(ceil(size / 4.0) AS BIGINT) AS tokens
      FROM scored ORDER BY scored.score, file_id LIMIT 10),
fr AS (SELECT kind, item_id, row_number() OVER w AS rank, tokens, CAST(sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens
       FROM f WINDOW w AS (ORDER BY score, item_id)),
ptok AS (SELECT * FROM (WITH {PARTS} SELECT * FROM tok)),
{bm25("ptok", ["t1", "t2"], "symbol_id, name, type", [["small"], ["widget"]], "f0 > 0 AND f1 > 0").replace("per AS", "pper AS").replace("FROM per,", "FROM pper,").replace("FROM per)", "FROM pper)").replace("corpus", "pcorpus").replace("scored", "pscored")},
s AS (SELECT 'symbol' AS kind, symbol_id AS item_id, round(score, 6) AS score, length(name) AS tokens, name FROM pscored
      ORDER BY round(pscored.score, 6), CASE WHEN name = 'small widget' THEN 0 ELSE 1 END, length(name), symbol_id LIMIT 20),
spent AS (SELECT coalesce(sum(tokens), 0) AS t FROM fr WHERE running_tokens <= 2500),
sr AS (SELECT kind, item_id, row_number() OVER w AS rank, tokens,
              CAST(sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) + (SELECT t FROM spent) AS BIGINT) AS running_tokens
       FROM s WINDOW w AS (ORDER BY score, item_id))
SELECT *, running_tokens <= 2500 AS kept FROM (SELECT * FROM fr UNION ALL SELECT * FROM sr)"""),
    "usage_lines": (usage_lines, f"""
WITH {LINES}
SELECT doc_id AS file_id, any_value(relative_path) AS relative_path, string_agg(n, ',' ORDER BY n) AS lines
FROM lines WHERE {USAGE.replace("NAME", "the")} GROUP BY doc_id"""),
    "usage_files_excluding_definition": (usage_files, f"""
WITH {CANDIDATES} SELECT file_id, relative_path, is_test FROM candidates"""),
    "usages_packed": (usages_packed, f"""
WITH {LINES}, {CANDIDATES},
c AS (SELECT * FROM candidates ORDER BY is_test, relative_path, file_id LIMIT 20),
u AS (SELECT c.file_id, c.relative_path, c.is_test, string_agg(n, ',' ORDER BY n) AS lines
      FROM c JOIN lines ON lines.doc_id = c.file_id WHERE {USAGE.replace("NAME", "The")} GROUP BY ALL),
d AS (SELECT u.*, lang AS language, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS preview
      FROM u JOIN documents ON doc_id = file_id),
t AS (SELECT *, CAST(ceil(length('{{"file_id":' || file_id || ',"relative_path":' || to_json(relative_path) || ',"language":'
        || to_json(language) || ',"preview":' || to_json(preview) || ',"lines":[' || lines || ']}}') / 4.0) AS BIGINT) AS result_tokens FROM d),
r AS (SELECT *, CAST(sum(result_tokens) OVER (ORDER BY is_test, relative_path, file_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens FROM t)
SELECT * FROM r WHERE running_tokens <= 2500"""),
    "preview_first10_lines": (preview_first10, """
SELECT doc_id AS file_id, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS preview FROM documents"""),
    "impact_unindexed": (unindexed_files, f"""
WITH {MENTIONS}
SELECT file_id, path, reference_count, lines, false AS is_test FROM mentions"""),
    "impact_unindexed_totals": (unindexed_totals, f"""
WITH {MENTIONS}, t AS (SELECT CAST(sum(reference_count) AS BIGINT) AS r, count(*) AS f FROM mentions)
SELECT r AS direct_references, f AS files_affected, CAST(0 AS BIGINT) AS tests_affected, f AS implementation,
  CASE WHEN r > 10 THEN 'HIGH' WHEN r > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  'Symbol not indexed but found ' || r || ' text references' AS risk_factors,
  'Consider indexing this symbol for better analysis' AS suggestions FROM t"""),
}
