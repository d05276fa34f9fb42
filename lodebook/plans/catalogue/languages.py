"""Symbols and imports of every language with a pattern table, from files made of the parts' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodebook.operators import extraction
from lodebook.plans.catalogue.code import matches_in
from lodebook.sources.codetree import dealt
from lodebook.sources.tables import read_table

# Per language a file, and what its patterns find there: (type, name, line), imports in order. `@K` stands for the key.
# A pattern that begins with blanks takes the line end before it along, and so begins a line earlier.
SAMPLES: dict[str, tuple[str, list[tuple[str, str, int]], list[str]]] = {
    "c": ("#include <a@K.h>\nstatic int add_@K(int a) {\n  return a;\n}\nint far_@K(void);\nstruct Box_@K {\n  int x;\n};\nenum Kind_@K { A };",
          [("function", "add_@K", 2), ("function", "far_@K", 5), ("class", "Box_@K", 6), ("class", "Kind_@K", 9)], ["a@K.h"]),
    "cpp": ("using namespace std@K;\ntemplate <class T>\nT max_@K(T a) {\n  return a;\n}\nclass Box_@K {\n  int size() const noexcept {\n  }\n};\nnamespace ns_@K {\n}",
            [("function", "max_@K", 2), ("function", "size", 7), ("class", "Box_@K", 6), ("class", "ns_@K", 10)], ["std@K"]),
    "csharp": ("using System.P@K;\nclass Box_@K {\n  int Get_@K(int a) { return a; }\n}", [("function", "Get_@K", 2), ("class", "Box_@K", 1)], ["System.P@K"]),
    "java": ("import a.B@K;\nclass Box_@K {\n  int get_@K() { return 1; }\n}", [("function", "get_@K", 2), ("class", "Box_@K", 1)], ["a.B@K"]),
    "kotlin": ("import a.b@K\ndata class Box_@K(x)\noverride fun get_@K(a) {\n}", [("function", "get_@K", 3), ("class", "Box_@K", 2)], ["a.b@K"]),
    "swift": ("import Kit@K\nfinal class Box_@K {\n  static func get_@K(a) {\n  }\n}", [("function", "get_@K", 3), ("class", "Box_@K", 2)], ["Kit@K"]),
    "go": ("func (b Box) Get_@K(a int) int {\n}\ntype Box_@K struct {\n}", [("function", "Get_@K", 1), ("class", "Box_@K", 3)], []),
    "rust": ("use a::b@K;\npub fn get_@K<T>(a: T) {\n}\npub struct Box_@K<T> {\n}\nimpl Show_@K {\n}",
             [("function", "get_@K", 2), ("class", "Box_@K", 4), ("class", "Show_@K", 6)], ["a::b@K"]),
    "ruby": ("require 'a@K'\nmodule Mod_@K\nclass Box_@K < Base\n  def self.get_@K?\n  end\nend\nend",
             [("function", "get_@K?", 4), ("class", "Box_@K", 3), ("class", "Mod_@K", 2)], ["a@K"]),
    "php": ("use A\\B@K;\nclass Box_@K extends Base {\n  public function get_@K($a) {\n    $v_@K = 1;\n  }\n}",
            [("function", "get_@K", 2), ("class", "Box_@K", 2), ("variable", "v_@K", 4)], ["A\\B@K"]),
    "scala": ("import a.b@K\ncase class Box_@K(x)\nobject One_@K {\n  def get_@K[T](a) = a\n}", [("function", "get_@K", 4), ("class", "Box_@K", 2), ("class", "One_@K", 3)], ["a.b@K"]),
    "perl": ("package Pack::P@K;\nuse Mod::M@K;\nsub get_@K {\n  my $v_@K = 1;\n}", [("function", "get_@K", 3), ("class", "Pack::P@K", 1), ("variable", "v_@K", 4)], ["Mod::M@K"]),
    "lua": ("local m_@K = require('a@K')\nlocal function get_@K(a)\nend", [("function", "get_@K", 2), ("variable", "m_@K", 1)], ["a@K"]),
    "shell": ("source lib@K\nget_@K() {\n  V_@K=1\n}", [("function", "get_@K", 2), ("variable", "V_@K", 3)], ["lib@K"]),
    "r": ("library(a@K)\nget_@K <- function(a) {\n}", [("function", "get_@K", 2), ("variable", "get_@K", 2)], ["a@K"]),
    "julia": ("using A@K\nfunction get_@K(a)\nend\nmutable struct Box_@K\nend", [("function", "get_@K", 2), ("class", "Box_@K", 4)], ["A@K"]),
    "elixir": ("defmodule Mod.M@K do\n  alias A.B@K\n  defp get_@K(a) do\n  end\nend", [("function", "get_@K", 3), ("class", "Mod.M@K", 1)], ["A.B@K"]),
    "haskell": ("import qualified A.B@K\nget_@K :: Int", [("function", "get_@K", 2)], ["A.B@K"]),
    "clojure": ("(ns a (:require [a.b@K]))\n(defn get_@K [a] a)\n(defmacro mac_@K [a] a)", [("function", "get_@K", 2), ("function", "mac_@K", 3)], ["a.b@K"]),
    "erlang": ("-include(\"a@K.hrl\").\nget_@K(A) -> A.", [("function", "get_@K", 2)], ["a@K.hrl"]),
    "nim": ("import lib/a@K\nproc get_@K*(a: int) =\n  discard\ntemplate tpl_@K(a: int) =\n  discard", [("function", "get_@K", 2), ("function", "tpl_@K", 4)], ["lib/a@K"]),
    "dart": ("import 'a@K.dart';\nabstract class Box_@K extends Base {\n}", [("class", "Box_@K", 2)], ["a@K.dart"]),
    "zig": ("const a = @import(\"a@K.zig\");\npub fn get_@K(a: u8) u8 {\n}\nconst Box_@K = struct {\n};", [("function", "get_@K", 2), ("class", "Box_@K", 4)], ["a@K.zig"]),
    "vlang": ("import a.b@K\npub fn (b Box) get_@K(a int) int {\n}\nstruct Box_@K {\n}", [("function", "get_@K", 2), ("class", "Box_@K", 4)], ["a.b@K"]),
    "solidity": ("import \"a@K.sol\";\ncontract Box_@K is Base {\n  uint256 public v_@K;\n  function get_@K(uint a) public view {\n  }\n}",
                 [("function", "get_@K", 4), ("class", "Box_@K", 2), ("variable", "v_@K", 3), ("variable", "a", 4)], ["a@K.sol"]),
}


def language_files(spark, sf):
    """For every part a file in every language."""
    samples = F.explode(F.create_map(*[F.lit(x) for name, (content, _, _) in SAMPLES.items() for x in (name, content)]))
    parts = dealt(read_table(spark, sf, "part").select("p_partkey"), "p_partkey", len(SAMPLES))
    return parts.select(F.col("p_partkey").cast("string").alias("key"), samples.alias("language", "sample")).select(
        F.concat_ws("/", "language", "key").alias("file_id"), "language", F.replace("sample", F.lit("@K"), F.col("key")).alias("content"))


def symbols(spark, sf):
    matches = matches_in(language_files(spark, sf), extraction.SYMBOL_RULES)
    return extraction.symbols_of(matches).select("file_id", "type", "name", F.col("line_start").alias("line"))


def imports(spark, sf):
    matches = extraction.find_matches(language_files(spark, sf), extraction.IMPORT_RULES)
    found = extraction.imports_exports_of(matches).select("file_id", F.array_join("imports", ",").alias("imports"))
    return found.filter("imports <> ''")


# A class with 0 to 4 computed methods that return objects with methods, and as many fields that hold functions.
SCOPES_HEAD = "class Box_@K<T extends { a: number }> extends mix({ b() {} }) {\n"
SCOPES_PAIR = "  ['s' + 1]() { }; [key_@I]() { return { go_@I() {}, x: 1 } }\n  field_@I = async (x) => { y = { z: call_@I(x) } }\n"
SCOPES_TAIL = ("  last(): void {\n    return `} ${new (class Hidden { no() {} })()} {`;\n  }\n}\n"
               "const enum Kind_@K { A, B = 2 }\ninterface Shape_@K { side: number; area(): void }")


def scope_files(spark, sf):
    """For every customer a TypeScript file whose number of members follows from its key."""
    key, count = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 5).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.array_join(F.transform(numbers, lambda i: F.replace(F.lit(SCOPES_PAIR), F.lit("@I"), i.cast("string"))), "")
    content = F.replace(F.concat(F.lit(SCOPES_HEAD), pairs, F.lit(SCOPES_TAIL)), F.lit("@K"), key)
    customers = dealt(read_table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return customers.select(key.alias("file_id"), F.lit("typescript").alias("language"), content.alias("content"))


def scope_symbols(spark, sf):
    matches = matches_in(scope_files(spark, sf), extraction.SYMBOL_RULES)
    return extraction.symbols_of(matches).select("file_id", "name", "type", "line_start", "line_end", "signature")


def scope_members(spark, sf):
    matches = matches_in(scope_files(spark, sf), (*extraction.SYMBOL_RULES, *extraction.PROPERTY_RULES))
    symbols = extraction.symbols_of(matches)
    merged = extraction.with_members(symbols, extraction.class_members(matches, symbols))
    parts = [F.get_json_object("metadata", f"$.{part}").alias(part) for part in ("methods", "properties", "members")]
    return merged.filter("type <> 'method'").select("file_id", "name", *parts)


def scope_calls(spark, sf):
    matches = extraction.find_matches(scope_files(spark, sf), extraction.CALL_RULES)
    return extraction.calls_of(matches).select("file_id", "callee_name", "call_type", "line_number")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_FOUND = ", ".join(
    f"('{name}', '{kind}', {_quoted(what)}, {line})" for name, (_, found, _) in SAMPLES.items() for kind, what, line in found)
_IMPORTS = ", ".join(f"('{name}', {_quoted(','.join(what))})" for name, (_, _, what) in SAMPLES.items() if what)

QUERIES = {
    "extract_language_symbols": (symbols, f"""
SELECT language || '/' || p_partkey AS file_id, type, replace(name, '@K', p_partkey || '') AS name, line
FROM part, (VALUES {_FOUND}) AS found(language, type, name, line)"""),
    "extract_language_imports": (imports, f"""
SELECT language || '/' || p_partkey AS file_id, replace(imports, '@K', p_partkey || '') AS imports
FROM part, (VALUES {_IMPORTS}) AS found(language, imports)"""),
    "extract_javascript_scopes": (scope_symbols, """
WITH files AS (SELECT c_custkey || '' AS file_id, CAST(c_custkey % 5 AS INTEGER) AS n FROM customer),
     pairs AS (SELECT file_id, unnest(range(n)) AS i FROM files)
SELECT file_id, 'Box_' || file_id AS name, 'class' AS type, 1 AS line_start, 5 + 2 * n AS line_end,
       'class Box_' || file_id || ' extends unknown' AS signature FROM files
UNION ALL SELECT file_id, 'Box_' || file_id || '.key_' || i, 'method', 2 + 2 * i, 2 + 2 * i, 'key_' || i || '()' FROM pairs
UNION ALL SELECT file_id, 'Box_' || file_id || '.unknown', 'method', 2 + 2 * i, 2 + 2 * i, 'unknown()' FROM pairs
UNION ALL SELECT file_id, 'Box_' || file_id || '.last', 'method', 2 + 2 * n, 4 + 2 * n, 'last()' FROM files
UNION ALL SELECT file_id, 'Kind_' || file_id, 'enum', 6 + 2 * n, 6 + 2 * n, 'enum Kind_' || file_id FROM files
UNION ALL SELECT file_id, 'Shape_' || file_id, 'interface', 7 + 2 * n, 7 + 2 * n, 'interface Shape_' || file_id FROM files"""),
    "extract_javascript_members": (scope_members, """
WITH files AS (SELECT c_custkey || '' AS file_id, CAST(c_custkey % 5 AS INTEGER) AS n FROM customer)
SELECT file_id, 'Box_' || file_id AS name,
       '[' || array_to_string(list_append(flatten([['"unknown"', '"key_' || i || '"'] FOR i IN range(n)]), '"last"'), ',') || ']' AS methods,
       '[' || array_to_string(['"field_' || i || '"' FOR i IN range(n)], ',') || ']' AS properties, NULL AS members FROM files
UNION ALL SELECT file_id, 'Kind_' || file_id, NULL, NULL, '["A","B"]' FROM files
UNION ALL SELECT file_id, 'Shape_' || file_id, NULL, '["side"]', NULL FROM files"""),
    "extract_javascript_calls": (scope_calls, """
WITH files AS (SELECT c_custkey || '' AS file_id, CAST(c_custkey % 5 AS INTEGER) AS n FROM customer)
SELECT file_id, 'mix' AS callee_name, 'function' AS call_type, 1 AS line_number FROM files
UNION ALL SELECT file_id, 'call_' || i, 'function', 3 + 2 * i FROM (SELECT file_id, unnest(range(n)) AS i FROM files)"""),
}
