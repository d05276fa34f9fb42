"""Schemas of the tables of an index."""

from __future__ import annotations

STRUCTURE = "map<string,array<struct<name:string,line:int,signature:string>>>"

FILES = f"""
file_id string, path string, relative_path string, content string, hash string, size long,
language string, last_modified timestamp, indexed_at timestamp, tokens long, index_tokens long,
imports array<string>, exports array<string>, structure {STRUCTURE}, error string
"""
SYMBOLS = """
symbol_id string, file_id string, name string, type string, line_start int, line_end int,
signature string, documentation string, metadata string
"""
CALL_GRAPH = """
call_id string, caller_symbol_id string, caller_file_id string, callee_name string,
callee_symbol_id string, callee_file_id string, call_type string, line_number int, column_number int
"""
COMMENTS = "file_id string, line_number int, comment string"
POSTINGS = """
term string, file_id string, field int, positions array<int>, doc_length long
"""
SYMBOL_POSTINGS = """
term string, symbol_id string, name string, field int, positions array<int>, doc_length long
"""
# What a name may stand for: per file the first symbol of that name or last part of a name.
DEFINITIONS = "name string, file_id string, rank decimal(23,0)"
# Which name calls which, once per file.
CALLERS = "caller string, callee string, file_id string"
SIZES = "file_id string, index_tokens long, symbols long, symbol_tokens long"
GRAMS = "gram int, block string, bucket int"
DEAD_FILES = "file_id string, of string"
DEAD_EDGES = "call_id string, of string"
CACHE = "query_key string, result string, created_at timestamp, expires_at timestamp"

TABLES = {
    "files": FILES, "symbols": SYMBOLS, "call_graph": CALL_GRAPH, "comments": COMMENTS,
    "postings": POSTINGS, "symbol_postings": SYMBOL_POSTINGS,
    "definitions": DEFINITIONS, "callers": CALLERS, "sizes": SIZES, "grams": GRAMS, "dead_files": DEAD_FILES, "dead_edges": DEAD_EDGES,
}
