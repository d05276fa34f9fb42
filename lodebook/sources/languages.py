"""Language of a file, from its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension -> language.
LANGUAGE_OF = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".py": "python",
    ".pyx": "python",
    ".pyi": "python",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".scala": "scala",
    ".sc": "scala",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hxx": "cpp",
    ".cs": "csharp",
    ".fs": "fsharp",
    ".fsx": "fsharp",
    ".fsi": "fsharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".m": "objective-c",
    ".mm": "objective-cpp",
    ".dart": "dart",
    ".lua": "lua",
    ".r": "r",
    ".jl": "julia",
    ".clj": "clojure",
    ".cljs": "clojure",
    ".cljc": "clojure",
    ".ex": "elixir",
    ".exs": "elixir",
    ".erl": "erlang",
    ".hrl": "erlang",
    ".hs": "haskell",
    ".lhs": "haskell",
    ".ml": "ocaml",
    ".mli": "ocaml",
    ".elm": "elm",
    ".purs": "purescript",
    ".nim": "nim",
    ".nims": "nim",
    ".zig": "zig",
    ".v": "vlang",
    ".sv": "systemverilog",
    ".svh": "systemverilog",
    ".vhd": "vhdl",
    ".vhdl": "vhdl",
    ".sql": "sql",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".fish": "shell",
    ".ps1": "powershell",
    ".psm1": "powershell",
    ".bat": "batch",
    ".cmd": "batch",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".json": "json",
    ".xml": "xml",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "sass",
    ".less": "less",
    ".vue": "vue",
    ".svelte": "svelte",
    ".md": "markdown",
    ".mdx": "markdown",
    ".rst": "restructuredtext",
    ".tex": "latex",
    ".dockerfile": "dockerfile",
    ".proto": "protobuf",
    ".graphql": "graphql",
    ".gql": "graphql",
    ".sol": "solidity",
}
# Whole file names -> language (a name may go on after "dockerfile.").
SPECIAL_NAMES = {
    "dockerfile": "dockerfile",
    "makefile": "makefile",
    "gnumakefile": "makefile",
    "rakefile": "ruby",
    "gemfile": "ruby",
    "pipfile": "toml",
}
# Short names accepted by the language options of the command line.
ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "rs": "rust", "rb": "ruby",
           "kt": "kotlin", "cs": "csharp", "md": "markdown", "yml": "yaml", "sh": "shell"}

LANGUAGES = list(dict.fromkeys(LANGUAGE_OF.values()))


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    """The last dotted part in lower case; a leading dot starts no extension."""
    return F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]*)$", 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.element_at(F.create_map(*pairs), key)


def detect_language(path: Column) -> Column:
    name = base_name(path)
    return F.coalesce(
        _lookup(LANGUAGE_OF, extension(path)),
        _lookup(SPECIAL_NAMES, name),
        F.when(name.startswith("dockerfile."), F.lit("dockerfile")),
    )


def included(relative_path: Column, patterns: list[str]) -> Column:
    """Kept by an include list: a known extension, and any pattern is part of the
    language, the extension or the path."""
    if not patterns:
        return F.lit(True)
    ext = extension(relative_path)
    lang = _lookup(LANGUAGE_OF, ext)
    hits = [lang.contains(p) | ext.contains(p) | relative_path.contains(p) for p in patterns]
    return lang.isNotNull() & reduce(lambda a, b: a | b, hits)


def supported_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in LANGUAGES], "language string").orderBy("language")


def supported_extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(e, n) for e, n in LANGUAGE_OF.items()], "extension string, language string"
    ).orderBy("extension")


def canonical(names: list[str]) -> list[str]:
    return [ALIASES.get(n, n) for n in names]
