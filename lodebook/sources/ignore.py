"""Ignore rules (gitignore syntax) as one condition on the relative path."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_FOLDER = ".lodebook"
IGNORE_FILES = (".gitignore", ".lodebookignore")

# Patterns ignored unless the caller gives a list.
DEFAULT_PATTERNS = [
    "node_modules", "node_modules/**", "**/node_modules", "**/node_modules/**", ".git/**", ".svn/**", ".hg/**",
    ".lodebook/**", "dist", "dist/**", "**/dist", "**/dist/**", "build", "build/**", "**/build", "**/build/**",
    "out/**", "target/**", "*.pyc", "__pycache__/**", ".pytest_cache/**", ".venv", ".venv/**", "venv", "venv/**",
    "env", "env/**", ".env", ".env/**", "**/.venv", "**/.venv/**", "**/venv", "**/venv/**", "**/env", "**/env/**",
    "vendor/**", "Pods/**", ".gradle/**", ".idea/**", ".vscode/**", ".vs/**", "*.class", "*.jar", "*.war", "*.ear",
    "*.dll", "*.exe", "*.so", "*.dylib", "*.a", "*.o", "*.obj", "*.pdb", "*.idb", "*.suo", "*.log", "*.tmp", "*.temp",
    "*.swp", "*.swo", "*.DS_Store", "Thumbs.db", "desktop.ini", "*.lock", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock", "*.min.js", "*.min.css", "*.map",
]


class IgnoreRule(NamedTuple):
    regex: str
    negated: bool
    folders_only: bool


def ignore_rule(pattern: str) -> IgnoreRule | None:
    """The rule of one line as a regex over a path, or None for a blank line or comment."""
    line = pattern.rstrip("\r\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    folder_only = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    body, i = "", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            body += "(?:.*/)?"
            i += 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            body += "/.+"
            i += 3
        elif line[i] == "*":
            body += "[^/]*"
            i += 1
        elif line[i] == "?":
            body += "[^/]"
            i += 1
        elif line[i] == "[" and "]" in line[i + 1:]:
            end = line.index("]", i + 1)
            inner = line[i + 1:end]
            body += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            body += re.escape(line[i + 1])
            i += 2
        else:
            body += re.escape(line[i])
            i += 1
    prefix = "" if anchored else "(?:.*/)?"
    return IgnoreRule(f"^{prefix}{body}$", negated, folder_only)


def compile_rules(patterns: list[str]) -> list[IgnoreRule]:
    return [rule for rule in map(ignore_rule, patterns) if rule]


def _runs(rules: list[IgnoreRule]) -> list[IgnoreRule]:
    """Neighbouring rules of the same sort as one alternation each."""
    merged: list[IgnoreRule] = []
    for rule in rules:
        if merged and merged[-1][1:] == rule[1:]:
            merged[-1] = merged[-1]._replace(regex=f"{merged[-1].regex}|{rule.regex}")
        else:
            merged.append(rule)
    return merged


def ignored(relative_path: Column, patterns: list[str]) -> Column:
    """Whether a file or any folder above it is ignored.

    On each level the last rule that matches decides, and a negated rule keeps the entry;
    nothing brings back what lies in an ignored folder.
    """
    runs = _runs(compile_rules(patterns))
    parts = F.split(relative_path, "/")
    levels = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i < F.size(parts)).alias("folder")))

    def verdict(level: Column) -> Column:
        result = F.lit(False)
        for run in runs:
            hit = level["path"].rlike(run.regex)
            if run.folders_only:
                hit = hit & level["folder"]
            result = F.when(hit, F.lit(not run.negated)).otherwise(result)
        return result

    return F.exists(levels, verdict)


def entry_ignored(relative_path: str, is_folder: bool, rules: list[tuple[re.Pattern, IgnoreRule]]) -> bool:
    """The decision for one entry of a listing that never enters an ignored folder."""
    decision = False
    for regex, rule in rules:
        if (is_folder or not rule.folders_only) and regex.match(relative_path):
            decision = not rule.negated
    return decision
