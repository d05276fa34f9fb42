"""What a path says about a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a path that mark a test file.
TEST_PARTS = [
    ".test.", ".spec.", "_test.", "_spec.", "/test/", "/tests/", "/spec/", "/specs/", "/__tests__/", "/__test__/",
]
# Endings of implementation files.
CODE_ENDINGS = [".ts", ".js", ".py", ".java"]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_test(path: Column) -> Column:
    lowered = F.lower(path)
    return _any([lowered.contains(part) for part in TEST_PARTS])


def loosely_test(path: Column) -> Column:
    """The looser notion used to put tests last among usages (ASCII case-blind)."""
    return path.rlike("(?i)test|spec")


def category(path: Column) -> Column:
    return (
        F.when(is_test(path), "tests")
        .when(path.contains("config") | path.endswith(".json"), "configs")
        .when(_any([path.endswith(ending) for ending in CODE_ENDINGS]), "implementation")
        .otherwise("other")
    )
