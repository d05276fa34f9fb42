"""Checks of command line values."""

from __future__ import annotations

import sys

# Languages the query command knows, and its limits for warnings.
KNOWN_LANGUAGES = """
typescript javascript python go rust java c cpp csharp ruby php swift kotlin
markdown json yaml toml xml html css
""".split()
FORMATS = ("ai", "json", "human")
WARN_ABOVE = {
    "--tokens": (100000, "Large token limit ({}) may affect performance"),
    "--recent": (365, "Large time range ({} days) may return many results"),
    "--depth": (5, "Large depth ({}) may affect performance"),
}


class ValidationError(ValueError):
    pass


def warn(message: str) -> None:
    print(f"⚠️  {message}", file=sys.stderr)


def positive_int(value: str, option: str) -> int:
    digits = str(value).strip()
    number = int(digits) if digits.lstrip("+").isdigit() else 0
    if number <= 0:
        raise ValidationError(f'Invalid value for {option}: "{value}". Must be a positive integer.')
    limit, message = WARN_ABOVE.get(option, (None, ""))
    if limit and number > limit:
        warn(message.format(number))
    return number


def output_format(value: str) -> str:
    if value not in FORMATS:
        raise ValidationError(f'Invalid format: "{value}". Must be one of: {", ".join(FORMATS)}')
    return value


def languages(value: str, aliases: dict[str, str]) -> list[str]:
    names = [aliases.get(n.strip(), n.strip()) for n in value.split(",") if n.strip()]
    if not names:
        raise ValidationError("No languages specified")
    unknown = [n for n in names if n not in KNOWN_LANGUAGES]
    if unknown:
        warn(f"Unknown languages: {', '.join(unknown)}")
    return names


def path(value: str) -> str:
    if not value or not value.strip():
        raise ValidationError("Path cannot be empty")
    return value.strip()


def search_term(value: str) -> str:
    if not value or not value.strip():
        raise ValidationError("Search term cannot be empty")
    if len(value) < 2:
        raise ValidationError("Search term must be at least 2 characters")
    return value.strip()
