"""Which extractor reads a file: by language and priority, the next one where it fails.

An extractor is registered on the driver and travels to the tasks with the job that uses it. What it finds becomes rows of
the same form as the built-in rules give, so that symbols, calls, imports and comments need nothing else.

    from lodebook.operators.extractors import REGISTRY, Extractor, Found

    def find(language, content):
        for m in re.finditer(r"^task (\\w+)", content, re.M):
            yield Found("function", m.group(1), m.start(), m.end())

    REGISTRY.register(Extractor("tasks", find, ("tasklang",), priority=20))
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

KINDS = ("function", "class", "variable", "import", "export", "comment", "call_function", "call_method", "call_new")
FIRST_RULE = 1000  # numbers of the kinds of added extractors, beyond those of the rules


class Found(NamedTuple):
    """A construct from offset `start` to `end`; `name` of a method call is `object.method`.

    `text` is shown as its signature, the text itself where none is given; `last` is the offset where its body ends.
    """

    kind: str
    name: str
    start: int
    end: int
    text: str | None = None
    last: int | None = None


@dataclass(frozen=True)
class Extractor:
    """`find(language, content)` yields what it finds. Without languages it is for all files."""

    name: str
    find: Callable[[str, str], Iterable[Found]]
    languages: tuple[str, ...] = ()
    priority: int = 0


@dataclass
class Registry:
    """Added extractors. The built-in rules of a language have priority 10, those for every other file 1."""

    extractors: list[Extractor] = field(default_factory=list)

    def register(self, extractor: Extractor) -> None:
        """A second extractor of one name replaces the first."""
        self.unregister(extractor.name)
        self.extractors.append(extractor)

    def unregister(self, name: str) -> None:
        self.extractors = [e for e in self.extractors if e.name != name]

    def chain(self, language: str, built_in: int) -> list[Extractor | None]:
        """What to try for a language, best first; None stands for the built-in rules, which go before their equals.

        Extractors of this language go before those for all files, whatever their priority.
        """
        own: list[tuple] = [(e.languages != (), e.priority, e) for e in self.extractors if not e.languages or language in e.languages]
        own.append((built_in > 1, built_in + 0.5, None))
        return [e for _, _, e in sorted(own, key=lambda x: (-x[0], -x[1]))]

    def languages(self) -> list[str]:
        """Languages that an added extractor names."""
        return sorted({name for e in self.extractors for name in e.languages})


REGISTRY = Registry()


def rows_of(extractor: Extractor, file_id, language: str, content: str, facts, kinds: frozenset[str] | None) -> list[tuple]:
    """The constructs as match rows; one that is out of range or of an unknown kind is the extractor's failure."""
    rows = []
    for f in extractor.find(language, content):
        if f.kind not in KINDS or not 0 <= f.start <= f.end <= len(content):
            raise ValueError(f"{extractor.name} gave {f!r}")
        if kinds is not None and f.kind not in kinds:
            continue
        line = facts.line_of(f.start)
        groups = f.name.rsplit(".", 1) if f.kind == "call_method" else [f.name]
        last = facts.line_of(max(f.start, (f.end if f.last is None else f.last) - 1)) + 1
        rows.append((file_id, language, f.kind, FIRST_RULE + KINDS.index(f.kind), f.start, line + 1, last,
                     f.start - facts.starts[line] + 1, content[f.start:f.end] if f.text is None else f.text, groups, False, [], None))
    return rows
