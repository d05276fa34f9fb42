"""Nested scopes of JavaScript and TypeScript texts, found in one pass over their tokens.

A stack holds the open brackets. A brace opens the body of a class, an interface or an enum, an object (or an object type),
or a block; what stands before it tells which. Members belong to the body on top of the stack only, so methods of objects,
keys of nested values and labels are no members of the class around them. Every token is looked at once and every bracket is
opened and closed at most once: time grows with the text, whatever is in it.

Names: a computed key that is one identifier has its name, any other key (strings, numbers, expressions) is `unknown`. Private
names, signatures without a body and index signatures are no members. A class is known by its own name, or as the value of a
declarator by that one's; others have no rows. Open bodies end with the text, closing brackets without a partner are passed over.
"""

from __future__ import annotations

import re
from typing import NamedTuple

UNKNOWN = "unknown"
_TOKEN = re.compile(r"(?:[^\W\d]|[$#])[\w$]*|\d[\w.]*|=>|[=!]==?|<=|\.\.\.|\?\.|&&|\|\||\?\?|[^\s\w]")
_WORD = re.compile(r"(?:[^\W\d]|[$#])[\w$]*\Z")
_NAMED = re.compile(r"\s*(?:[^\W\d]|[$])")
_CLASS_HEAD = re.compile(r"\s*(?:[^\W\d]|[${<])")
_DECLARATOR = re.compile(r"(?:\b(?:const|let|var)\s+|(,)\s*)((?:[^\W\d]|\$)[\w$]*)\s*(?::[^=\n]+)?=\s*\Z")
CLOSES = {")": "(", "]": "[", "}": "{"}
# Words and marks of the language.
MODIFIERS = {"public", "private", "protected", "readonly", "override", "abstract", "static", "async", "get", "set", "declare", "accessor"}
BEFORE_VALUE = {
    "=", "(", ",", ":", "?", "[", "=>", "&&", "||", "??", "!", "...", "return", "new", "typeof", "extends", "await", "yield", "in", "of",
    "case", "throw", "void",
}
BEFORE_OBJECT = (BEFORE_VALUE | {"default", "|", "&", "<", "is", "as", "satisfies", "==", "===", "!=", "!=="}) - {"=>", "new"}
BEFORE_TYPE = {":", "|", "&", "=>", "<", ",", "?", "is", "keyof", "extends"}
GOES_ON = (BEFORE_OBJECT - {"void"}) | {"=>", "new", "+", "-", "*", "/", "%", "^", "~", ".", "?.", "{", "<=", "delete", "instanceof", "keyof", "infer"}
CONTINUES = {"in", "instanceof", "as", "satisfies", "extends", "is"}


class Found(NamedTuple):
    """A construct: where it begins, where its heading and where its body ends, and its groups."""

    begin: int
    end: int
    last: int
    groups: list[str]


class _Owner:
    """A class, interface or enum: from its heading to the end of its body."""

    def __init__(self, kind: str, begin: int, name: str, flag: str):
        self.kind, self.begin, self.name, self.flag = kind, begin, name, flag
        self.end, self.angle, self.named = begin, 0, False
        self.heritage: list[str] | None = None
        self.complete = False  # what follows names no parents
        self.members: list[str] = []

    def parents(self) -> list[str]:
        lists: list[list[str]] = [[]]
        for token in self.heritage or ():
            if token == "," and self.kind == "interface":
                lists.append([])
            else:
                lists[-1].append(token)
        return ["".join(tokens) for tokens in lists if tokens]


class _Frame:
    """An open bracket. `phase`, `words` and `begin` are those of the member that is being read."""

    def __init__(self, opener: str, kind: str, at: int = 0, owner: _Owner | None = None):
        self.opener, self.kind, self.at, self.owner = opener, kind, at, owner
        self.header: _Owner | None = None
        self.arrow = False  # the body of an arrow function
        self.decorated: int | None = None
        self.method: tuple | None = None  # this block is the body of that method
        self.content: list[str] | None = None  # tokens of a computed key
        self.reset()

    def reset(self) -> None:
        self.phase, self.begin, self.angle = "head", None, 0
        self.words: list[tuple[str, int]] = []
        self.pending: int | None = None


class Scopes:
    """`rows`: what was found, by kind; `declared`: offsets of names before a parenthesis that are no calls."""

    def __init__(self, marked: str):
        """`marked`: the text with comments blanked, and literals too but for a quotation mark where each begins."""
        self.rows: dict[str, list[Found]] = {k: [] for k in ("js_class", "js_interface", "js_enum", "js_method", "js_property")}
        self.declared: set[int] = set()
        self.text, self.prev, self.before = marked, "", ""
        self.after_arrow = False  # the bracket before closed the body of an arrow function, which nothing can go on from
        self.stack, self.braces = [_Frame("", "block")], 0
        end = 0
        for token in _TOKEN.finditer(marked):
            t, at = token.group(), token.start()
            self._step(t, at, marked.find("\n", end, at) >= 0)
            if t not in CLOSES:
                self.after_arrow = False
            self.before, self.prev, end = self.prev, t, token.end()
        while len(self.stack) > 1:
            self._close(len(marked))
        for found in self.rows.values():
            found.sort()

    def _step(self, t: str, at: int, fresh: bool) -> None:
        frame = self.stack[-1]
        if t in CLOSES:
            if t == "}":
                # Braces bound everything: brackets left open inside end with them.
                if self.braces:
                    while self.stack[-1].opener != "{":
                        self._close(at)
                    self._close(at)
            elif frame.opener == CLOSES[t]:
                self._close(at)
            return
        if frame.content is not None:
            frame.content.append(t)
        if frame.header is not None:
            self._heading(frame, t, at)
        elif frame.kind in ("class", "interface"):
            self._member(frame, t, at, fresh)
        else:
            if frame.kind == "enum":
                if frame.phase == "head" and _WORD.match(t):
                    frame.owner.members.append(t)
                frame.phase = "head" if t == "," else "value"
            elif frame.kind == "object":
                self._key(frame, t, at, fresh)
            elif t == "@" and frame.decorated is None:
                frame.decorated = at
            elif t == ";":
                frame.decorated = None
            self._plain(frame, t, at)

    def _plain(self, frame: _Frame, t: str, at: int) -> None:
        if t in ("class", "interface", "enum"):
            self._keyword(frame, t, at)
        elif t in ("(", "["):
            self._open(t, "group", at)
        elif t == "{":
            self._open(t, "object" if self.prev in BEFORE_OBJECT else "block", at).arrow = self.prev == "=>"

    def _open(self, opener: str, kind: str, at: int, owner: _Owner | None = None) -> _Frame:
        self.stack.append(_Frame(opener, kind, at, owner))
        self.braces += opener == "{"
        return self.stack[-1]

    def _keyword(self, frame: _Frame, t: str, at: int) -> None:
        after = at + len(t)
        if self.prev in (".", "?.") or not (_CLASS_HEAD if t == "class" else _NAMED).match(self.text, after):
            return
        flag = {"class": "abstract", "enum": "const"}.get(t, "") if self.prev in ("abstract", "const") else ""
        begin = self.text.rindex(flag, 0, at) if flag else at
        owner = _Owner(t, begin, "", flag)
        if t == "class":
            if (self.before if flag else self.prev) in BEFORE_VALUE:
                m = _DECLARATOR.search(self.text, max(0, at - 300), at)
                # A name after a comma is a declarator in a statement, elsewhere a parameter.
                if m and (m[1] is None or frame.kind == "block"):
                    owner.name = m[2]
                owner.named = True
            elif frame.decorated is not None:
                owner.begin = frame.decorated
        frame.decorated, frame.header = None, owner

    def _heading(self, frame: _Frame, t: str, at: int) -> None:
        owner = frame.header
        if t in ("(", "[") or (t == "{" and owner.angle > 0):
            if owner.heritage is not None and owner.angle == 0 and not owner.complete:
                owner.heritage.append(t)
            self._open(t, "group" if t != "{" else "object", at)
        elif t == "{":
            owner.end, frame.header = at, None
            self._open(t, owner.kind, at, owner)
        elif t == ";":
            frame.header = None
        elif t in "<>":
            owner.angle += 1 if t == "<" else -1
        elif owner.angle > 0:
            return
        elif t == "implements":
            owner.named = owner.complete = True
        elif t == "extends":
            owner.named = True
            owner.heritage = owner.heritage or []
        elif owner.heritage is not None:
            if not owner.complete:
                owner.heritage.append(t)
        elif not owner.named and _WORD.match(t):
            owner.name, owner.named = t, True

    def _ends_line(self, frame: _Frame, t: str) -> bool:
        """Does a new member begin with this first token of a line?"""
        if frame.angle > 0 or self.prev in GOES_ON:
            return False
        if _WORD.match(t):
            return t not in CONTINUES
        return t in '@"' or t[0].isdigit() or (t in "[*" and (frame.phase != "value" or self.after_arrow))

    def _member(self, frame: _Frame, t: str, at: int, fresh: bool) -> None:
        if frame.phase == "decorator":
            if t == "." or (self.prev in ("@", ".") and _WORD.match(t)):
                return
            if t == "(" and not fresh:
                self._open(t, "group", at)
                return
            frame.phase = "head"
        if fresh and frame.phase in ("value", "type", "tail") and self._ends_line(frame, t):
            frame.reset()
        if frame.phase == "head":
            self._head(frame, t, at, fresh)
            return
        if t == ";" or (t == "," and frame.kind == "interface" and frame.angle <= 0):
            frame.reset()
        elif frame.phase == "value":
            self._plain(frame, t, at)
        elif t in ("(", "["):
            self._open(t, "group", at)
        elif t in "<>":
            frame.angle += 1 if t == "<" else -1
        elif t == "=" and frame.phase == "type" and frame.angle <= 0:
            frame.phase = "value"
        elif t == "{":
            if frame.phase == "tail" and frame.kind == "class" and frame.angle <= 0 and self.prev not in BEFORE_TYPE:
                method = (frame.begin, [w for w, _ in frame.words], at)
                frame.reset()
                self._open(t, "block", at).method = method
            else:
                self._open(t, "object", at)

    def _head(self, frame: _Frame, t: str, at: int, fresh: bool) -> None:
        if frame.angle > 0 and t not in "<>":
            if t in ("(", "[", "{"):
                self._open(t, "group", at)
            return
        word = bool(_WORD.match(t))
        if fresh and frame.words and frame.words[-1][0] not in MODIFIERS and (word or t in '["*@' or t[0].isdigit()):
            self._property(frame)
            frame.reset()
        if frame.begin is None:
            frame.begin = at
        if word:
            frame.words.append((t, at))
        elif t == '"' or t[0].isdigit():
            frame.words.append((UNKNOWN, at))
        elif t == "@":
            frame.phase = "decorator"
        elif t == "[":
            self._open(t, "group", at).content = []
        elif t in "<>":
            frame.angle += 1 if t == "<" else -1
        elif t == "(":
            if frame.words:
                self.declared.add(frame.words[-1][1])
            frame.phase = "tail"
            self._open(t, "group", at)
        elif t in ":=":
            self._property(frame)
            frame.phase = "type" if t == ":" else "value"
        elif t in ";,":
            self._property(frame)
            frame.reset()
        elif t == "{":
            frame.reset()
            self._open(t, "block", at)

    def _property(self, frame: _Frame) -> None:
        if not frame.words or frame.words[-1][0].startswith("#") or frame.words[-1][0] == "":
            return
        name, at = frame.words[-1]
        if frame.kind == "interface":
            if name != UNKNOWN:
                frame.owner.members.append(name)
        elif frame.owner.name:
            self.rows["js_property"].append(Found(frame.begin, at, at, [name, frame.owner.name]))

    def _key(self, frame: _Frame, t: str, at: int, fresh: bool) -> None:
        """Keys of an object whose value is a function: they stand before a parenthesis and are no calls."""
        if frame.pending is not None:
            if t in "{:":
                self.declared.add(frame.pending)
            frame.pending = None
        if t in ";," or (fresh and frame.phase == "value" and self._ends_line(frame, t)):
            frame.reset()
        if t in ";,":
            return
        if frame.phase == "head" and _WORD.match(t):
            frame.words.append((t, at))
        elif frame.phase == "head" and t == "(" and frame.words:
            frame.phase, frame.words, frame.begin = "value", frame.words[-1:], -1  # until the closing one
        elif t != "*":
            frame.phase = "value"

    def _close(self, at: int) -> None:
        frame = self.stack.pop()
        self.braces -= frame.opener == "{"
        above, owner, self.after_arrow = self.stack[-1], frame.owner, frame.arrow
        if frame.kind in ("class", "interface") and frame.phase == "head":
            self._property(frame)
        if owner is not None and owner.name:
            parents = owner.parents()
            if owner.kind == "class":
                parent = parents[0] if parents else ""
                groups = [owner.flag, owner.name, parent if not parent or _WORD.match(parent) else "."]
            elif owner.kind == "interface":
                groups = [owner.name, ", ".join(parents), *owner.members]
            else:
                groups = [owner.flag, owner.name, *owner.members]
            self.rows[f"js_{owner.kind}"].append(Found(owner.begin, owner.end, at, groups))
        if frame.method is not None and above.owner is not None and above.owner.name:
            begin, words, end = frame.method
            name = words[-1] if words else UNKNOWN
            if not name.startswith("#"):
                flags = "".join(w + " " for w in words[:-1] if w in MODIFIERS)
                self.rows["js_method"].append(Found(begin, end, at, [flags, name, above.owner.name, str(above.owner.begin)]))
        if frame.content is not None:
            # A name in brackets; with a colon it is an index signature.
            inner = frame.content
            name = "" if ":" in inner else inner[0] if len(inner) == 1 and _WORD.match(inner[0]) else UNKNOWN
            above.words.append((name, frame.at))
        if above.kind == "object" and frame.opener == "(" and above.begin == -1:
            above.pending, above.begin = above.words[-1][1], None
