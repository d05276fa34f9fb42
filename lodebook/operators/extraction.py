"""Symbols, imports, exports, comments and calls of source files.

A small vectorised helper finds rule matches with their line numbers, which Spark's
regexp functions do not report. Everything that gives a match its meaning (names,
types, signatures, keyword filters, class members) is column work on its output.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodebook.functions import rules as R
from lodebook.operators import extractors
from lodebook.operators.extractors import REGISTRY, Registry
from lodebook.operators.ranges import innermost, spread
from lodebook.operators.scopes import Scopes
from lodebook.session import ship_package

FLUSH_ROWS = 20000
ORDER_TYPE = "decimal(21,0)"
ID_DIGITS = 21
OFFSET_DIGITS = 10
ARROW_TYPES = {
    "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
}
MATCH_SCHEMA = (
    "file_id {id}, language string, kind string, rule int, start int, line int, line_end int, "
    "column int, text string, groups array<string>, in_class boolean, decorators array<string>, "
    "error string"
)


_CLASS_LINE = re.compile(r"\s*class\s+\w+")


class FileFacts:
    """What several matches of a file need to know about its lines, found once and only if asked for."""

    def __init__(self, content: str):
        self.lines = content.split("\n")
        self.starts = list(accumulate([len(line) + 1 for line in self.lines], initial=0))

    def line_of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    @cached_property
    def indents(self) -> list[int]:
        return [len(line) - len(line.lstrip()) for line in self.lines]

    @cached_property
    def _braces(self) -> tuple[list[int], list[int], dict[int, list[int]]]:
        """Events in order: the line of each brace and the depth after it; the closing ones by depth."""
        at, depths, closing, depth = [], [], {}, 0
        for number, line in enumerate(self.lines):
            for brace in re.findall(r"[{}]", line):
                depth += 1 if brace == "{" else -1
                if brace == "}":
                    closing.setdefault(depth, []).append(len(at))
                at.append(number)
                depths.append(depth)
        return at, depths, closing

    def block_end(self, first: int) -> int:
        """Last line of a block: matching brace if the first line opens one, else the dedent."""
        if "{" in self.lines[first]:
            at, depths, closing = self._braces
            event = bisect.bisect_left(at, first)
            base = depths[event - 1] if event else 0
            while depths[event] < (depths[event - 1] if event else 0):
                event += 1  # closing braces before the first opening one
            same = closing.get(base, [])
            place = bisect.bisect_left(same, event)
            return at[same[place]] + 1 if place < len(same) else len(self.lines)
        base = self.indents[first]
        for number in range(first + 2, min(first + 11, len(self.lines))):
            if self.indents[number] < len(self.lines[number]) and self.indents[number] <= base:
                return number
        return self._next_code(first + 11, base) or min(first + 11, len(self.lines))

    def _next_code(self, first: int, base: int) -> int | None:
        """The first line from `first` on that is not blank and indented no deeper than `base`."""
        best = None
        for indent, numbers in self._by_indent.items():
            if indent <= base:
                place = bisect.bisect_left(numbers, first)
                if place < len(numbers) and (best is None or numbers[place] < best):
                    best = numbers[place]
        return best

    @cached_property
    def _by_indent(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for number, indent in enumerate(self.indents):
            if indent < len(self.lines[number]):
                found.setdefault(indent, []).append(number)
        return found

    @cached_property
    def _next_shallow(self) -> list[int]:
        """For each code line the next code line that is indented no deeper (comment lines aside)."""
        lines, indents, end = self.lines, self.indents, len(self.lines)
        after, stack = [end] * end, []
        for number in range(end - 1, -1, -1):
            line, indent = lines[number], indents[number]
            if indent == len(line) or line[indent] == "#":
                continue
            while stack and indents[stack[-1]] > indent:
                stack.pop()
            if stack:
                after[number] = stack[-1]
            stack.append(number)
        return after

    def indent_end(self, first: int) -> int:
        """Last line before the next code line that is indented no deeper than the first."""
        return self._next_shallow[first]

    @cached_property
    def _class_above(self) -> list[int | None]:
        """Indent of the nearest class line above each line, with no top-level line between."""
        found, indent = [], None
        for number, line in enumerate(self.lines):
            found.append(indent)
            if "class" in line and _CLASS_LINE.match(line):
                indent = self.indents[number]
            elif self.indents[number] == 0 and line and line[0] != "@":
                indent = None
        return found

    def inside_class(self, first: int) -> bool:
        indent = self._class_above[first]
        return indent is not None and self.indents[first] > indent

    def decorators(self, first: int) -> list[str]:
        found: list[str] = []
        for number in range(first - 1, -1, -1):
            line = self.lines[number].strip()
            if line.startswith("@"):
                found.insert(0, line)
            elif line:
                break
        return found


def _statement_end(text: str, at: int, braces_only: bool) -> int:
    """Offset of the end of a statement or of its `{...}` body."""
    depth = 0
    for mark in re.compile(r"[()\[\]{};]|\n(?!\s*[.|&?:+])").finditer(text, at):
        char = mark.group()[0]
        if char in "([{":
            depth += 1
        elif char in ")]}":
            depth -= 1
            if depth < 0 or (depth == 0 and char == "}" and (braces_only or "{" in text[at:at + 3])):
                return mark.start()
        elif depth == 0 and (char == ";" or not braces_only) and text[at:mark.start()].strip():
            return mark.start()
    return len(text)


_JS_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|[`{}/]", re.S)
_JS_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
_JS_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else))\s*\Z|\A\s*\Z")


def mask_js(text: str) -> tuple[str, str]:
    """The text with strings, comments and regular expressions blanked; `${...}` in templates stays.

    In the second text a quotation mark stands where each literal begins, and parentheses around what a template holds.
    """
    out, literals, at, keep = [], [], 0, 0
    templates: list[int] = []  # depth of braces at which each open template goes on
    depth = 0

    def blank(start: int, end: int) -> None:
        nonlocal keep
        out.append(text[keep:start])
        out.append(re.sub(r"[^\n]", " ", text[start:end]))
        if text[start:start + 2] not in ("//", "/*"):
            literals.append((len(out) - 1, ")" if text[start] == "}" else '"', "(" if text[start] in "`}" and text[end - 2:end] == "${" else ""))
        keep = end

    while True:
        mark = _JS_TOKEN.search(text, at)
        if mark is None:
            break
        token, at = mark.group(), mark.end()
        if token == "`" or (token == "}" and templates and templates[-1] == depth):
            if token == "}":
                templates.pop()
            end = _JS_TEMPLATE.match(text, at).end()
            if text.startswith("${", end):
                blank(mark.start(), end + 2)
                templates.append(depth)
                at = end + 2
            else:
                at = min(end + 1, len(text))
                blank(mark.start(), at)
        elif token == "{":
            depth += 1
        elif token == "}":
            depth -= 1
        elif token == "/":
            literal = _JS_REGEX.match(text, mark.start())
            if literal and _BEFORE_REGEX.search(text[max(0, mark.start() - 20):mark.start()]):
                at = literal.end()
                blank(mark.start(), at)
        else:
            blank(mark.start(), at)
    out.append(text[keep:])
    masked = "".join(out)
    for k, first, last in literals:
        out[k] = first + out[k][1:len(out[k]) - len(last)] + last
    return masked, "".join(out)


def declarator_commas(masked: str) -> set[int]:
    """Offsets of the commas between the declarators of const, let and var statements."""
    found: set[int] = set()
    frames = [False]
    for mark in re.finditer(r"[()\[\]{};,]|\b(?:const|let|var)\b|(?<![,=+\-*/&|?:(\s])[ \t]*\n(?!\s*[,.=+\-*/&|?:)])", masked):
        token = mark.group()
        if token in "([{":
            frames.append(False)
        elif token in ")]}":
            if len(frames) > 1:
                frames.pop()
        elif token == ",":
            if frames[-1]:
                found.add(mark.start())
        elif token == ";" or token.endswith("\n"):
            frames[-1] = False
        else:
            frames[-1] = True
    return found


PARAMETERS = r"\([^)]*\)"


@lru_cache(maxsize=None)
def _anchor_patterns(pattern: str, anchor: R.Anchor) -> tuple[re.Pattern, ...]:
    """The head of the pattern up to the parameters, its runs, their ends, what follows the parameters, what may precede."""
    head = pattern[:pattern.index(PARAMETERS)] + r"\("
    runs = rf"(?<![{anchor.run}])[{anchor.run}]++"
    return tuple(re.compile(p, re.M | re.A) for p in (
        head, runs, (anchor.last or rf"(?<=[{anchor.run}])") + r"\(", anchor.tail, anchor.lead or r"(?!)"))


def anchored(regex: re.Pattern, anchor: R.Anchor, content: str) -> Iterator[re.Match]:
    """The matches of a pattern with an anchor, in one pass.

    Every run of words is looked at once, and only if it ends at a parenthesis, or at the last word that the pattern
    needs before one, and the right things follow the parameters. Text without such runs costs one pass.
    """
    head, runs, last, tail, lead = _anchor_patterns(regex.pattern, anchor)
    end, close = 0, -1  # end of the match before, the closing parenthesis after a run
    opened = last.search(content)
    for run in runs.finditer(content):
        while opened and opened.start() < run.start():
            opened = last.search(content, opened.start() + 1)
        if opened is None:
            return
        if opened.start() > run.end() or (not anchor.last and opened.start() != run.end()):
            continue
        if close < opened.end() - 1:
            close = content.find(")", opened.end() - 1)
            if close < 0:
                return
        rest = tail.match(content, close + 1)
        at = max(run.start(), end)
        if rest is None or at >= opened.end():
            continue
        found = None
        if anchor.lead and at == run.start() and content[at - 1:at] == ">":
            prefix = lead.search(content, max(content.rfind(">", 0, at - 1) + 1, end), at)
            found = head.match(content, prefix.start(), opened.end()) if prefix else None
        found = found or head.search(content, at, opened.end())
        match = regex.match(content, found.start(), rest.end()) if found else None
        if match:
            end = match.end()
            yield match


def file_matches(file_id, language: str | None, content: str, rules) -> list[tuple]:
    """All rule matches of one file. `rules` holds (index, rule, compiled pattern)."""
    facts = FileFacts(content)
    starts = facts.starts
    masked, commas, scopes = content, None, None
    if any(rule.masked for _, rule, _ in rules):
        masked, marked = mask_js(content)
        if any(rule.ends == "scope" or rule.kind == "js_call" for _, rule, _ in rules):
            scopes = Scopes(marked)
    rows: list[tuple] = []
    for index, rule, regex in rules:
        kind, _, ends, is_masked, needs = rule
        if ends == "scope":
            for begin, end, last, groups in scopes.rows[kind]:
                first = facts.line_of(begin)
                rows.append((file_id, language, kind, index, begin, first + 1, bisect.bisect_right(starts, last),
                             begin - starts[first] + 1, content[begin:end].rstrip(), groups, False, [], None))
            continue
        searched = masked if is_masked else content
        if needs not in searched:
            continue
        anchor = R.ANCHORS.get((language, rule.pattern))
        found = anchored(regex, anchor, content) if anchor else regex.finditer(searched)
        for match in found:
            begin = match.start()
            if is_masked and masked[begin:begin + 1] == ",":
                if commas is None:
                    commas = declarator_commas(masked)
                if begin not in commas:
                    continue
                begin = match.start(1)
            if kind == "js_call" and begin in scopes.declared:
                continue
            first = bisect.bisect_right(starts, begin) - 1
            groups = list(match.groups(""))
            last, in_class, marks = first + 1, False, []
            if ends == "block":
                last = facts.block_end(first)
            elif ends == "indent":
                last = facts.indent_end(first)
                in_class = len(groups[0]) > 0 and facts.inside_class(first)
                marks = facts.decorators(first)
            elif ends in ("body", "expression"):
                # Leading indentation is no part of the construct.
                end = _statement_end(masked, match.end(), ends == "body")
                last = bisect.bisect_right(starts, end)
            rows.append((file_id, language, kind, index, begin, first + 1, last, begin - starts[first] + 1,
                         content[begin:match.end()] if is_masked else match.group(), groups, in_class, marks, None))
    return rows


@lru_cache(maxsize=None)
def compiled_rules(language: str) -> list[tuple[int, R.Rule, re.Pattern]]:
    rules = R.rules_by_language()
    return [(i, rule, re.compile(rule.pattern, re.M | re.A)) for i, rule in enumerate(rules.get(language, rules[""]))]


def _has_own_rules(language: str) -> bool:
    return language in R.rules_by_language() and language != ""


def match_chain(registry: Registry, kinds: frozenset[str] | None):
    """A function of (file_id, language, content): what the first extractor that does not fail finds.

    If all fail, the comments are left, and the first failure as an error.
    """
    chains: dict[str, list] = {}

    def wanted(language: str) -> list:
        rules = compiled_rules(language)
        return rules if kinds is None else [r for r in rules if r[1].kind in kinds]

    def best(file_id, language: str | None, content: str) -> list[tuple]:
        name, problem = language or "", None
        if name not in chains:
            chains[name] = registry.chain(name, 10 if _has_own_rules(name) else 1)
        for extractor in chains[name]:
            try:
                if extractor is None:
                    return file_matches(file_id, language, content, wanted(name))
                return extractors.rows_of(extractor, file_id, language, content, FileFacts(content), kinds)
            except Exception as failure:  # one bad file is reported and the rest goes on
                problem = problem or failure
        left = [(file_id, language, "error", -1, 0, 0, 0, 0, "", [], False, [], repr(problem))]
        comments = [r for r in compiled_rules("") if r[1].kind == "comment" and (kinds is None or "comment" in kinds)]
        try:
            left += file_matches(file_id, language, content, comments)
        except Exception:  # a text that cannot even be scanned for comments has its error only
            pass
        return left

    return best


def _match_finder(schema: pa.Schema, kinds: frozenset[str] | None, registry: Registry):
    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        best = match_chain(registry, kinds)
        for batch in batches:
            for file_id, language, content in zip(*[column.to_pylist() for column in batch.columns]):
                rows.extend(best(file_id, language, content))
                if len(rows) >= FLUSH_ROWS:
                    yield to_batch(rows)
                    rows = []
        if rows:
            yield to_batch(rows)

    return find


def find_matches(files: DataFrame, kinds: tuple[str, ...] | None = None, registry: Registry | None = None) -> DataFrame:
    """One row per rule match. Narrow: no shuffle, files stay where they were read.

    With `kinds` only the rules of these kinds are run; rules keep their numbers. `registry` has added extractors, as they
    are now; by default the common one.
    """
    ship_package(files.sparkSession)
    id_type = files.schema["file_id"].dataType.simpleString()
    schema = StructType.fromDDL(MATCH_SCHEMA.format(id=id_type))
    arrow = pa.schema([
        pa.field(f.name, ARROW_TYPES.get(f.dataType.simpleString(), pa.string())) for f in schema.fields])
    return files.select("file_id", "language", "content").mapInArrow(_match_finder(
        arrow, None if kinds is None else frozenset(kinds), Registry(list((registry or REGISTRY).extractors))), schema)


def _group(n: int) -> Column:
    return F.coalesce(F.get("groups", F.lit(n)), F.lit(""))


def order_of(identifier: Column) -> Column:
    """The number inside a symbol id: the extraction order within the file."""
    return F.substring_index(identifier, "#", -1).cast(ORDER_TYPE)


def order_text(identifier: str) -> Column:
    """That number as the digits in the id, which sort as the number does."""
    return F.substring_index(F.col(identifier), "#", -1)


def symbol_id_of(file_id: Column, order: Column) -> Column:
    return F.concat(file_id.cast("string"), F.lit("#"), F.lpad(order.cast("string"), ID_DIGITS, "0"))


def _id_at(major: Column, minor: Column) -> Column:
    """`symbol_id_of` a number that sorts by `major`, then by an offset in the file; without decimal arithmetic."""
    return F.concat(F.col("file_id").cast("string"), F.lit("#"), *(
        F.lpad(part.cast("string"), digits, "0") for part, digits in ((major, ID_DIGITS - OFFSET_DIGITS), (minor, OFFSET_DIGITS))))


def _trimmed_list(text: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def _python_params(params: Column) -> Column:
    names = F.transform(F.split(params, ","), lambda p: F.trim(F.regexp_extract(p, r"^([^=:]*)", 1)))
    return F.filter(names, lambda p: ~p.isin("", "self", "cls"))


def _js_params(params: Column) -> Column:
    return F.transform(
        _trimmed_list(params),
        lambda p: F.when(p.rlike(r"^\.\.\.[\w$]+"), F.regexp_extract(p, r"^(\.\.\.[\w$]+)", 1))
        .when(p.rlike(r"^[\w$]+\s*\??\s*(:[^=]*)?$"), F.regexp_extract(p, r"^([\w$]+)", 1))
        .otherwise(F.lit("...")),
    )


def _js_signature_params(params: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(_js_params(params), ", "), F.lit(")"))


SYMBOL_KINDS = (
    "function class variable py_def py_lambda py_class js_function js_function_value js_arrow "
    "js_class js_interface js_type js_enum"
).split()

# What symbols_of, calls_of, imports_exports_of and comments_of read.
SYMBOL_RULES = (*SYMBOL_KINDS, "js_method")
CALL_RULES = ("js_call js_call_member js_call_new call_function call_method call_new "
              "py_call_function py_call_method py_call_new").split()
PROPERTY_RULES = ("py_property", "js_property")
IMPORT_RULES = "import py_import py_from js_import export py_all js_export js_export_list js_export_default".split()


def _pick(kind_values: dict[str, Column]) -> Column:
    result = None
    for kind, value in kind_values.items():
        result = F.when(F.col("kind") == kind, value) if result is None else result.when(F.col("kind") == kind, value)
    return result


def symbols_of(matches: DataFrame) -> DataFrame:
    """symbol_id, file_id, name, type, line_start, line_end, signature, metadata.

    `symbol_id` sorts in extraction order within a file.
    """
    g0, g1, g2, g3, g4 = (_group(i) for i in range(5))
    spaced = F.trim(F.regexp_replace("text", r"\s+", " "))
    py_async, js_async = F.when(g1 != "", "async ").otherwise(""), F.when(g1 != "", "async ").otherwise("")
    name = _pick({
        "function": g0, "class": g0, "variable": g0, "py_def": g2, "py_lambda": g0, "py_class": g1,
        "js_function": g2, "js_function_value": g0, "js_arrow": g0, "js_class": g1,
        "js_interface": g0, "js_type": g0, "js_enum": g1,
    })
    kind_type = _pick({
        "function": F.lit("function"), "class": F.lit("class"), "variable": F.lit("variable"),
        "py_def": F.when(F.col("in_class"), "method").otherwise("function"),
        "py_lambda": F.lit("function"), "py_class": F.lit("class"),
        "js_function": F.lit("function"), "js_function_value": F.lit("function"), "js_arrow": F.lit("function"),
        "js_class": F.lit("class"), "js_interface": F.lit("interface"),
        "js_type": F.lit("type"), "js_enum": F.lit("enum"),
    })
    arrow_params = F.when(g3 != "", g3).otherwise(g2)
    extends = F.when(g2 != "", F.concat(F.lit(" extends "), F.when(g2.contains("."), "unknown").otherwise(g2))).otherwise("")
    signature = _pick({
        "function": spaced, "class": spaced, "variable": spaced,
        "py_def": F.concat(py_async, F.lit("def "), g2, F.lit("("), g3, F.lit(")"),
                           F.when(g4 != "", F.concat(F.lit(" -> "), g4)).otherwise("")),
        "py_lambda": F.concat(g0, F.lit(" = lambda "), g1),
        "py_class": F.concat(F.lit("class "), g1, F.when(g2 != "", F.concat(F.lit("("), g2, F.lit(")"))).otherwise("")),
        "js_function": F.concat(F.when(g0 != "", "async ").otherwise(""), F.lit("function "), g2, _js_signature_params(g3)),
        "js_function_value": F.concat(js_async, F.lit("function "), g0, _js_signature_params(g3)),
        "js_arrow": F.concat(F.lit("const "), g0, F.lit(" = "), js_async, _js_signature_params(arrow_params), F.lit(" => ...")),
        "js_class": F.concat(F.lit("class "), g1, extends),
        "js_interface": F.concat(
            F.lit("interface "), g0,
            F.when(g1 != "", F.concat(F.lit(" extends "), F.array_join(_trimmed_list(g1), ", "))).otherwise("")),
        "js_type": F.concat(F.lit("type "), g0),
        "js_enum": F.concat(F.lit("enum "), g1),
    })
    raw = F.to_json(F.struct(F.col("text").alias("raw")))
    members = F.slice("groups", F.lit(3), F.greatest(F.size("groups") - 2, F.lit(0)))
    metadata = _pick({
        "function": raw, "class": raw, "variable": raw,
        "py_def": F.to_json(F.struct(
            (g1 != "").alias("async"), _python_params(g3).alias("params"), F.trim(g4).alias("returnType"),
            F.col("decorators"), F.length(g0).alias("indent"))),
        "py_lambda": F.to_json(F.struct(F.lit(True).alias("lambda"), _python_params(g1).alias("params"))),
        "py_class": F.to_json(F.struct(
            _trimmed_list(g2).alias("bases"), F.col("decorators"), F.length(g0).alias("indent"))),
        "js_function": F.to_json(F.struct(
            (g0 != "").alias("async"), (g1 != "").alias("generator"), F.size(_js_params(g3)).alias("params"))),
        "js_function_value": F.to_json(F.struct(
            (g1 != "").alias("async"), (g2 != "").alias("generator"), F.size(_js_params(g3)).alias("params"))),
        "js_arrow": F.to_json(F.struct(
            (g1 != "").alias("async"), F.lit(True).alias("arrow"), F.size(_js_params(arrow_params)).alias("params"))),
        "js_class": F.to_json(F.struct((g2 != "").alias("extends"), (g0 != "").alias("abstract"))),
        "js_interface": F.to_json(F.struct(members.alias("properties"), F.size(_trimmed_list(g1)).alias("extends"))),
        "js_type": F.lit("{}"),
        "js_enum": F.to_json(F.struct(members.alias("members"), (g0 != "").alias("const"))),
    })
    # JavaScript is numbered by position; a class comes after its methods, hence the odd number.
    js = F.col("kind").startswith("js_")
    plain = matches.filter(F.col("kind").isin(SYMBOL_KINDS)).select(
        _id_at(F.when(js, F.col("start") * 2 + 1).otherwise(F.col("rule")), F.when(js, F.lit(0)).otherwise(F.col("start"))).alias("symbol_id"),
        "file_id", name.alias("name"), kind_type.alias("type"),
        F.col("line").alias("line_start"), F.col("line_end"), signature.alias("signature"),
        F.lit(None).cast("string").alias("documentation"), metadata.alias("metadata"),
    ).filter(F.col("name") != "")
    return plain.unionByName(_js_methods(matches))


def _js_methods(matches: DataFrame) -> DataFrame:
    """Methods are named `Class.method` after the class whose body they stand in."""
    found = matches.filter(F.col("kind") == "js_method").select(
        "file_id", "line", "line_end", "start", _group(1).alias("method"), _group(0).alias("flags"),
        _group(2).alias("class_name"), _group(3).cast("long").alias("class_start"))
    flags = F.col("flags")

    def flag(word: str) -> Column:
        return F.concat(F.lit(" "), flags).contains(f" {word} ")

    kind = (
        F.when(F.col("method") == "constructor", "constructor").when(flag("get"), "get")
        .when(flag("set"), "set").otherwise("method")
    )
    return found.select(
        _id_at(F.col("class_start") * 2, F.col("start")).alias("symbol_id"),
        "file_id", F.concat_ws(".", "class_name", "method").alias("name"), F.lit("method").alias("type"),
        F.col("line").alias("line_start"), "line_end",
        F.concat(F.when(flag("static"), "static ").otherwise(""), F.when(flag("async"), "async ").otherwise(""),
                 F.col("method"), F.lit("()")).alias("signature"),
        F.lit(None).cast("string").alias("documentation"),
        F.to_json(F.struct(
            F.col("class_name").alias("className"), flag("static").alias("static"), flag("async").alias("async"),
            kind.alias("kind"))).alias("metadata"),
    )


def calls_of(matches: DataFrame) -> DataFrame:
    """call_id, file_id, callee_name, call_type, line_number, column_number."""
    g0, g1 = _group(0), _group(1)
    found = matches.filter(
        (F.col("kind").isin("call_function", "call_new") & ~g0.isin(R.CALL_KEYWORDS))
        | (F.col("kind") == "py_call_function") & ~g0.isin(R.PYTHON_KEYWORDS)
        | (F.col("kind") == "js_call") & ~g0.isin(R.JS_KEYWORDS)
        | F.col("kind").isin("call_method", "py_call_method", "py_call_new", "js_call_member", "js_call_new")
    )
    member = F.col("kind").isin("call_method", "py_call_method")
    name = (
        F.when(member, F.concat_ws(".", g0, g1))
        .when(F.col("kind") == "js_call_member",
              F.concat_ws(".", F.when(g0.isin("", "this", "super"), "unknown").otherwise(g0), g1))
        .otherwise(g0)
    )
    call_type = (
        F.when(F.col("kind").isin("py_call_new", "js_call_new"), "constructor")
        .when(F.col("kind").startswith("call_") & F.col("text").startswith("new"), "constructor")
        .when(member | (F.col("kind") == "js_call_member"), "method")
        .otherwise("function")
    )
    column = F.when(F.col("kind").startswith("js_"), F.col("column") - 1).otherwise(F.col("column"))
    return found.select(
        _id_at(F.col("rule"), F.col("start")).alias("call_id"),
        "file_id", name.alias("callee_name"), call_type.alias("call_type"),
        F.col("line").alias("line_number"), F.nullif(column, F.lit(0)).alias("column_number"),
    )


def imports_exports_of(matches: DataFrame) -> DataFrame:
    """file_id, imports, exports: lists in rule order; one row per file that has any."""
    g0 = _group(0)
    names = _pick({
        "import": F.filter(F.array(g0, _group(1)), lambda x: x != ""),
        "py_import": F.transform(_trimmed_list(g0), lambda m: F.regexp_extract(m, r"^(\S+)", 1)),
        "py_from": F.array(g0),
        "js_import": F.array(g0),
        "export": F.array(g0),
        "py_all": F.regexp_extract_all(g0, F.lit(r"['\"](\w+)['\"]"), F.lit(1)),
        "js_export": F.array(g0),
        "js_export_list": F.transform(
            _trimmed_list(g0), lambda s: F.regexp_extract(s, r"([\w$]+)\s*$", 1)),
        "js_export_default": F.array(F.lit("default")),
    })
    is_import = F.col("kind").isin("import", "py_import", "py_from", "js_import")
    by_position = F.when(F.col("kind").startswith("js_"), F.lit(0)).otherwise(F.col("rule"))
    listed = matches.withColumn("names", names).filter("names IS NOT NULL").select(
        "file_id", is_import.alias("is_import"),
        F.struct(by_position.alias("rule"), F.col("start"), F.col("names")).alias("entry"),
    )

    def in_order(condition: Column) -> Column:
        entries = F.sort_array(F.collect_list(F.when(condition, F.col("entry"))))
        return F.flatten(F.transform(entries, lambda e: e["names"]))

    return listed.groupBy("file_id").agg(
        in_order(F.col("is_import")).alias("imports"), in_order(~F.col("is_import")).alias("exports"))


def comments_of(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("kind") == "comment").select(
        "file_id", F.col("line").alias("line_number"), F.rtrim(F.col("text")).alias("comment"))


def class_members(matches: DataFrame, symbols: DataFrame, tasks: int | None = None) -> DataFrame:
    """symbol_id of a class with the names of its methods and properties, in the order of the text; in so many `tasks`."""
    classes = symbols.filter(F.col("type") == "class").select(
        "file_id", F.col("line_start").alias("range_start"), F.col("line_end").alias("range_end"),
        F.col("symbol_id").alias("class_id"))
    methods = symbols.filter(F.col("type") == "method").select(
        "file_id", F.col("line_start").alias("line"),
        F.element_at(F.split("name", r"\."), -1).alias("member"), F.lit("m").alias("role"), order_of(F.col("symbol_id")).alias("place"))
    properties = matches.filter(
        F.col("kind").isin("py_property", "js_property") & ~_group(0).isin(R.NO_PROPERTIES)
    ).select("file_id", "line", _group(0).alias("member"), F.lit("p").alias("role"), F.col("start").cast(ORDER_TYPE).alias("place"))
    owned = innermost(
        methods.unionByName(properties), classes, ["class_id"], row_id=["file_id", "line", "role", "member", "place"], tasks=tasks)

    def names(role: str) -> Column:
        entries = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("line", "place", "member"))))
        return F.transform(entries, lambda e: e["member"])

    owned = spread(owned.withColumnRenamed("class_id", "symbol_id"), tasks, "symbol_id")
    return owned.groupBy("symbol_id").agg(
        names("m").alias("methods"), names("p").alias("properties")
    ).withColumn("properties", F.array_except("properties", "methods"))


def with_members(symbols: DataFrame, members: DataFrame, tasks: int | None = None) -> DataFrame:
    """Class members merged into the JSON metadata of their class."""
    added = F.to_json(F.struct("methods", "properties"))
    merged = F.when(F.col("methods").isNull(), F.col("metadata")).otherwise(
        F.concat(F.rtrim(F.col("metadata"), F.lit("}")), F.lit(","), F.substring(added, 2, 2147483647)))
    return spread(symbols, tasks, "symbol_id").join(members, "symbol_id", "left").withColumn("metadata", merged).drop("methods", "properties")


def structure_of(symbols: DataFrame) -> DataFrame:
    """Per file: category -> [{name, line, signature}], empty categories left out."""
    pairs = [F.lit(x) for item in R.CATEGORIES.items() for x in item]
    category = F.coalesce(F.element_at(F.create_map(*pairs), F.col("type")), F.lit("other"))
    entry = F.struct(
        "symbol_id", "name", F.col("line_start").alias("line"),
        F.coalesce("signature", F.lit("")).alias("signature"))
    per_category = symbols.groupBy("file_id", category.alias("category")).agg(
        F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(e["name"].alias("name"), e["line"].alias("line"), e["signature"].alias("signature")),
        ).alias("details"))
    return per_category.groupBy("file_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "details")))).alias("structure"))
