import random
import re
import time

import pytest

from lodebook.functions import rules as R
from lodebook.operators import extraction as X
from lodebook.operators import resolve

TYPESCRIPT = """\
import React, { useState } from 'react';
import './style.css';
// fake(1)
class TestClass extends Base {
  value = 0;
  static async add(item, qty = 1) {
    const total = compute(item.price, "x(1)");
    if (total > 3) { this.save(); }
    return new Order(total);
  }
  get size() { return this.items.length; }
}
export const arrowFunction = async (a, {b}, ...c) => {
  await console.log(a);
};
const short = x => helper(x);
async function testFunction(a: number, b?: string): Promise<void> {
  arrowFunction(a);
}
export interface TestInterface extends A, B {
  x: number;
}
type Id = string | number;
export enum Color { Red, Green }
const Made = class extends TestClass {
  run() { return 1; }
};
export { testFunction as t };
export default TestClass;
"""
PYTHON = '''\
#!/usr/bin/env python
import os, sys as system
import json
from a.b import c
__all__ = ["X", 'y']

@deco
class PythonClass(Base, object):
    """Doc"""
    kind = 1

    @staticmethod
    def method(self, a: int = 1) -> str:
        return helper(a).strip()

    async def other(cls):
        pass


def python_function(x, y):
    # note
    f = lambda q: q + 1
    return PythonClass(x)

async def async_function():
    print(1)
'''


@pytest.fixture(scope="module")
def matches(spark):
    rows = [
        ("ts", "typescript", TYPESCRIPT), ("py", "python", PYTHON),
        ("go", "go", "package m\nfunc (s *Server) Start(a int) error {\n  fmt.Println(a)\n}\ntype Server struct {\n  a int\n}\n"),
        ("rs", "rust", "use std::fmt;\npub struct P<T> { x: T }\nimpl P {\n  pub fn go(&self) -> i32 { 1 }\n}\n"),
        ("none", None, "function foo\n  bar(1)\n\nclass Baz\nlet v = 1"),
        ("rb", "ruby", "require 'set'\nclass A < B\n  def ok?\n    1\n  end\nend\n"),
    ]
    files = spark.createDataFrame(rows, "file_id string, language string, content string")
    return X.find_matches(files).cache()


def symbols(matches, file_id):
    found = X.symbols_of(matches).filter(f"file_id = '{file_id}'").orderBy("symbol_id").collect()
    return [(r.name, r.type, r.line_start, r.line_end, r.signature) for r in found]


def test_typescript_symbols(matches):
    assert symbols(matches, "ts") == [
        ("TestClass.add", "method", 6, 10, "static async add()"),
        ("TestClass.size", "method", 11, 11, "size()"),
        ("TestClass", "class", 4, 12, "class TestClass extends Base"),
        ("arrowFunction", "function", 13, 15, "const arrowFunction = async (a, ..., ...c) => ..."),
        ("short", "function", 16, 16, "const short = (x) => ..."),
        ("testFunction", "function", 17, 19, "async function testFunction(a, b)"),
        ("TestInterface", "interface", 20, 22, "interface TestInterface extends A, B"),
        ("Id", "type", 23, 23, "type Id"),
        ("Color", "enum", 24, 24, "enum Color"),
        ("Made.run", "method", 26, 26, "run()"),
        ("Made", "class", 25, 27, "class Made extends TestClass"),
    ]


def test_typescript_calls_imports_exports(matches):
    calls = {(r.callee_name, r.call_type, r.line_number) for r in X.calls_of(matches).filter("file_id = 'ts'").collect()}
    assert calls == {
        ("compute", "function", 7), ("unknown.save", "method", 8), ("Order", "constructor", 9),
        ("console.log", "method", 14), ("helper", "function", 16), ("arrowFunction", "function", 18)}
    lists = {r.file_id: (r.imports, r.exports) for r in X.imports_exports_of(matches).collect()}
    assert lists["ts"] == (["react", "./style.css"], ["TestInterface", "Color", "t", "default"])
    assert lists["py"] == (["os", "sys", "json", "a.b"], ["X", "y"])
    assert lists["rs"] == (["std::fmt"], []) and lists["rb"] == (["set"], [])


def test_python_symbols(matches):
    assert symbols(matches, "py") == [
        ("method", "method", 13, 15, "def method(self, a: int = 1) -> str"),
        ("other", "method", 16, 19, "async def other(cls)"),
        ("python_function", "function", 20, 24, "def python_function(x, y)"),
        ("async_function", "function", 25, 27, "async def async_function()"),
        ("f", "function", 22, 22, "f = lambda q"),
        ("PythonClass", "class", 8, 19, "class PythonClass(Base, object)"),
    ]


def test_python_calls_are_not_deduplicated(matches):
    calls = [(r.callee_name, r.call_type) for r in X.calls_of(matches).filter("file_id = 'py' AND line_number = 23").collect()]
    assert sorted(calls) == [("PythonClass", "constructor"), ("PythonClass", "function")]
    assert X.calls_of(matches).filter("callee_name = 'print'").isEmpty()


def test_class_members_in_metadata(matches):
    plain = X.symbols_of(matches)
    merged = X.with_members(plain, X.class_members(matches, plain))
    meta = {r.name: r.metadata for r in merged.collect()}
    assert meta["PythonClass"] == '{"bases":["Base","object"],"decorators":["@deco"],"indent":0,"methods":["method","other"],"properties":["kind"]}'
    assert meta["TestClass"] == '{"extends":true,"abstract":false,"methods":["add","size"],"properties":["value"]}'
    assert meta["method"].startswith('{"async":false,"params":["a"],"returnType":"str","decorators":["@staticmethod"]')
    assert merged.count() == plain.count()


def test_pattern_languages(matches):
    assert symbols(matches, "go") == [
        ("Start", "function", 2, 4, "func (s *Server) Start(a int) error"), ("Server", "class", 5, 7, "type Server struct {")]
    assert [s[:3] for s in symbols(matches, "rs")] == [("go", "function", 4), ("P", "class", 2), ("P", "class", 3)]
    assert [s[:3] for s in symbols(matches, "rb")] == [("ok", "function", 3), ("A", "class", 2)] or \
        [s[:3] for s in symbols(matches, "rb")] == [("ok?", "function", 3), ("A", "class", 2)]
    assert [s[:3] for s in symbols(matches, "none")] == [("foo", "function", 1), ("Baz", "class", 4), ("v", "variable", 5)]


def test_comments(matches):
    found = {(r.file_id, r.line_number, r.comment) for r in X.comments_of(matches).collect()}
    assert ("ts", 3, "// fake(1)") in found and ("py", 21, "# note") in found
    assert not any(c.startswith("#!") for _, _, c in found)


def test_structure(matches):
    found = {r.file_id: r.structure for r in X.structure_of(X.symbols_of(matches)).collect()}
    assert set(found["py"]) == {"functions", "methods", "classes"}
    assert [(d.name, d.line) for d in found["py"]["functions"]] == [("python_function", 20), ("async_function", 25), ("f", 22)]


def test_bad_file_is_reported(spark, monkeypatch):
    files = spark.createDataFrame([("x", "python", None), ("y", "python", "def a(): pass")], "file_id string, language string, content string")
    rows = {r.file_id: (r.kind, r.error is not None) for r in X.find_matches(files).filter("kind IN ('error', 'py_def')").collect()}
    assert rows == {"x": ("error", True), "y": ("py_def", False)}


def test_all_patterns_compile():
    for language, table in R.rules_by_language().items():
        for rule in table:
            re.compile(rule.pattern, re.M | re.A)


def test_resolution(spark):
    symbols = spark.createDataFrame([
        ("a#000000000000000000001", "a", "outer", "function", 1, 9), ("a#000000000000000000002", "a", "inner", "function", 3, 5), ("a#000000000000000000003", "a", "inner", "class", 3, 400),
        ("b#000000000000000000001", "b", "helper", "function", 1, 2), ("b#000000000000000000002", "b", "Box.open", "method", 4, 5), ("c#000000000000000000001", "c", "helper", "function", 1, 1),
    ], "symbol_id string, file_id string, name string, type string, line_start int, line_end int")
    calls = spark.createDataFrame([
        ("1", "a", "helper", 4), ("2", "a", "x.inner", 300), ("3", "a", "nowhere", 900), ("4", "c", "helper", 1), ("5", "a", "box.open", 9),
    ], "call_id string, file_id string, callee_name string, line_number int").selectExpr("*", "'function' AS call_type", "1 AS column_number")
    edges = {r.call_id: (r.caller_symbol_id, r.callee_symbol_id, r.callee_file_id) for r in resolve.call_graph(calls, symbols).collect()}
    assert edges == {
        "1": ("a#000000000000000000001", "b#000000000000000000001", "b"), "2": ("a#000000000000000000002", "a#000000000000000000002", "a"), "3": (None, None, None), "4": ("c#000000000000000000001", "c#000000000000000000001", "c"), "5": ("a#000000000000000000001", "b#000000000000000000002", "b")}


def found(language, text, *kinds):
    rows = X.file_matches("f", language, text, X.compiled_rules(language))
    return [(r[2], [g for g in r[9] if g]) for r in rows if r[2] in kinds]


@pytest.mark.parametrize("text, calls", [
    ("`x ${helper(1)} y ${`a ${b(2)} c(3)`} z`; g()", ["helper", "b", "g"]),
    ("s.replace(/'/g, esc(s)).trim(); f('x(')", ["esc", "f"]),
    ("let q = a / b; h(c / d); k(/[/(]x(y)/)", ["h", "k"]),
    ("const o = { go() { return 1 }, async stop(a) { x() }, *it() {} }", ["x"]),
    ("if (x) { go() }", ["go"]),
    ("'a\\'b(1)'; /* c(1) */ d() // e()", ["d"]),
])
def test_javascript_calls(text, calls):
    assert [g[0] for _, g in found("javascript", text, "js_call")] == calls


def test_javascript_declarators():
    text = "const a = 1, c = () => run(2),\n  d = function () {}\nfoo(1, e => 2); f(x, y = () => 1)"
    assert sorted((k, g[0]) for k, g in found("javascript", text, "js_arrow", "js_function_value")) == [
        ("js_arrow", "c"), ("js_function_value", "d")]


@pytest.mark.parametrize("language", ["java", "csharp", "python", "javascript"])
def test_long_prose_takes_linear_time(language):
    started = time.time()
    assert found(language, "plain words without any mark " * 36000, "function") == []
    assert time.time() - started < 20


def test_many_blocks_in_one_file():
    body = "".join(f"void f{k}() {{\n  if (a) {{ g(); }}\n}}\n" for k in range(4000))
    started = time.time()
    rows = [r for r in X.file_matches("f", "java", "class A {\n" + body, X.compiled_rules("java")) if r[2] == "function"]
    assert len(rows) >= 4000 and time.time() - started < 20
    # The blank before a name belongs to the match, so its first line is the one before.
    text = "class A {\n  int f() {\n    x();\n  }\n}\n"
    facts = X.FileFacts(text)
    assert [facts.block_end(k) for k in (0, 1)] == [5, 4]


def test_file_facts_of_python():
    text = "class A:\n    @dec\n    def f(self):\n        x = 1\n\n    # c\n    def g(self): pass\n\ndef h():\n    pass\n"
    rows = [r for r in X.file_matches("f", "python", text, X.compiled_rules("python")) if r[2] in ("py_def", "py_class")]
    assert [(r[5], r[6], r[10], r[11]) for r in rows] == [(3, 6, True, ["@dec"]), (7, 8, True, []), (9, 11, False, []), (1, 8, False, [])]


PIECES = {
    "c": ["int ", "void ", "* ", "foo", "(", "a, b", ")", " {", "}", "\n", ";", "static ", "struct X ", "(x)", " ", "return f(x);\n", "/* c */"],
    "cpp": ["int ", "T& ", "* ", "foo", "(", "a", ")", " {", "}", "\n", ";", "template <class T>\n", "template<a> ", "operator", "==",
            "operator ", "+ ", " const", " noexcept", " -> int", "friend ", "(x)", " ", "virtual "],
    "java": ["public ", "int ", "foo", "(", "a b", ")", " {", "}", "\n", ";", "static ", " throws E", "class X", "(x)", " "],
    "csharp": ["public ", "int ", "foo", "(", "a b", ")", " {", "}", "\n", ";", "async ", "class X", "(x)", " "],
}


def test_anchored_patterns_find_what_the_patterns_find():
    rng, total = random.Random(3), 0
    for (language, pattern), anchor in R.ANCHORS.items():
        regex = re.compile(pattern, re.M | re.A)
        for _ in range(1500):
            text = "".join(rng.choice(PIECES[language]) for _ in range(rng.randint(0, 30)))
            expected = [(m.span(), m.groups()) for m in regex.finditer(text)]
            assert [(m.span(), m.groups()) for m in X.anchored(regex, anchor, text)] == expected, text
            total += len(expected)
    assert total > 400


def test_long_prose_costs_one_pass_in_every_language():
    rng = random.Random(5)
    words = "the function of operator int value (see this) and class is not a x, test. import def struct use type new".split()
    prose = ""
    while len(prose) < 1 << 18:
        prose += " ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) + rng.choice([".\n", " ", "\n", "; "])
    for language in ["", "python", "javascript", *R.REGEX_LANGUAGES]:
        started = time.process_time()
        for _ in X.file_matches("f", language, prose, X.compiled_rules(language)):
            pass
        assert time.process_time() - started < 5, language
