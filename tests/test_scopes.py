import json
import random
import time

import pytest

from lodebook.operators import extraction as X
from lodebook.operators.scopes import Scopes


def scopes(text):
    return Scopes(X.mask_js(text)[1])


def methods(text):
    return [f"{r.groups[0]}{r.groups[2]}.{r.groups[1]}" for r in scopes(text).rows["js_method"]]


def properties(text):
    return [f"{r.groups[1]}.{r.groups[0]}" for r in scopes(text).rows["js_property"]]


@pytest.mark.parametrize("text, expected", [
    ("class A { [key]() {} [Symbol.iterator]() {} ['x y']() {} 'a-b'() {} 7() {} async *[k]() {} }",
     ["A.key", "A.unknown", "A.unknown", "A.unknown", "A.unknown", "async A.k"]),
    ("class A { #hidden() {} get size() { return 1 } set size(v) {} static async load() {} get() {} static() {} }",
     ["get A.size", "set A.size", "static async A.load", "A.get", "A.static"]),
    ("class A { run() { return { go() {}, async stop(a) {}, [k]() {}, b: { c() {} } } } end() {} }", ["A.run", "A.end"]),
    ("class A { make() { return class B { inner() {} } } last() { class C { own() {} } } }", ["A.make", "A.last", "C.own"]),
    ("const A = class B { run() {} }; let x = 1, D = class extends A { go() {} }; f(class E { no() {} })", ["A.run", "D.go"]),
    ("abstract class A { abstract far(): void; near(a: {b(): void}): { c: number } { } none(): void { } over(x: string): void\n over(x) { } }", ["A.near", "A.none", "A.over"]),
    ("class A<T extends { a: () => void }> extends mix({ b() {} }) implements I<{c: 1}> { go<U extends {d(): void}>(u: U): Promise<{e: 1}> { } }", ["A.go"]),
    ("class A { f(a = { b() {} }, c = () => { d() }) { if (x) { y() } } @deco({ a() {} }) @b.c g() {} static { h() } i() {} }",
     ["A.f", "A.g", "A.i"]),
    ("export default class { no() {} }\nexport class A {\n  x = 1\n  y = `a ${b({ c() {} })} }`\n  z = /[}]/\n  go() {}\n}", ["A.go"]),
    ("class A { f() { '}' } // }\n /* } */ g() {} }", ["A.f", "A.g"]),
    ("class A {\n f = () => { }\n ['a' + 1]() {}\n g = function () { }\n [0]\n *h() {} }", ["A.unknown"]),
    ("class A { f(", []), ("}}) class A { g() {", ["A.g"]), ("x.class; ({class: 1, interface: 2}); class A { class() {} enum() {} }", ["A.class", "A.enum"]),
])
def test_methods_are_those_of_the_body_itself(text, expected):
    assert methods(text) == expected


@pytest.mark.parametrize("text, expected", [
    ("class A { go = () => { this.a() }; static b = async x => ({ c: 1, d() {} }); e; f?: { g: string }; readonly [h] = 1 }",
     ["A.go", "A.b", "A.e", "A.f", "A.h"]),
    ("class A {\n  a = 1\n  b = 'x'\n  c = [1,\n    2]\n  d: Map<string, { e: 1 }> = new Map()\n  f\n  g!: string\n  h() { return { i: 1 } }\n}",
     ["A.a", "A.b", "A.c", "A.d", "A.f", "A.g"]),
    ("class A { f() { label: for (;;) { x = { y: 1 } } switch (z) { case w: v = 1 } } }", []),
    ("class A { #p = 1; 'q r' = 2; [key: string]: any; s = a ? b : c; t = u\n  .v()\n w = class B { z = 1 } }", ["A.unknown", "A.s", "A.t", "A.w"]),
    ("class A { a = `x\n${b}\n`\n c = function () { d = 1; e: 2 }\n f = <T,>(x: T) => x\n g = 1 }", ["A.a", "A.c", "A.f", "A.g"]),
    ("class A { @Input() a: string; @b({ c: 1 }) d = 2; @e f; static g }", ["A.a", "A.d", "A.f", "A.g"]),
])
def test_properties_are_those_of_the_body_itself(text, expected):
    assert properties(text) == expected


def test_heads():
    text = ("abstract class A extends B<C> implements D {}\nclass E extends f.G {}\nclass H extends mix(I) {}\n@x({ y: 1 })\nexport class J {}\n"
            "interface K extends L<M>, N.O { a: string; b?: { c: 1 }, d(): void\n readonly e: () => void\n [f: string]: any; 'g': 1; get h(): string }\n"
            "declare const enum P { Q = 1, R = f(2, 3), 'S', T }\nreturn class U {}; enum V {}\ntype W = { x(): void }")
    rows = scopes(text).rows
    assert [r.groups for r in rows["js_class"]] == [["abstract", "A", "B"], ["", "E", "."], ["", "H", "."], ["", "J", ""]]
    assert text[rows["js_class"][3].begin] == "@"
    assert [r.groups for r in rows["js_interface"]] == [["K", "L, N.O", "a", "b", "e"]]
    assert [r.groups for r in rows["js_enum"]] == [["const", "P", "Q", "R", "T"], ["", "V"]]


@pytest.mark.parametrize("text, calls", [
    ("abstract class A { abstract far(a): void; near() { go() } }", ["go"]),
    ("interface I { f(a: string): void; g: (x) => void }\ntype T = { h(): void }\ni()", ["i"]),
    ("const o = { a() { b() }, c: d(1), e: function () { f() }, async *g() {}, h: i ? j() : k() }", ["b", "d", "f", "j", "k"]),
    ("switch (a) { case b: { c(); d() } }\nl: { m(); }\nx = y ? { z() { w() } } : v()", ["c", "d", "m", "w", "v"]),
    ("class A { constructor(a = f()) { super(g()) } static { h() } p = q() }", ["f", "super", "g", "h", "q"]),
])
def test_calls(text, calls):
    found = X.file_matches("f", "typescript", text, X.compiled_rules("typescript"))
    assert [r[9][0] for r in found if r[2] == "js_call" and r[9][0] not in ("switch", "function")] == calls


def test_metadata_and_members(spark):
    text = ("class A {\n  a = 1;\n  go() { return { x: 1, no() {} }; }\n  run = () => 1;\n}\n"
            "interface B { c: string; d(): void }\nconst enum E { F, G }\nenum H {}\n")
    files = spark.createDataFrame([("t", "typescript", text), ("e", "typescript", ""), ("n", "typescript", None)], "file_id string, language string, content string").na.fill("")
    matches = X.find_matches(files)
    symbols = X.symbols_of(matches)
    merged = X.with_members(symbols, X.class_members(matches, symbols)).orderBy("symbol_id").collect()
    assert [(r.name, json.loads(r.metadata)) for r in merged] == [
        ("A.go", {"className": "A", "static": False, "async": False, "kind": "method"}),
        ("A", {"extends": False, "abstract": False, "methods": ["go"], "properties": ["a", "run"]}),
        ("B", {"properties": ["c"], "extends": 0}), ("E", {"members": ["F", "G"], "const": True}), ("H", {"members": [], "const": False})]


PIECES = ["class A ", "{", "}", "(", ")", "[", "]", "f", " g", ";", ",", "\n", "=", "=>", ":", "<", ">", "@d ", "interface I ", "enum E ", "extends ",
          "`", "${", "'", "/", "static ", "implements ", "*", "#p", "?", "1", "﻿", "é"]


def test_any_text_is_read_in_linear_time():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        found = scopes(text)
        for rows in found.rows.values():
            assert all(0 <= r.begin <= r.end <= r.last <= len(text) for r in rows), text
        assert all(0 <= at < len(text) for at in found.declared)
    for unit in ("{", "(", "class A {", "class A { f() {", "[}", "({", "interface I { a: {", "class A extends ", "x = class ", "{a(", "@", "<", "a = `${", "f(x)\n"):
        started = time.process_time()
        scopes(unit * (1 << 19 >> 3))
        assert time.process_time() - started < 8, unit
