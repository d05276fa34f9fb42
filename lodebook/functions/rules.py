"""Extraction rules: one regular expression per rule, grouped by language.

Order matters: within a language it is the order in which symbols are numbered.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """`ends` names how the last line of a match is found; `masked` rules do not see
    the inside of strings and comments. Rules that end as a scope have no pattern: `operators.scopes` finds them.
    `needs` is a text that every match holds: a file without it is not searched."""

    kind: str
    pattern: str
    ends: str = "line"
    masked: bool = False
    needs: str = ""


# Patterns per language.
REGEX_LANGUAGES: dict[str, dict[str, list[str]]] = {
    "c": {
        "function": [
            r"^\s*(?:static\s+)?(?:inline\s+)?(?:const\s+)?(?:\w+[\s*]+)+(\w+)\s*\([^)]*\)\s*\{",
            r"^\s*(?:static\s+)?(?:inline\s+)?(?:const\s+)?(?:\w+[\s*]+)+(\w+)\s*\([^)]*\);",
        ],
        "class": [
            r"^\s*(?:typedef\s+)?struct\s+(\w+)",
            r"^\s*(?:typedef\s+)?enum\s+(\w+)",
            r"^\s*(?:typedef\s+)?union\s+(\w+)",
        ],
        "import": [r'#include\s*[<"]([^>"]+)[>"]'],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$"],
    },
    "cpp": {
        "function": [
            r"^\s*(?:template\s*<[^>]*>\s*)?(?:static\s+)?(?:inline\s+)?(?:virtual\s+)?(?:const\s+)?(?:explicit\s+)?(?:\w+[\s*&]+)+(\w+)\s*\([^)]*\)(?:\s*const)?(?:\s*override)?(?:\s*noexcept)?(?:\s*->\s*[\w:]+)?\s*\{",
            r"^\s*(?:template\s*<[^>]*>\s*)?(?:friend\s+)?(?:\w+[\s*&]+)+operator\s*([^\s(]+)\s*\([^)]*\)",
        ],
        "class": [
            r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?:\w+\s+)?(\w+)",
            r"^\s*namespace\s+(\w+)",
        ],
        "import": [r'#include\s*[<"]([^>"]+)[>"]', r"using\s+namespace\s+(\w+)"],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$"],
    },
    "csharp": {
        "function": [r"(?:public|private|protected|internal|static|\s)+(?:async\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)"],
        "class": [r"(?:public|private|protected|internal|\s)+(?:abstract\s+)?(?:sealed\s+)?(?:class|interface|struct|enum)\s+(\w+)"],
        "import": [r"using\s+([\w.]+);"],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$", r"///.*$"],
    },
    "java": {
        "function": [r"(?:public|private|protected|static|\s)+(?:synchronized\s+)?(?:final\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)(?:\s+throws\s+[\w,\s]+)?\s*\{"],
        "class": [r"(?:public|private|protected|\s)+(?:abstract\s+)?(?:final\s+)?(?:class|interface|enum)\s+(\w+)(?:<[^>]+>)?(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?"],
        "import": [r"import\s+(?:static\s+)?([\w.*]+);"],
        "export": [r"package\s+([\w.]+);"],
        "comment": [r"/\*\*[\s\S]*?\*/", r"/\*[\s\S]*?\*/", r"//.*$"],
    },
    "kotlin": {
        "function": [r"(?:override\s+)?(?:suspend\s+)?(?:inline\s+)?(?:private|public|protected|internal\s+)?fun\s+(?:<[^>]+>\s+)?(\w+)\s*\([^)]*\)"],
        "class": [r"(?:data\s+)?(?:sealed\s+)?(?:abstract\s+)?(?:open\s+)?(?:class|interface|object)\s+(\w+)"],
        "import": [r"import\s+([\w.*]+)"],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$"],
    },
    "swift": {
        "function": [r"(?:@\w+\s+)?(?:private|public|internal|fileprivate|open\s+)?(?:static\s+)?(?:override\s+)?(?:mutating\s+)?func\s+(\w+)(?:<[^>]+>)?\s*\([^)]*\)"],
        "class": [r"(?:final\s+)?(?:public|private|internal|open\s+)?(?:class|struct|enum|protocol|extension)\s+(\w+)"],
        "import": [r"import\s+(\w+)"],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$"],
    },
    "go": {
        "function": [r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\([^)]*\)(?:\s+(?:\([^)]+\)|\w+))?"],
        "class": [r"type\s+(\w+)\s+(?:struct|interface)\s*\{"],
        "import": [r'import\s+(?:\([^)]+\)|"[^"]+")'],
        "comment": [r"//.*$", r"/\*[\s\S]*?\*/"],
    },
    "rust": {
        "function": [r'(?:pub(?:\([^)]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+"[^"]+"\s+)?fn\s+(\w+)(?:<[^>]+>)?\s*\([^)]*\)'],
        "class": [
            r"(?:pub(?:\([^)]+\))?\s+)?(?:struct|enum|trait|type)\s+(\w+)(?:<[^>]+>)?",
            r"impl(?:<[^>]+>)?\s+(?:\w+\s+for\s+)?(\w+)",
        ],
        "import": [r"use\s+([\w:]+)(?:::\{[^}]+\})?;"],
        "comment": [r"//(?:/|!)?.*$", r"/\*[\s\S]*?\*/"],
    },
    "ruby": {
        "function": [r"def\s+(?:self\.)?(\w+(?:[?!])?)"],
        "class": [r"class\s+(\w+)(?:\s*<\s*\w+)?", r"module\s+(\w+)"],
        "import": [r"require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"load\s+['\"]([^'\"]+)['\"]"],
        "comment": [r"#.*$", r"=begin[\s\S]*?=end"],
    },
    "php": {
        "function": [r"(?:public|private|protected|static|\s)+function\s+(\w+)\s*\([^)]*\)"],
        "class": [
            r"(?:abstract\s+)?(?:final\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?",
            r"interface\s+(\w+)(?:\s+extends\s+[\w,\s]+)?",
            r"trait\s+(\w+)",
        ],
        "import": [r"(?:require|include)(?:_once)?\s*\(?['\"]([^'\"]+)['\"]\)?", r"use\s+([\w\\]+)(?:\s+as\s+\w+)?;"],
        "variable": [r"\$(\w+)\s*="],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$", r"#.*$"],
    },
    "scala": {
        "function": [r"(?:override\s+)?(?:private|protected|public\s+)?def\s+(\w+)(?:\[[^\]]+\])?\s*(?:\([^)]*\))?"],
        "class": [r"(?:sealed\s+)?(?:abstract\s+)?(?:case\s+)?(?:class|trait|object)\s+(\w+)"],
        "import": [r"import\s+([\w.]+)(?:\.\{[^}]+\})?"],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$"],
    },
    "perl": {
        "function": [r"sub\s+(\w+)\s*(?:\([^)]*\))?\s*\{"],
        "class": [r"package\s+([\w:]+);"],
        "import": [r"use\s+([\w:]+)", r"require\s+([\w:]+)"],
        "variable": [r"(?:my|our|local)\s+[$@%](\w+)"],
        "comment": [r"#.*$", r"^=\w+[\s\S]*?^=cut"],
    },
    "lua": {
        "function": [r"(?:local\s+)?function\s+(\w+)\s*\([^)]*\)", r"(?:local\s+)?(\w+)\s*=\s*function\s*\([^)]*\)"],
        "import": [r"require\s*\(?['\"]([^'\"]+)['\"]\)?"],
        "variable": [r"(?:local\s+)?(\w+)\s*="],
        "comment": [r"--\[\[[\s\S]*?\]\]", r"--.*$"],
    },
    "shell": {
        "function": [r"(?:function\s+)?(\w+)\s*\(\)\s*\{"],
        "variable": [r"(\w+)="],
        "import": [r"source\s+[\"']?([^\"'\s]+)[\"']?", r"\.\s+[\"']?([^\"'\s]+)[\"']?"],
        "comment": [r"#.*$"],
    },
    "r": {
        "function": [r"(\w+)\s*<-\s*function\s*\([^)]*\)", r"(\w+)\s*=\s*function\s*\([^)]*\)"],
        "import": [r"(?:library|require)\s*\([\"']?(\w+)[\"']?\)", r"source\s*\([\"']([^\"']+)[\"']\)"],
        "variable": [r"(\w+)\s*<-", r"(\w+)\s*="],
        "comment": [r"#.*$"],
    },
    "julia": {
        "function": [r"function\s+(\w+)(?:\([^)]*\))?", r"(\w+)\([^)]*\)\s*="],
        "class": [r"(?:mutable\s+)?struct\s+(\w+)", r"abstract\s+type\s+(\w+)"],
        "import": [r"using\s+([\w.]+)", r"import\s+([\w.]+)"],
        "comment": [r"#=[\s\S]*?=#", r"#.*$"],
    },
    "elixir": {
        "function": [r"def(?:p)?\s+(\w+)(?:\([^)]*\))?\s+do"],
        "class": [r"defmodule\s+([\w.]+)\s+do"],
        "import": [r"(?:import|require|use|alias)\s+([\w.]+)"],
        "comment": [r"#.*$"],
    },
    "haskell": {
        "function": [r"^(\w+)\s*::", r"^(\w+)\s+.*="],
        "import": [r"import\s+(?:qualified\s+)?([\w.]+)"],
        "comment": [r"--.*$", r"\{-[\s\S]*?-\}"],
    },
    "clojure": {
        "function": [r"\(defn?\s+(\S+)", r"\(defmacro\s+(\S+)"],
        "import": [r"\(:require\s+\[([^\]]+)\]", r"\(:import\s+\[([^\]]+)\]"],
        "comment": [r";.*$"],
    },
    "erlang": {
        "function": [r"^(\w+)\s*\([^)]*\)\s*->"],
        "import": [r"-include\s*\(\"([^\"]+)\"\)", r"-import\s*\((\w+),"],
        "export": [r"-export\s*\(\[([^\]]+)\]\)"],
        "comment": [r"%.*$"],
    },
    "nim": {
        "function": [
            r"proc\s+(\w+)(?:\*)?(?:\[[^\]]+\])?\s*\([^)]*\)",
            r"func\s+(\w+)(?:\*)?(?:\[[^\]]+\])?\s*\([^)]*\)",
            r"template\s+(\w+)(?:\*)?(?:\[[^\]]+\])?\s*\([^)]*\)",
        ],
        "class": [r"type\s+(\w+)(?:\*)?(?:\[[^\]]+\])?\s*="],
        "import": [r"import\s+([\w/]+)", r"from\s+([\w/]+)\s+import"],
        "comment": [r"#.*$", r"#\[[\s\S]*?\]#"],
    },
    "dart": {
        "function": [r"(?:static\s+)?(?:Future<[^>]+>\s+)?(?:void\s+)?(\w+)\s*(?:<[^>]+>)?\s*\([^)]*\)"],
        "class": [r"(?:abstract\s+)?class\s+(\w+)(?:<[^>]+>)?(?:\s+extends\s+\w+)?(?:\s+(?:with|implements)\s+[\w,\s]+)?"],
        "import": [r"import\s+['\"]([^'\"]+)['\"]"],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$"],
    },
    "zig": {
        "function": [r"(?:pub\s+)?(?:export\s+)?fn\s+(\w+)\s*\([^)]*\)"],
        "class": [r"const\s+(\w+)\s*=\s*(?:struct|enum|union)"],
        "import": [r'@import\s*\("([^"]+)"\)'],
        "comment": [r"//.*$"],
    },
    "vlang": {
        "function": [r"(?:pub\s+)?fn\s+(?:\([^)]+\)\s+)?(\w+)\s*\([^)]*\)"],
        "class": [r"struct\s+(\w+)\s*\{"],
        "import": [r"import\s+([\w.]+)"],
        "comment": [r"//.*$", r"/\*[\s\S]*?\*/"],
    },
    "solidity": {
        "function": [r"function\s+(\w+)\s*\([^)]*\)(?:\s+(?:public|private|internal|external))?(?:\s+(?:view|pure|payable))?(?:\s+returns\s*\([^)]*\))?"],
        "class": [r"contract\s+(\w+)(?:\s+is\s+[\w,\s]+)?", r"interface\s+(\w+)", r"library\s+(\w+)"],
        "import": [r"import\s+(?:\"([^\"]+)\"|'([^']+)')"],
        "variable": [r"(?:uint\d*|int\d*|address|bool|string|bytes\d*)\s+(?:public\s+)?(\w+)"],
        "comment": [r"/\*[\s\S]*?\*/", r"//.*$"],
    },
}

# Patterns for every other language, and for none.
GENERIC = {
    "function": [
        r"(?:function|def|fn|func|sub|method|proc)\s+(\w+)",
        r"(\w+)\s*[:=]\s*(?:function|lambda|\([^)]*\)\s*=>)",
    ],
    "class": [r"(?:class|struct|interface|trait|type|module)\s+(\w+)"],
    "variable": [r"(?:const|let|var|val)\s+(\w+)"],
    "import": [r"(?:import|require|include|use|using|load)\s+['\"]*([^'\";\s]+)"],
    "comment": [r"/\*[\s\S]*?\*/", r"//.*$", r"#.*$", r"--.*$"],
}

# Calls in all languages but JavaScript and its kin.
CALLS = {
    "call_function": r"\b([a-zA-Z_]\w*)\s*\(",
    "call_method": r"\b(\w+)\.(\w+)\s*\(",
    "call_new": r"new\s+(\w+)\s*\(",
}
CALL_NEEDS = {"call_function": "(", "call_method": ".", "call_new": "new"}
# Words that are no calls.
CALL_KEYWORDS = [
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "throw", "try", "catch",
    "finally", "class", "function", "const", "let", "var", "new", "this", "true", "false", "null",
]
PYTHON_KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del",
    "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal",
    "not", "or", "pass", "raise", "return", "try", "while", "with", "yield", "print", "len", "range", "str", "int",
    "float", "list", "dict", "set", "tuple", "bool", "type", "isinstance", "issubclass", "super", "property",
    "staticmethod", "classmethod",
]
JS_KEYWORDS = [
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "throw", "try", "catch",
    "finally", "typeof", "instanceof", "new", "this", "super", "class", "extends", "export", "import", "default",
    "function", "const", "let", "var", "async", "await", "yield", "delete", "void", "null", "undefined", "true",
    "false", "in", "of", "with",
]

# Words that start a line but name no property.
NO_PROPERTIES = [
    "def", "class", "if", "else", "for", "while", "try", "except", "finally", "with", "return", "case", "default",
    "break", "continue",
]

# Category of a symbol type in the structure of a file.
CATEGORIES = {
    "function": "functions", "method": "methods", "class": "classes", "interface": "interfaces",
    "type": "types", "struct": "structs", "enum": "enums", "trait": "traits",
    "variable": "variables", "constant": "constants", "property": "properties",
    "namespace": "namespaces", "module": "modules", "export": "exports", "import": "imports",
}

# Blank lines before a definition are no part of it: [ \t]* and not \s*.
PYTHON = [
    Rule("py_def", r"^([ \t]*)(async\s+)?def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?\s*:", "indent", needs="def"),
    Rule("py_lambda", r"(\w+)[ \t]*=\s*lambda\s+([^:]+):\s*.+", needs="lambda"),
    Rule("py_class", r"^([ \t]*)class\s+(\w+)(?:\s*\(([^)]*)\))?\s*:", "indent", needs="class"),
    Rule("py_property", r"^[ \t]+(\w+)[ \t]*(?::|=(?!=))"),
    Rule("py_import", r"^import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)[ \t]*(?:#.*)?$", needs="import"),
    Rule("py_from", r"^from\s+([\w.]+)\s+import\s+.+$", needs="from"),
    Rule("py_all", r"^__all__\s*=\s*\[([^\]]+)\]", needs="__all__"),
    Rule("comment", r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"),
    Rule("comment", r"(?!\A#!)#.*$", needs="#"),
    Rule("py_call_function", r"\b([a-zA-Z_]\w*)\s*\(", needs="("),
    Rule("py_call_method", r"\b(\w+)\.(\w+)\s*\(", needs="."),
    Rule("py_call_new", r"\b([A-Z]\w*)\s*\(", needs="("),
]

_NAME = r"([A-Za-z_$][\w$]*)"
_GENERICS = r"(?:\s*<[^()]*?>)?"
JAVASCRIPT = [
    Rule("js_function", rf"\b(async\s+)?function\s*(\*?)\s*{_NAME}{_GENERICS}\s*\(([^)]*)\)", "body", True, "function"),
    Rule("js_function_value", rf"(?:\b(?:const|let|var)\s+|,\s*){_NAME}\s*(?::[^=\n]+)?=\s*(async\s+)?function\s*(\*?)\s*[\w$]*\s*\(([^)]*)\)", "body", True, "function"),
    Rule("js_arrow", rf"(?:\b(?:const|let|var)\s+|,\s*){_NAME}\s*(?::[^=\n]+)?=\s*(async\s+)?{_GENERICS}(?:\(([^()]*(?:\([^()]*\)[^()]*)*)\)|([A-Za-z_$][\w$]*))\s*(?::[^={{}}\n]+)?=>", "expression", True, "=>"),
    Rule("js_class", r"(?!)", "scope", True),
    Rule("js_method", r"(?!)", "scope", True),
    Rule("js_interface", r"(?!)", "scope", True),
    Rule("js_type", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+{_NAME}{_GENERICS}\s*=", "expression", True, "type"),
    Rule("js_enum", r"(?!)", "scope", True),
    Rule("js_property", r"(?!)", "scope", True),
    Rule("js_import", r"^[ \t]*import\s+(?:[^'\";()]*?\bfrom\s*)?['\"]([^'\"\n]+)['\"]", needs="import"),
    Rule("js_export", rf"^[ \t]*export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:const\s+(?=enum\b))?(?:function\s*\*?|class|interface|type|enum)\s+{_NAME}(?!\s*from)", "line", True, "export"),
    Rule("js_export_list", r"^[ \t]*export\s+(?:type\s+)?\{([^}]*)\}", "line", True, "export"),
    Rule("js_export_default", r"^[ \t]*export\s+default\b", "line", True, "export"),
    Rule("comment", r"/\*[\s\S]*?\*/|//.*$"),
    Rule("js_call", rf"(?<![\w$.#])(?<!new )(?<!function )(?<!function\* ){_NAME}{_GENERICS}\(", "line", True, "("),
    Rule("js_call_member", rf"(?:(?<![\w$.)\]?]){_NAME}|(?<=[\w$)\]}}]))\s*\.\s*{_NAME}\s*\(", "line", True, "."),
    Rule("js_call_new", rf"(?<![\w$.])new\s+{_NAME}(?![\w$.])", "line", True, "new"),
]


class Anchor(NamedTuple):
    """How a pattern that begins with a run of words is found without trying it at every place.

    `run`: the characters of such a run; it ends where `last` (the run's end, or a word in it and what follows) meets the
    parenthesis that opens the parameters. `tail`: what must follow the closing one. `lead`: what may stand before the run.
    """

    run: str
    tail: str
    last: str = ""
    lead: str = ""


_TEMPLATE = r"^\s*template\s*<[^>]*>\Z"
ANCHORS = {
    ("java", REGEX_LANGUAGES["java"]["function"][0]): Anchor(r"\w\s", r"(?:\s+throws\s+[\w,\s]+)?\s*\{"),
    ("csharp", REGEX_LANGUAGES["csharp"]["function"][0]): Anchor(r"\w\s", ""),
    ("c", REGEX_LANGUAGES["c"]["function"][0]): Anchor(r"\w\s*", r"\s*\{"),
    ("c", REGEX_LANGUAGES["c"]["function"][1]): Anchor(r"\w\s*", ";"),
    ("cpp", REGEX_LANGUAGES["cpp"]["function"][0]): Anchor(
        r"\w\s*&", r"(?:\s*const)?(?:\s*override)?(?:\s*noexcept)?(?:\s*->\s*[\w:]+)?\s*\{", lead=_TEMPLATE),
    ("cpp", REGEX_LANGUAGES["cpp"]["function"][1]): Anchor(r"\w\s*&", "", r"operator\s*[^\s(]+\s*", _TEMPLATE),
}


def _from_table(table: dict[str, list[str]]) -> list[Rule]:
    rules = []
    for kind in ("function", "class", "variable", "import", "export", "comment"):
        ends = "block" if kind in ("function", "class", "variable") else "line"
        rules += [Rule(kind, pattern, ends) for pattern in table.get(kind, [])]
    return rules + [Rule(kind, pattern, needs=CALL_NEEDS[kind]) for kind, pattern in CALLS.items()]


def rules_by_language() -> dict[str, list[Rule]]:
    """Rules per language; the empty name stands for all others."""
    table = {name: _from_table(patterns) for name, patterns in REGEX_LANGUAGES.items()}
    table.update(python=PYTHON, typescript=JAVASCRIPT, javascript=JAVASCRIPT, jsx=JAVASCRIPT, tsx=JAVASCRIPT)
    table[""] = _from_table(GENERIC)
    return table
