"""Extraction over whole texts: heads and bodies on one line, imports over several lines, spans, callers."""

import ast

from threadstone.operators import textual

RUST = (
    "pub use a::b;\nuse x::{\n    y,\n    z,\n};\n/// Makes.\n/// It.\n#[inline]\npub fn new() -> Self { helper(1) }\n"
    "struct S;\nimpl S {\n    fn go(\n        &self,\n    ) -> [u8; 4] {\n        f::<Vec<u8>>(x);\n        // lost(1)\n        *p = g(\"h(1)\");\n    }\n}\n"
)
TS = "import './side';\nimport {\n  a,\n} from \"m\";\nfunction run(): void {\n  foo(function () {\n    make<T>(x);\n  });\n  say(`${bar(1)}`);\n}\nrun();\n"
PY = "import numpy as np\nimport a, b.c as d\nfrom q import (\n    r,\n)\nclass K:\n    def m(self):\n        '''doc\nfn(1)\n'''\n        return f\"{one(2)}\"\n\n\ndef last(\n    x,\n):\n    return two(x)\n"
C = "#include <a.h>\n/* Doubles. */\nint twice(int x)\n{\n    *p = f(x);\n    return x;\n}\n"


def _frame(spark):
    return spark.createDataFrame([(0, "rust", RUST), (1, "typescript", TS), (2, "python", PY), (3, "c", C)], "id int, language string, content string")


def test_calls_have_callers_and_one_line_bodies(spark):
    got = {(r.id, r.line_no, r.callee, r.caller) for r in textual.called_names(_frame(spark), "id", "content").collect()}
    assert got == {
        (0, 9, "helper", "new"), (0, 15, "f", "go"), (0, 17, "g", "go"), (1, 6, "foo", "run"), (1, 7, "make", "run"), (1, 9, "say", "run"), (1, 9, "bar", "run"), (1, 11, "run", None),
        (2, 11, "one", "m"), (2, 17, "two", "last"), (3, 5, "f", "twice"),
    }


def test_imports_of_all_forms(spark):
    got = {(r.id, r.imported_path) for r in textual.imported_paths(_frame(spark), "id", "content").collect()}
    assert got == {(0, "a::b"), (0, "x::{ y, z, }"), (1, "./side"), (1, "m"), (2, "numpy"), (2, "a"), (2, "b.c"), (2, "q"), (3, "a.h")}


def test_spans_signatures_docs(spark):
    got = {(r.id, r.name): r for r in textual.declared_symbols(_frame(spark), "id", "language", "content").collect()}
    assert (got[0, "new"].line_no, got[0, "new"].end_line, got[0, "new"].doc) == (9, 9, "Makes.\nIt.")
    assert (got[0, "go"].line_no, got[0, "go"].end_line, got[0, "go"].kind, got[0, "go"].parent, got[0, "go"].signature) == (12, 18, "method", "S", "fn go(")
    assert (got[1, "run"].end_line, got[2, "K"].end_line, got[2, "m"].end_line, got[2, "last"].end_line) == (10, 11, 11, 17)
    assert (got[3, "twice"].end_line, got[3, "twice"].doc) == (7, "Doubles.")


def test_python_as_its_own_parser(spark):
    text = open(textual.__file__, encoding="utf-8").read()
    tree = ast.parse(text)
    df = spark.createDataFrame([(1, "python", text)], "id int, language string, content string")
    want = {(n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.ClassDef))}
    assert {(r.name, r.line_no, r.end_line) for r in textual.declared_symbols(df, "id", "language", "content").collect()} == want
    calls = {(n.func.lineno, n.func.id) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    assert calls <= {(r.line_no, r.callee) for r in textual.called_names(df, "id", "content").collect()}


def test_enumerators(spark):
    c = "enum Mode {\n    FAST = 1, /* B, */\n    SLOW,\n};\nenum One { A, B = (2), C };\nint f(void) {\n    return A;\n}\n"
    cpp = "enum class Kind : int {\n    Left, // Right\n    Up\n};\nenum { LONE };\n"
    df = spark.createDataFrame([(0, "c", c), (1, "cpp", cpp), (2, "rust", "enum E { A, B }\n"), (3, "c", "enum")], "id int, language string, content string")
    rows = textual.declared_symbols(df, "id", "language", "content").collect()
    got = {(r.id, r.line_no, r.name, r.parent) for r in rows if r.kind == "constant"}
    assert got == {(0, 2, "FAST", "Mode"), (0, 3, "SLOW", "Mode"), (0, 5, "A", "One"), (0, 5, "B", "One"), (0, 5, "C", "One"), (1, 2, "Left", "Kind"), (1, 3, "Up", "Kind"), (1, 5, "LONE", None)}
    assert {(r.id, r.name) for r in rows if r.kind == "enum"} >= {(0, "Mode"), (0, "One"), (1, "Kind")}
    assert {r.signature for r in rows if r.name == "B"} == {"B = (2)"}


YAML = """# head: no
%s
---
app:
  name: "a: b"   # c: d
  'two words': 1
  url: http://host:80/x
  empty:
  ports:
  - 80
  - host: h
    to: {p: 1, q: [x, {r: 's, t: u'}], "v": ~}
  text: |
    not: a key
      more: lines
  last: &anchor
    deep: !!str x
list:
    - a: 1
      b:
        - c: 2
    - plain: >-
        folded: text
      after: [1,
        {in: 2}]
...
next: {}
"""


def test_yaml_paths(spark):
    df = spark.createDataFrame([(0, YAML % "plain words"), (1, None), (2, ""), (3, "a: [1, {b: 2}"), (4, "- x: 1\r\n- x: 2\r\n"), (5, "word\nhttp://a\n{k: v}")], "path int, kind string")
    got = sorted((r[0], r[1], r[2]) for r in textual.yaml_paths(df, "path", "kind").toDF("key", "p", "k").collect())
    s, f = "struct", "field"
    want = [("app", s), ("app.name", f), ("app.two words", f), ("app.url", f), ("app.empty", f), ("app.ports", s), ("app.ports.host", f), ("app.ports.to", s), ("app.ports.to.p", f), ("app.ports.to.q", s), ("app.ports.to.q.r", f), ("app.ports.to.v", f), ("app.text", f), ("app.last", s), ("app.last.deep", f), ("list", s), ("list.a", f), ("list.b", s), ("list.b.c", f), ("list.plain", f), ("list.after", s), ("list.after.in", f), ("next", s)]
    assert got == sorted([(0, *w) for w in want] + [(3, "a", s), (3, "a.b", f), (4, "x", f), (4, "x", f), (5, "k", f)])


def test_json_paths(spark):
    df = spark.createDataFrame([(0, '{"a": {"b": [1, {"c": null}]}}'), (1, "{"), (2, None), (3, "[]")], "path int, kind string")
    got = sorted((r[0], r[1], r[2]) for r in textual.json_paths(df, "path", "kind").toDF("key", "p", "k").collect())
    assert got == [(0, "a", "struct"), (0, "a.b", "struct"), (0, "a.b.c", "field")]
