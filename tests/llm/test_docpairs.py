"""Documentation pairs: each language's convention, code that isn't code, and Python against its own parser."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadstone.llm import docpairs as D

SAY = "Waits until every queued entry has been written"


def names(language, text):
    return [(p.name, p.start_line) for p in D.pairs(language, text)]


CASES = [
    ("rust", f"/// {SAY}\n#[inline]\npub(crate) async fn go<T: Fn() -> u8>(x: T) -> u8 where T: Copy {{ 1 }}\n", [("go", 3)]),
    ("rust", f"/** {SAY} */\n// plain\nfn go() {{}}\n", [("go", 3)]),
    ("rust", f'#[doc = "{SAY}"]\nfn go() {{}}\n', [("go", 2)]),
    ("rust", f"// {SAY}\nfn go() {{}}\n/* {SAY} */\nfn on() {{}}\n//// {SAY}\nfn off() {{}}\n", []),
    ("rust", f"trait T {{\n    /// {SAY}\n    fn go(&self);\n    /// {SAY}\n    fn on(&self) {{}}\n}}\n", [("on", 5)]),
    ("rust", f'const S: &str = r#"\n/// {SAY}\nfn go() {{}}\n"#;\n/* /* */ /// {SAY}\nfn no() {{}} */\n/// {SAY}\nfn yes() {{}}\n', [("yes", 8)]),
    ("rust", f"/// {SAY}\nstruct S {{}}\nfn go<'a>(c: char) {{ let q = '\"'; }}\n/// {SAY}\nfn on() {{}}\n", [("on", 5)]),
    ("python", f'def go(a, b=")"):\n    """{SAY}"""\n', [("go", 1)]),
    ("python", f"@d\nasync def go(\n    a,\n) -> dict[str, int]:\n    # note\n\n    r'''{SAY}'''\n", [("go", 2)]),
    ("python", f'# {SAY}\ndef go():\n    x = """{SAY}"""\n', []),
    ("python", f"T = '''\ndef go():\n    \"\"\"{SAY}\"\"\"\n'''\n# def no():\n#     \"\"\"{SAY}\"\"\"\n", []),
    ("python", f'def go(): "{SAY}"\ndef on():\n    f"{SAY}"\ndef off():\n    "{SAY}".strip()\n', [("go", 1)]),
    ("python", f'class A:\n    """{SAY}"""\n    def go(self):\r\n        """TODO: go"""\r\n', []),
    ("typescript", f"/**\n * {SAY}\n * @param a b\n */\nexport default async function go<T>(a: T, b = {{ c: 1 }}): Promise<{{ d: T }}> {{\n}}\n", [("go", 5)]),
    ("typescript", f"/** {SAY} */\nexport const go = async (a: number): Promise<void> => {{}};\n/** {SAY} */\nconst on = x => x + 1;\n/** {SAY} */\nconst LIMIT = 3;\n", [("go", 2), ("on", 4)]),
    ("typescript", f"class A {{\n  /** {SAY} */\n  @logged()\n  private static go(a?: string): string | null {{ return `x ${{`/** {SAY} */ function no() {{}}`}}`; }}\n  /** {SAY} */\n  abstract off(): void;\n}}\n", [("go", 4)]),
    ("typescript", f"// {SAY}\nfunction go() {{}}\n/* {SAY} */\nfunction on() {{}}\n/* /** {SAY} *\\/\nfunction no() {{}} */\n", []),
    ("typescript", f"interface I {{\n  /** {SAY} */\n  go(): void;\n}}\nconst r = /[`'\"]/g;\n/** {SAY} */\nfunction on() {{}}\n", [("on", 7)]),
    ("go", f"// {SAY}\nfunc Go(a int) (int, error) {{\n}}\n", [("Go", 2)]),
    ("go", f"/*\n{SAY}\n*/\nfunc (s *T) Go(f func(int) bool) interface{{}} {{\n}}\n", [("Go", 4)]),
    ("go", f"// {SAY}\n\nfunc Go() {{\n}}\n// {SAY}\ntype T struct {{\n}}\nconst s = `\n// {SAY}\nfunc No() {{}}\n`\n", []),
    ("c", f"/**\n * {SAY}\n */\n__attribute__((noinline))\nstatic inline const char *go(struct x *p, int n)\n{{\n}}\n", [("go", 5)]),
    ("c", f"/// @brief {SAY}\n/// @param x y\nint go(int x) {{ return x; }}\n//! {SAY}\nint on(void) {{ return 0; }}\n/*! {SAY} */\nint up(void) {{ return 0; }}\n", [("go", 3), ("on", 5), ("up", 7)]),
    ("c", f"/** {SAY} */\nint go(int x);\n/** {SAY} */\n#define N 3\nint on(void) {{ return N; }}\n/** {SAY} */\nstruct s {{ int n; }};\n", []),
    ("c", f"#if 0 /*\n/// {SAY}\nint no(void) {{ return 0; }}\n*/\n#endif\n// {SAY}\nint go(void) {{ return 0; }}\nint x; ///< {SAY}\nint on(void) {{ return 0; }}\n", []),
    ("c", f"class A {{\npublic:\n    /** {SAY} */\n    [[nodiscard]]\n    virtual std::vector<int> go(const B& b) const noexcept override {{ return {{}}; }}\n    /// {SAY}\n    A(int x) : x_(x), y_{{1}} {{}}\n    /// {SAY}\n    void off() = delete;\n}};\n/// {SAY}\ntemplate <typename T>\nT A::on(T t) {{ return t; }}\n", [("go", 5), ("A", 7), ("on", 13)]),
]


@pytest.mark.parametrize("language,text,want", CASES)
def test_conventions(language, text, want):
    assert names(language, text) == want


@pytest.mark.parametrize(
    "doc,good",
    [
        ("", False), ("...", False), ("TODO(FIXME): open the gate", False), ("The openGate function.", False), ("See above.", False), ("`open_gate`", False),
        ("Opens one big wooden thing", True), ("@param a one two three four", False), ("@brief one two three four", True), (":returns: one two three four five", False),
        ("The a an one two three", False), ("Prüft, ob alle Werte gültig sind", True),
    ],
)
def test_informative(doc, good):
    assert D.informative(doc, "openGate") is good


def test_pair_contents():
    (p,) = D.pairs("c", f"/**\r\n * {SAY}.\r\n * @param x y\r\n */\r\nstatic int\r\ngo(int x)\r\n{{\r\n}}\r\n")
    assert (p.name, p.start_line, p.signature) == ("go", 6, "static int go(int x)")
    assert p.doc.splitlines() == [f"{SAY}.", "@param x y"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["def f(a):\n    '''one two three four five'''\n", "x = 'def g():'\n", "# def h(): 'one two three four'\n", "class C:\n    def m(self):\n        return 1\n", "async def k(b=(1, '#')):\n    # c\n    \"\"\"five six seven eight\"\"\"\n    pass\n", "\n"]), max_size=12))
def test_python_against_its_parser(parts):
    text = "".join(parts)
    want = sorted((n.name, n.lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(n))
    assert sorted(names("python", text)) == want


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(["rust", "python", "typescript", "go", "c"]), st.text(alphabet="/*\"'`#{}()<>\\\n fndexyz=:;!", max_size=200))
def test_no_text_breaks_a_grammar(language, text):
    D.pairs(language, text)


@pytest.mark.parametrize("language,head", [("rust", "fn f"), ("c", "int f"), ("typescript", "function f"), ("go", "func f"), ("python", "def f")])
def test_deep_nesting_is_passed_over(language, head):
    mark = "// " if language == "go" else "/** "
    text = f"{mark}{SAY}{'' if language == 'go' else ' */'}\n{head}{'(' * 20_000}\n"
    after = {"rust": f"/// {SAY}\nfn g() {{}}\n", "python": f"def g():\n    '{SAY}'\n", "go": f"// {SAY}\nfunc g() {{\n}}\n"}.get(language, f"/** {SAY} */\n{'void' if language == 'c' else 'function'} g() {{}}\n")
    assert [n for n, _ in names(language, text + "\n" + after)] == ["g"]


def test_spark(spark):
    code = f"/// {SAY}\nfn go() {{}}\n"
    rows = [(1, "a/x.rs", code), (1, "a/x.rs", code), (2, "b/copy.RS", code), (3, "c.txt", code), (4, "d.rs", None), (5, "e.rs", ""), (None, "f.rs", code), (6, None, code), (7, "g.go", code), (8, "h.rs", code * 3000)]
    df = spark.createDataFrame(rows, "source_id long, path string, content string").withColumn("language", F.lit("clash")).withColumn("name", F.lit("clash"))
    got = [(r.source_id, r.name, r.start_line) for r in D.extract(df).collect()]
    assert sorted(x for x in got if x[0] != 8) == [(1, "go", 2), (2, "go", 2)]
    assert len([x for x in got if x[0] == 8]) == 3000
    assert D.extract(df.limit(0)).collect() == []


def test_offsets_lead_to_the_parts():
    text = "use x;\n\n/// Opens the door to the cold store.\n#[inline]\npub fn open_door(a: u8) -> u8 {\n    a\n}\n"
    (p,) = D.pairs("rust", text)
    assert text[p.doc_char :].startswith("/// Opens") and text[p.start_char :].startswith("pub fn open_door") and text[p.body_char :].startswith("{")
