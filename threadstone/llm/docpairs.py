"""Functions paired with their documentation, by a parsing-expression grammar per language.

Each grammar reads a file as a row of items: strings and comments (passed over whole), and functions with the documentation
that their language's convention attaches to them. Semantic actions emit a pair with source offsets; pairs whose description
says too little are dropped.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstone.llm.peg import Grammar, R, alt, cap, many, no, opt, seq

#: Words that a description needs besides what doesn't count.
LEAST_WORDS = 4


#: Where a pair's parts begin in its file.
OFFSETS = ["doc_char", "start_char", "body_char"]


class Pair(NamedTuple):
    name: str
    start_line: int
    signature: str
    doc: str
    doc_char: int
    start_char: int
    body_char: int


# ---- grammars -------------------------------------------------------------------------------------------------------

_LINE = r"//(?:[^\n\\]|\\\r?\n|\\.)*"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_STRING = r'"(?:[^"\\\n]|\\.)*(?:"|$)'
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"
_WS = r"\s*"
_ID = r"[A-Za-z_$]\w*"


def _balanced(open_: str, close: str, skip: list) -> dict:
    """A bracketed run that knows strings and comments."""
    plain = rf"[^{re.escape(open_)}{re.escape(close)}\"'`/]+"
    return seq(re.escape(open_), many(alt(plain, *skip, R("nest" + open_), rf"[^{re.escape(open_)}{re.escape(close)}]")), re.escape(close))


def _brackets(skip: list) -> dict:
    return {"nest" + o: _balanced(o, c, skip) for o, c in ("()", "[]", "{}", "<>")}


def _rust() -> Grammar:
    block = R("block")
    skip = [_LINE, block, R("string"), _CHAR]
    doc = alt(r"///(?!/)[^\n]*", seq(r"(?=/\*\*(?![*/]))", block), r"#\[\s*doc\s*=\s*\"(?:[^\"\\]|\\.)*\"\s*\]")
    space = many(alt(r"\s+", seq(no(doc), _LINE), seq(no(doc), block), seq(no(doc), r"#\s*", R("nest["))))
    modifiers = many(alt(r"pub\s*\([^)]*\)\s*|(?:pub|default|const|async|unsafe|safe)\b\s*", r"extern\s*(?:\"[^\"]*\")?\s*"))
    # a bound may hold an arrow, which closes nothing
    generics = seq("<", many(alt(r"[^<>\-\"'/]+", "->", skip[1], R("generics"), "'", "[-/]")), ">")
    return Grammar(
        _brackets(skip)
        | {
            "block": seq(r"/\*", many(alt(r"[^/*]+", R("block"), r"(?!\*/)[*/]")), r"\*/|\Z"),
            "string": alt(r"b?r(#*)\".*?\"\1", _STRING.replace("[^\"\\\\\\n]", "[^\"\\\\]")),
            "generics": generics,
            "function": seq(cap("function", seq(modifiers, r"fn\s+", cap("name", r"(?:r#)?" + _ID), _WS, opt(R("generics")), _WS, R("nest("), R("tail"))), r"\{"),
            "tail": many(alt(r"[^{;\"'/]+", *skip, "['/]")),
            "documented": seq(cap("doc", doc), many(seq(space, cap("doc", doc))), space, R("function")),
            "item": alt(R("documented"), *skip, rf"{_ID}|[^/\"'#\w]+|."),
        }
    )


def _curly(doc: str, functions: dict, extra: list, before: list) -> Grammar:
    """C-like languages: the last documentation comment before a function; plain comments and attributes may stand between."""
    skip = [*extra, _LINE, _BLOCK, _STRING, _CHAR]
    lines = r"///(?!/)|//!"
    space = many(alt(r"\s+", seq(no(doc), no(lines), _LINE), seq(no(doc), _BLOCK), *before))
    rules = _brackets(skip) | functions
    rules["documented"] = seq(R("docs"), space, cap("function", R("function")))
    rules["docs"] = functions.get("docs", cap("doc", seq(rf"(?={doc})", _BLOCK)))
    rules["item"] = alt(R("documented"), *skip, rf"{_ID}|[^/\"'`\w#=(,:;!&|?{{}}]+|.")
    return Grammar(rules)


def _c() -> Grammar:
    attribute = alt(seq(r"(?:__attribute__|__declspec|alignas|explicit(?=\s*\()|_Alignas)\s*", R("nest(")), seq(r"(?=\[\[)", R("nest[")))
    template = seq(r"template\s*", R("nest<"))
    name = r"(?:[A-Za-z_]\w*\s*(?:<[^<>(){};]*>)?\s*::\s*)*(?:operator\s*(?:\(\)|\[\]|[^\s\w(]{1,3}|\s\w[\w\s:*&]*)|~?[A-Za-z_]\w*)"
    keyword = r"(?:if|for|while|switch|return|else|do|catch|sizeof|typedef|using|namespace|goto|case|throw|new|delete|static_assert|defined)\b"
    spec = alt(attribute, template, seq(no(seq(name, r"\s*\((?!\s*\*)")), alt(r"[A-Za-z_]\w*", r"::|[*&]", R("nest<"))))
    tail = many(
        alt(
            r"\s+", r"(?:const|volatile|override|final|mutable|try|&&|&)\b|&&?", seq(r"(?:noexcept|throw|requires)\b\s*", opt(R("nest("))), attribute,
            seq(r"->\s*", many(alt(r"[\w:*&\s]+", R("nest<")))),
            seq(r":(?!:)\s*", many(seq(r"[\w:]+\s*", opt(R("nest<")), r"\s*", alt(R("nest("), R("nest{")), r"\s*,?\s*"), 1)),
        )
    )
    function = seq(no(keyword), many(seq(spec, _WS)), no(keyword), cap("name", name), _WS, R("nest("), tail, no(r"\s*;"), r"(?=\{)")
    plain = r"/\*[*!](?![*/<])"
    line = r"(?:///(?![/<])|//!(?!<))[^\n]*"
    docs = alt(cap("doc", seq(rf"(?={plain})", _BLOCK)), seq(cap("doc", line), many(seq(r"[ \t\r]*\n[ \t]*", cap("doc", line)))))
    off = r"#[ \t]*if[ \t]+0\b.*?^[ \t]*#[ \t]*(?:endif|else|elif)\b[^\n]*"
    directive = r"#(?:[^\n/\\]|\\\r?\n|\\.|/(?![/*]))*"
    raw = r"(?:u8|[uUL])?R\"([^()\\\s\"]{0,16})\(.*?\)\1\""
    return _curly(plain, {"function": function, "docs": docs}, [off, directive, raw], [attribute])


def _typescript() -> Grammar:
    template = R("template")
    regex = r"[=(,:;!&|?{}]\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
    atom = alt(seq(R("nest{")), seq(R("nest("), opt(seq(r"\s*=>\s*", R("type")))), seq(R("nest[")), _STRING, _CHAR, seq(r"[\w$.]+", opt(R("nest<")), opt(seq(r"\s+(?:is|extends)\s+", R("type")))), template)
    unary = seq(r"(?:(?:keyof|typeof|readonly|unique|infer|asserts|new|abstract)\s+)*", atom, many(seq(r"[ \t]*", R("nest["))))
    returns = opt(seq(r"\s*:\s*", R("type")))
    body = r"\s*(?=\{)"
    decorator = seq(r"@[\w$.]+", opt(R("nest(")))
    modifiers = many(alt(r"(?:public|private|protected|static|async|override|readonly|get|set|accessor|declare)\s+(?![=(:;,?!<])", r"\*\s*"))
    arrow = seq(r"(?:async\s*)?", opt(R("nest<")), _WS, alt(seq(R("nest("), returns), r"[A-Za-z_$][\w$]*"), r"\s*=>")
    value = alt(seq(r"(?:async\s+)?function\b\s*\*?\s*(?:[\w$]+)?\s*", opt(R("nest<")), _WS, R("nest("), returns, body), arrow)
    keyword = r"(?:if|for|while|switch|catch|function|return|new|else|do|try|throw|typeof|class|interface|enum|const|let|var|import|export|type|abstract|await|yield|delete|void|in|of|case|with)\b"
    name = cap("name", seq(no(keyword), r"#?[A-Za-z_$][\w$]*"))
    exported = r"(?:export\s+)?(?:default\s+)?"
    function = alt(
        seq(exported, r"(?:async\s+)?function\b\s*\*?\s*", name, _WS, opt(R("nest<")), _WS, R("nest("), returns, body),
        seq(exported, r"(?:const|let|var)\s+", name, r"\s*!?", opt(seq(r"\s*:\s*", R("type"))), r"\s*=\s*", value),
        seq(modifiers, name, r"\s*\??\s*", opt(R("nest<")), _WS, R("nest("), returns, body),
        seq(modifiers, name, r"\s*[!?]?", opt(seq(r"\s*:\s*", R("type"))), r"\s*=\s*", value),
        seq(name, r"\s*:\s*", value),
    )
    rules = {
        "template": seq("`", many(alt(r"[^`\\$]+", r"\\.", seq(r"(?=\$\{)\$", R("nest{")), r"\$")), "`|\\Z"),
        "type": seq(r"[|&]?\s*", unary, many(seq(r"\s*[|&]\s*", unary))),
        "function": function,
    }
    return _curly(r"/\*\*(?![*/])", rules, [template, regex], [seq(decorator)])


def _go() -> Grammar:
    raw = r"`[^`]*(?:`|\Z)"
    skip = [raw, _LINE, _BLOCK, _STRING, _CHAR]
    results = many(alt(seq(r"(?:interface|struct)\s*", R("nest{")), R("nest("), R("nest["), r"[^{}()\[\]\n\"'`/]+"))
    function = seq(r"func\b\s*", opt(seq(R("nest("), _WS)), cap("name", _ID), opt(R("nest[")), _WS, R("nest("), results)
    comment = alt(r"//[^\n]*", _BLOCK)
    return Grammar(
        _brackets(skip)
        | {
            # comments belong to what begins on the next line, and to nothing across a blank line
            "documented": seq(many(seq(cap("doc", comment), r"[ \t\r]*\n[ \t]*(?!\s)"), 1), cap("function", function), r"(?=\{)"),
            "group": many(seq(comment, r"[ \t\r]*(?:\n[ \t]*(?=//|/\*)|(?=\n|\Z))"), 1),
            "item": alt(R("documented"), R("group"), *skip, rf"{_ID}|[^/\"'`\w]+|."),
        }
    )


def _python() -> Grammar:
    text = r"(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*(?:\"|$)|'(?:[^'\\\n]|\\.)*(?:'|$))"
    comment = r"#[^\n]*"
    skip = [text, comment]
    plain = r"[^()\[\]{}\"'#]+"
    nests = {"nest" + o: seq(re.escape(o), many(alt(plain, *skip, R("nest("), R("nest["), R("nest{"))), re.escape(c)) for o, c in ("()", "[]", "{}")}
    prefix = r"(?:[rRuU]?)(?=[\"'])"
    gap = r"(?:[ \t]|\\\r?\n)*"
    # the first statement of the body, whole, is a string
    docstring = seq(prefix, cap("doc", text), many(seq(gap, prefix, cap("doc", text))), gap, r"(?=[;#\r\n]|\Z)")
    lead = alt(seq(r"[ \t]*(?:#[^\n]*)?\r?\n", many(r"[ \t]*(?:#[^\n]*)?\r?\n"), r"[ \t]+"), r"[ \t]*")
    head = seq(r"(?:async\s+)?def\s+", cap("name", r"[^\W\d]\w*"), gap, opt(R("nest[")), gap, R("nest("), gap, opt(seq("->", many(alt(r"[^:()\[\]{}\"'#]+", text, R("nest("), R("nest["), R("nest{"))))))
    return Grammar(
        nests
        | {
            "documented": seq(cap("function", head), ":", lead, docstring),
            "item": alt(R("documented"), *skip, r"[^\W\d]\w*|[^\"'#\w]+|."),
        }
    )


#: Endings of paths and the grammars that read them.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript",
    "go": "go", "c": "c", "h": "c", "cpp": "c", "cc": "c", "cxx": "c", "hpp": "c", "hh": "c", "hxx": "c",
}
_MAKERS = {"rust": _rust, "python": _python, "typescript": _typescript, "go": _go, "c": _c}


#: What stands between items: no documentation, string or comment begins in it. Words keep clear of quotes that they prefix.
BETWEEN = {
    "rust": re.compile(r"(?:[^/\"'#\w]++|\w++(?![\"'#]))+"),
    "python": re.compile(r"(?:[^\"'#\w]++|(?!(?:async|def)\b)\w++(?![\"']))+"),
    "typescript": re.compile(r"(?:[^/\"'`\w#=(,:;!&|?{}]++|\w++(?![\"'`])|[=(,:;!&|?{}](?!\s*/))+"),
    "go": re.compile(r"(?:[^/\"'`\w]++|\w++(?![\"'`]))+"),
    "c": re.compile(r"(?:[^/\"'#\w]++|\w++(?![\"']))+"),
}


@functools.lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    return _MAKERS[language]()


# ---- descriptions ---------------------------------------------------------------------------------------------------

_TAG = re.compile(r"^\s*(?:[@\\:](?:t?param(?:eter)?s?|arg(?:ument)?s?|returns?|retval|result|rtype|type|throws?|raises?|exception|yields?|template)\b|[@\\](?:in|out)\b)", re.I)
_BRIEF = re.compile(r"^(\s*)[@\\](?:brief|short|summary|description|details?|desc)\b", re.I)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ɏ]+|[^\W\d_]+")
# Words that say nothing.
_EMPTY = {"a", "an", "the", "todo", "fixme", "tbd", "xxx"}


def clean(language: str, comments: list[str]) -> str:
    """The text of documentation comments without comment marks."""
    out = []
    for c in comments:
        if language == "python":
            body = c[3:-3] if c[:3] in ('"""', "'''") else c[1:-1]
            out += body.splitlines()
        elif c.startswith("/*"):
            body = re.sub(r"^/\*[*!]*|\*+/$", "", c)
            out += [re.sub(r"^\s*\*+(?!/)\s?", "", x) if i else x for i, x in enumerate(body.splitlines())]
        elif c.startswith("#"):
            out.append(re.sub(r'^#\[\s*doc\s*=\s*"|"\s*\]$', "", c))
        elif not (language == "go" and re.match(r"//(?:go|line|export|nolint)\b:?\S", c)):
            out.append(re.sub(r"^//[/!]*\s?", "", c))
    return "\n".join(x.rstrip() for x in out).strip("\n").strip()


def informative(doc: str, name: str) -> bool:
    """Whether enough words are left without tag lines, the name's words, articles and notes to oneself."""
    own = {w.lower() for w in _SPLIT.findall(name)}
    left = 0
    for line in doc.splitlines():
        if _TAG.match(line):
            continue
        for word in re.findall(r"[^\W\d_]+(?:['’_][^\W\d_]+)*", _BRIEF.sub(r"\1", line)):
            parts = [p.lower() for p in _SPLIT.findall(word)] if "'" not in word and "’" not in word else [word.lower()]
            left += any(p not in own and p not in _EMPTY for p in parts)
    return left >= LEAST_WORDS


def pairs(language: str, text: str | None) -> list[Pair]:
    """The documented functions of one file. Null and empty texts have none."""
    if not text:
        return []

    def action(source: str, captures: tuple) -> Pair | None:
        docs = [source[a:b] for label, a, b in captures if label == "doc"]
        body = next(((a, b) for label, a, b in captures if label == "function"), None)
        at = next(((a, b) for label, a, b in captures if label == "name"), None)
        if not docs or body is None or at is None:
            return None
        name = re.split(r"::\s*", source[slice(*at)])[-1].removeprefix("r#")  # as its own scope calls it
        doc = clean(language, docs)
        if not informative(doc, name):
            return None
        signature = " ".join(source[slice(*body)].split()).rstrip("{: ")
        first = min(a for label, a, _ in captures if label == "doc")
        return Pair(name, source.count("\n", 0, at[0]) + 1, signature, doc, first, body[0], body[1])

    return grammar(language).emit(text, "item", action, BETWEEN[language])


def extract(df: DataFrame, path: str = "path", content: str = "content", key: str = "source_id") -> DataFrame:
    """``key, path, language, name, start_line, signature, doc, doc_char, start_char, body_char``: one row per documented function of
    every file, with the offsets, in characters from 0, at which its documentation, its head and its body begin.

    The path's ending decides on the language; files of others, and null or empty contents, give nothing. Repeated rows count
    once; copies of a content under several keys are parsed once, in the first stage, and each key gets its own rows. A key
    without path or null keys give nothing. Extra columns are ignored.
    """
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ending]
    files = df.select(F.col(key).alias("k"), F.col(path).alias("p"), language.alias("language"), F.col(content).alias("c"))
    files = files.filter(F.col("k").isNotNull() & F.col("language").isNotNull() & F.col("c").isNotNull() & (F.col("c") != "")).withColumn("h", F.sha2("c", 256))
    owners = files.select("k", "p", "language", "h").distinct()
    once = files.groupBy("language", "h").agg(F.first("c").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, h, *p) for lang, h, c in zip(*(b.column(x).to_pylist() for x in ("language", "h", "c"))) for p in pairs(lang, c)]
            cols = list(zip(*rows)) if rows else [()] * 9
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["language", "h", "name", "start_line", "signature", "doc", *OFFSETS])

    parsed = once.mapInArrow(run, "language string, h string, name string, start_line long, signature string, doc string, doc_char long, start_char long, body_char long")
    # AQE splits a content that very many keys share
    out = owners.join(parsed, ["language", "h"])
    return out.select(F.col("k").alias(key), F.col("p").alias("path"), "language", "name", "start_line", "signature", "doc", *OFFSETS)
