"""Configuration formats and source code as entries: key paths with the byte offsets of their values.

Every parser reads UTF-8 bytes and yields `Entry`: JSON, YAML with block scalars and flow collections, INI, TOML, properties and
environment lines, XML, string literals of code with the name they are bound to, options of commands, and statements (comments,
prose, and values that are sentences). Parsers are tolerant: texts may be cut anywhere, and foreign lines may stand between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Entry(NamedTuple):
    """A value's place in the bytes, the keys that lead to it, whether it stands in quotes, and the format it was read from."""

    path: tuple[str, ...]
    start: int
    end: int
    quoted: bool
    form: str


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


# ---- JSON -----------------------------------------------------------------------------------------------------------

_JSON = re.compile(rb"\"((?:[^\"\\\n]|\\.)*)\"(\s*:)?|([{}\[\],])")


def json_entries(b: bytes, begin: int, end: int, path: tuple[str, ...] = ()) -> Iterator[Entry]:
    """String values of JSON. Array items have their index as key; ``name`` (or ``key``) and ``value`` members of an object are an
    entry of that name. A string before a colon is a key, so foreign lines don't put the parser out of step."""
    stack: list[tuple] = []  # of the containers around: key, whether an array, the name given by a sibling
    key, array, named = "", False, ""
    for m in _JSON.finditer(b, begin, end):
        mark = m[3]
        if mark is None:
            if m[2]:
                key = _text(m[1])
                continue
            own = key
            if own in ("name", "key"):
                named = _text(m[1])
            elif own == "value" and named:
                own = named
            yield Entry((*path, *(k for k, _, _ in stack if k), own), m.start(1), m.end(1), True, "json")
        elif mark in b"{[":
            stack.append((key, array, named))
            array = mark == b"["
            key, named = ("0" if array else ""), ""
        elif mark in b"}]":
            if stack:
                key, array, named = stack.pop()
        else:
            key = str(int(key) + 1) if array and key.isdigit() else ""


# ---- YAML, INI, TOML, properties, environment -----------------------------------------------------------------------

_LINE = re.compile(
    rb"^([ \t]*)((?:[;#]+[ \t]*|//[ \t]*)?)((?:- +)*)(?:export[ \t]+|set[ \t]+|ENV[ \t]+|ARG[ \t]+)?"
    rb"(\"[^\"\n]+\"|'[^'\n]+'|[A-Za-z_\x80-\xff][\w.\-/\x80-\xff]*)[ \t]*(:(?=[ \t]|$)|=|:(?=[^ \t:/]))[ \t]*(.*?)[ \t]*$"
)
_SECTION = re.compile(rb"^\s*\[+\s*([^\[\]\"'=]+?)\s*\]+\s*(?:[#;].*)?$")
_PREFIX = re.compile(rb"(?:(?:!!?[\w:/.\-]*|&[\w\-]+)[ \t]+)+(?=\S)")
_BLOCK = re.compile(rb"[|>][+-]?\d?[+-]?(?:[ \t]+#.*)?$")
_FLOW = re.compile(rb"(?:\"([^\"\n]*)\"|'([^'\n]*)'|([A-Za-z_][\w.\-]*))[ \t]*[:=][ \t]*(?:\"((?:[^\"\\\n]|\\.)*)\"|'([^'\n]*)'|([^\s,{}\[\]\"'][^,{}\[\]\n]*))")
_CLOSERS = {b'"': re.compile(rb"(?:[^\"\\]|\\.)*?(?=\")", re.S), b"'": re.compile(rb"(?:[^'\\]|''|\\.)*?(?='(?!'))", re.S)}
_TRIPLE = (b'"""', b"'''")


def line_entries(b: bytes, begin: int, end: int) -> Iterator[Entry]:
    """Settings by lines, commented ones too. Sections, dots of nothing and indentation give the path; block scalars are the
    indented lines below, triple-quoted values go over lines, flow collections give an entry per member. ``name`` and ``value``
    items side by side are an entry of that name."""
    stack: list[tuple[int, str]] = []
    section: tuple[str, ...] = ()
    named = ""
    at = begin
    while at < end:
        stop = b.find(b"\n", at, end)
        stop = end if stop < 0 else stop
        nxt = stop + 1
        last = stop - 1 if stop > at and b[stop - 1 : stop] == b"\r" else stop
        line = b[at:last]
        if s := _SECTION.match(line):
            section, stack, at = tuple(_text(s[1]).split(".")), [], nxt
            continue
        m = _LINE.match(line)
        if not m:
            at = nxt
            continue
        indent, key, value = len(m[1]) + len(m[3]), _text(m[4]).strip("\"'"), m[6]
        while stack and stack[-1][0] >= indent:
            stack.pop()
        path = (*section, *(k for _, k in stack))
        start = at + m.start(6)
        if p := _PREFIX.match(value):
            start, value = start + p.end(), value[p.end() :]
        if not value or value.startswith(b"#"):
            stack.append((indent, key))
            at = nxt
            continue
        if value[:1] in b"{[" and not m[2] and b"{{" not in value and value[:2] not in (b"{%",):
            for f in _FLOW.finditer(b, start, last):
                k = f[1] or f[2] or f[3]
                g = 4 if f[4] is not None else 5 if f[5] is not None else 6
                raw = f[g].rstrip()
                yield Entry((*path, key, _text(k)), f.start(g), f.start(g) + len(raw), g < 6, "flow")
            at = nxt
            continue
        if _BLOCK.match(value) and not m[2]:
            first = tail = None
            while nxt < end:
                stop = b.find(b"\n", nxt, end)
                stop = end if stop < 0 else stop
                row = b[nxt:stop]
                body = row.strip()
                if body:
                    if len(row) - len(row.lstrip()) <= indent:
                        break
                    first = nxt + len(row) - len(row.lstrip()) if first is None else first
                    tail = nxt + len(row.rstrip())
                nxt = stop + 1
            if first is not None:
                yield Entry((*path, key), first, tail, False, "block")
            at = nxt
            continue
        if value[:3] in _TRIPLE:
            close = b.find(value[:3], start + 3, end)
            if close >= 0:
                inner = b[start + 3 : close]
                lead = len(inner) - len(inner.lstrip())
                if inner.strip():
                    yield Entry((*path, key), start + 3 + lead, start + 3 + lead + len(inner.strip()), True, "setting")
                after = b.find(b"\n", close, end)
                at = end if after < 0 else after + 1
                continue
        quoted = False
        if value[:1] in _CLOSERS:
            got = _CLOSERS[value[:1]].match(value, 1)
            if got:
                start, value, quoted = start + 1, got[0], True
            else:
                start, value = start + 1, value[1:]
        else:
            value = re.split(rb"[ \t]+[#;]|[ \t]+//[ \t]", value)[0].rstrip()
        if key in ("name", "key"):
            named = _text(value)
        own = named if key == "value" and named else key
        if value:
            yield Entry((*path, own), start, start + len(value), quoted, "setting")
        if key == "value":
            named = ""
        at = nxt


# ---- XML ------------------------------------------------------------------------------------------------------------

_XML = re.compile(
    rb"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[?!][^>]*>?|<(/?)([A-Za-z_][\w:.\-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|([^<]+)|<", re.S
)
_ATTRIBUTE = re.compile(rb"([A-Za-z_][\w:.\-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def xml_entries(b: bytes, begin: int, end: int) -> Iterator[Entry]:
    """Attributes and element texts of XML. ``key``/``name``/``id`` and ``value`` attributes of an element are an entry of that name,
    and so is the text of an element with such a name."""
    stack: list[tuple[str, str]] = []
    for m in _XML.finditer(b, begin, end):
        if m[3]:
            tag = _text(m[3])
            if m[2]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            path, named = (*(t for t, _ in stack), tag), ""
            found = list(_ATTRIBUTE.finditer(b, m.start(4), m.end(4)))
            for a in found:
                if a[1].lower() in (b"key", b"name"):
                    named = _text(a[a.lastindex])
            for a in found:
                g, own = a.lastindex, _text(a[1])
                if own.lower() == "value" and named:
                    own = named
                yield Entry((*path, own), a.start(g), a.end(g), True, "xml")
            if not m[5]:
                stack.append((tag, named))
            continue
        g = 1 if m[1] else 6 if m[6] else 0
        if g and stack:
            inner = m[g]
            if v := inner.strip():
                start = m.start(g) + len(inner) - len(inner.lstrip())
                tag, named = stack[-1]
                yield Entry((*(t for t, _ in stack), *((named,) if named else ())), start, start + len(v), True, "xml")


# ---- code -----------------------------------------------------------------------------------------------------------

_STRING = re.compile(
    rb"\"\"\"(.*?)\"\"\"|'''(.*?)'''|(?<![\w])[bc]?r(#+)\"(.*?)\"\3"
    rb"|\"((?:[^\"\\\n]|\\.)*)\"|(?<![\w'])(?:[bBrRfFuUL]{1,2})?'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`",
    re.S,
)
_BOUND = [
    re.compile(rb"[\"']([\w.\- ]+)[\"']\s*\]?\s*(?:,|:|=>|\|\|=|\?\?=|=)\s*$"),
    re.compile(rb"([\w$\x80-\xff][\w$\-\x80-\xff]*)\s*(?:\[\s*\w*\s*\])?\s*(?::(?!:)\s*[&\w:<>'*\s\[\]|.]+?)?\s*(?::=|\|\|=|\?\?=|==|!=|=|:|\{|=>)\s*(?:!!\w+\s+|(?:String|std::string|string)(?:::from)?[({]|[bcfruLBRFU]{1,2})?\(?$"),
    re.compile(rb"#\s*define\s+(\w+)\s+$"),
    re.compile(rb"\(\s*(?:[\w$]+(?:\.|->|::))*([\w$]+)\s*,\s*$"),
    re.compile(rb"([\w$]+)\(\s*$"),
]
_JOINED = re.compile(rb"\s*(?:\+|\.{1,2}|\\)?\s*")


def literal_entries(b: bytes, begin: int, end: int, wanted: re.Pattern) -> Iterator[Entry]:
    """String literals with the name they are bound to: by assignment, comparison, initialisation, field, call or argument; literals
    joined to one (by ``+``, ``.``, or nothing) have its name. Triple-quoted and raw strings are literals. Only what has ``wanted``
    in the line to its left is looked at."""
    name, upto, at = "", -1, begin
    while m := _STRING.search(b, at, end):
        g = 4 if m.lastindex == 3 else m.lastindex
        line = max(b.rfind(b"\n", begin, m.start()) + 1, begin)
        left = b[line : m.start()]
        own = ""
        if wanted.search(left):
            for bound in _BOUND:
                if h := bound.search(left):
                    own = _text(h[1])
                    break
        if not own and name and m.start() - upto < 200 and _JOINED.fullmatch(b, upto, m.start()):
            own = name
        if g in (1, 2) and not own:  # documentation, or none of a string's ends: what stands in it is read like any other
            at = m.start() + 3
            continue
        name, upto, at = own, m.end(), m.end()
        if own:
            inner = m[g]
            lead = len(inner) - len(inner.lstrip()) if g in (1, 2) else 0
            size = len(inner.strip()) if g in (1, 2) else len(inner)
            yield Entry((own,), m.start(g) + lead, m.start(g) + lead + size, True, "literal")


_FLAG = re.compile(rb"(?<!\S)--([a-z][\w-]*)(?:=|[ \t]+)(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"']+))")
_LOGIN_FLAG = re.compile(rb"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[ =]?[\"']?[^\s:\"']*:([^\s\"']+)")
_HEADER = re.compile(rb"(?<![\w-])([Xx]-[\w-]+)\s*:\s*([^\s\"'`<>]+)")


def command_entries(b: bytes, begin: int, end: int) -> Iterator[Entry]:
    """Options of commands with their arguments, the login option of web clients, and headers of requests."""
    for m in _FLAG.finditer(b, begin, end) if b.find(b"--", begin, end) >= 0 else ():
        g = m.lastindex
        yield Entry((_text(m[1]),), m.start(g), m.end(g), g < 4, "option")
    for m in _LOGIN_FLAG.finditer(b, begin, end) if b.find(b" -u", begin, end) >= 0 or b.find(b"--user", begin, end) >= 0 else ():
        yield Entry(("user", "password"), m.start(1), m.end(1), False, "login")
    for m in _HEADER.finditer(b, begin, end) if b.find(b"X-", begin, end) >= 0 or b.find(b"x-", begin, end) >= 0 else ():
        yield Entry((_text(m[1]),), m.start(2), m.end(2), False, "header")


# ---- which format ---------------------------------------------------------------------------------------------------

_CONFIG_LINE = re.compile(
    rb"^\s*(?:[;#].*|//.*|(?:- )*(?:export\s+|set\s+)?[A-Za-z_\"'\x80-\xff][\w.\-\"'\x80-\xff]*\s*[:=].*[^;{(,]|(?:- )*[\w.\-\"']+:\s*(?:[|>][+-]?)?|- [^;]*|\[[^\]]+\]|[}\]])\s*$"
)
_NO_LINE = re.compile(rb"\s*(?:[;#]|//|-----|[A-Za-z0-9+/=]{60,}$)")
_FENCE = re.compile(rb"^([ \t]*)(```+|~~~+)[ \t]*([\w+.-]*)[^\n]*\n(.*?)(?:^[ \t]*\2|\Z)", re.S | re.M)
_SETTINGS = {b"env", b"ini", b"toml", b"yaml", b"yml", b"properties", b"cfg", b"conf", b"sh", b"bash", b"shell", b"console", b"dotenv", b"dockerfile"}


def is_settings(b: bytes) -> bool:
    """Whether most lines read as settings."""
    if b.startswith(b"#!"):
        return True
    lines = [x for x in b.splitlines() if x.strip()]
    plain = [x for x in lines if not _NO_LINE.match(x)]
    if not plain:  # only comments: settings if they are commented with the marks of settings
        return bool(lines) and all(re.match(rb"\s*[;#]", x) for x in lines)
    return sum(bool(_CONFIG_LINE.match(x)) for x in plain) >= 0.6 * len(plain)


def _structured(b: bytes, begin: int, end: int, tag: bytes = b"") -> Iterator[Entry]:
    body = b[begin:end]
    head = body.lstrip()[:1]
    if head == b"{" or head == b"[" and not _SECTION.match(body.lstrip().split(b"\n", 1)[0]):
        yield from json_entries(b, begin, end)
    elif head == b"<":
        yield from xml_entries(b, begin, end)
    elif tag in _SETTINGS or is_settings(body):
        yield from line_entries(b, begin, end)


def fences(b: bytes) -> list[re.Match]:
    """Fenced blocks of Markdown; group 3 is their tag, group 4 their body."""
    return list(_FENCE.finditer(b)) if b"```" in b or b"~~~" in b else []


def entries(b: bytes, wanted: re.Pattern) -> Iterator[Entry]:
    """All entries of a text by its format; of Markdown, those of its fenced blocks by theirs. ``wanted`` is what every key that
    matters holds somewhere."""
    head = b.lstrip()[:1]
    blocks = fences(b) if head not in (b"{", b"<") else []
    if blocks:
        for f in blocks:
            yield from _structured(b, f.start(4), f.end(4), f[3].lower())
    else:
        yield from _structured(b, 0, len(b))
    yield from literal_entries(b, 0, len(b), wanted)
    yield from command_entries(b, 0, len(b))


# ---- statements -----------------------------------------------------------------------------------------------------

_COMMENT = re.compile(
    rb"(?:^|(?<=[\s;{})]))(?://[/!]*|\#(?!\[|!\[|!/|[ \t]*(?:include|define|if|ifdef|ifndef|elif|else|endif|pragma|undef)\b)\#*|--(?=[ \t]))[ \t]*([^\n]*)"
    rb"|^[ \t]*;+[ \t]*([^\n]*)|/\*+!?(.*?)(?:\*/|\Z)|<!--(.*?)(?:-->|\Z)",
    re.S | re.M,
)
_ROW = re.compile(rb"[^\r\n]+")
_DECOR = re.compile(rb"[ \t]*(?:\*+(?![\w])[ \t]*|[-+*][ \t]+|>[ \t]*|\d+\.[ \t]+)?")


def statements(b: bytes, values: list[Entry]) -> Iterator[tuple[int, int]]:
    """Places of what is written for readers: comments line by line, prose of Markdown, and values that hold several words."""
    for m in _COMMENT.finditer(b):
        g = m.lastindex
        if g:
            for row in _ROW.finditer(b, m.start(g), m.end(g)):
                lead = _DECOR.match(b, row.start(), row.end()).end()
                if lead < row.end():
                    yield lead, row.end()
    for e in values:
        if e.quoted and b" " in b[e.start : e.end]:
            yield e.start, e.end
    if blocks := fences(b):
        at = 0
        for f in [*blocks, None]:
            for row in _ROW.finditer(b, at, f.start() if f else len(b)):
                lead = _DECOR.match(b, row.start(), row.end()).end()
                if lead < row.end():
                    yield lead, row.end()
            at = f.end() if f else at
