"""A scanner of source texts: what they declare, call and import, with line spans. Plain Python, one text at a time."""

from __future__ import annotations

import re
from bisect import bisect_right

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?"
_CHAR = r"'(?:\\[^\n']*|[^'\\\n])'"
_QUOTED1 = r"'(?:\\.|[^'\\\n])*'?"
_FORMS = {
    "rust": rf"{_C}|#!?\[(?:[^\[\]]|\[[^\]]*\])*\]|\bb?r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"?|{_CHAR}",
    "python": r"#[^\n]*|\b[rRbBuUfF]{0,2}(\"\"\"|''').*?(?:\1|\Z)|\b[rRbBuUfF]{1,2}(?:" + _QUOTED + "|" + _QUOTED1 + ")|(\"\"\"|''').*?(?:\\2|\\Z)|" + _QUOTED + "|" + _QUOTED1,
    "typescript": rf"{_C}|`(?:\\.|[^`\\])*`?|{_QUOTED}|{_QUOTED1}|(?<=[=(,:;!&|?{{}}\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\n\\\[])+/",
    "c": rf"{_C}|\bR\"(\w*)\(.*?\)\1\"|{_QUOTED}|{_CHAR}", "go": rf"{_C}|`[^`]*`?|{_QUOTED}|{_CHAR}", "java": rf"{_C}|\"\"\".*?\"\"\"|{_QUOTED}|{_CHAR}",
}
_FORMS |= {"cpp": _FORMS["c"], "kotlin": _FORMS["java"], "javascript": _FORMS["typescript"], "mojo": _FORMS["python"]}
_FORMS = {k: re.compile(v, re.S) for k, v in _FORMS.items()}
_BRACED = {"rust", "typescript", "javascript", "c", "cpp", "go", "java", "kotlin"}
_BLANK = re.compile(r"[^\n]")
_TYPED = re.compile(r"(?<=[\w\x01:])<(?:[\w\s:,'*\[\].?;\x01]|->|=(?!=)|&(?!&)|\|(?!\|))*>")
_OWN = r"(?:(?:[A-Za-z_]\w*|self)(?:(?:::)?\x01+)?(?:::|\.|\?\.|->)\s*)*"
_CALL = re.compile(rf"(?<![\w\x01])({_OWN}[A-Za-z_]\w*!?)(?:(?:::)?\x01+)?(?:\?\.)?\s*\(", re.A)
_ENUM = re.compile(r"\benum\b(?:\s+(?:class|struct)\b)?(?:\s+(\w+))?(?:\s*:\s*[\w:][\w:\s]*)?\s*\{([^{}]*)\}")
_ENUMERATOR = re.compile(r"(?<=[{,])\s*([A-Za-z_]\w*)[^,]*")
_DECLARED = re.compile(r"\b(?:fn|def|func|fun|function\s*\*?|class|struct|enum|macro_rules!)\s*$")
KEYWORDS = set(
    "if for while switch return catch fn def func function match else elif in not and or sizeof await new typeof defined let const var mut ref pub async as use impl dyn where yield lambda move is case void export from".split()
)

_STATEMENTS = {"import", "assert", "del", "raise", "with", "except", "global", "nonlocal"}  # of Python


def _mask(text: str, language: str) -> str:
    """The text without what comments and strings hold, character for character; what interpolations hold stays."""

    def blank(m: re.Match) -> str:
        s, empty = m.group(), lambda x: _BLANK.sub(" ", x)
        head = re.match(r"[rRbBuUfF]*(\"\"\"|'''|[\"'`])", s)
        if not head or s.startswith(("//", "/*")):
            return empty(s)
        begin, kept = len(head.group()), []
        if s[0] == "`" and language in ("typescript", "javascript"):
            kept = re.finditer(r"\$\{([^{}`]*)\}", s)
        elif language in ("python", "mojo") and "f" in head.group().lower():
            kept = re.finditer(r"(?<!\{)\{([^{}]*)\}(?!\})", s)
        out = [s[:begin], empty(s[begin:-1]), s[-1] if len(s) > begin else ""]
        made = "".join(out)
        for k in kept:
            made = made[: k.start(1)] + re.sub(r"[\"'`][^\"'`]*[\"'`]", lambda q: empty(q.group()), k.group(1)) + made[k.end(1) :]
        return made

    form = _FORMS.get(language)
    return form.sub(blank, text) if form else text


def _nested(masked: str) -> tuple[list[int], dict[int, int], list[tuple[int, int]]]:
    """Per line the depth of brackets at its start; where opened brackets close; the places and depths of ``{`` and ``;``."""
    open_, close, depths, stops = [], {}, [0], []
    for m in re.finditer(r"[()\[\]{};\n]", masked):
        c, at = m.group(), m.start()
        if c == "\n":
            depths.append(len(open_))
        elif c in "([{":
            if c == "{":
                stops.append((at, len(open_)))
            open_.append(at)
        elif c == ";":
            stops.append((at, len(open_)))
        elif open_:
            close[open_.pop()] = at
    return depths, close, stops


class Source:
    """A text with its lines, and what is found in it."""

    def __init__(self, text: str, language: str | None, forms: dict):
        self.text, self.language = text.replace("\r\n", "\n"), language or ""
        self.masked = _mask(self.text, self.language)
        self.raw, self.lines = self.text.split("\n"), self.masked.split("\n")
        if self.raw and self.raw[-1] == "":
            self.raw, self.lines = self.raw[:-1], self.lines[:-1]
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.forms = forms.get(self.language, [])
        self.heads: set[int] = set()  # where declared functions' names end
        self._found = self._declarations()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def _declarations(self) -> list[tuple]:
        found = []
        for i, line in enumerate(self.lines):
            if not re.search(r"\w", line, re.A):
                continue
            for kind, form, *glue in self.forms:
                m = form.search(line)
                if m and kind == "method" and self.language in ("typescript", "javascript") and line.count("(", m.end(1)) != line.count(")", m.end(1)):
                    m = None  # the bracket stays open: a call with a function in it
                if m:
                    name = (m.group(1) or "") + (glue[0] + (m.group(2) or "") if glue else "")
                    if kind in ("function", "method"):
                        self.heads.add(self.starts[i] + m.end(1))
                    found.append((i, len(line) - len(line.lstrip(" \t\x0b\f\r")), kind, name))
                    break
        return found

    def _ends(self) -> dict[int, int]:
        """The last line, from 0, of each declaration, by the line it begins on."""
        lines, out, n = self.lines, {}, len(self.lines)
        if self.language in ("python", "mojo"):
            depths, _, _ = _nested(self.masked)
            open_, last, joined = [], 0, False
            triple = self._inside_strings()
            for i, line in enumerate(lines):
                if line.strip():
                    if not depths[i] and i not in triple and not joined:
                        indent = len(line) - len(line.lstrip())
                        while open_ and open_[-1][0] >= indent:
                            out[open_.pop()[1]] = last
                        open_.append((indent, i))
                    last = i
                joined = line.rstrip().endswith("\\")
            return out | {i: last for _, i in open_}
        if self.language in _BRACED:
            depths, close, stops = _nested(self.masked)
            wanted = {i: kind for i, _, kind, _ in self._found}
            nxt: dict[int, list] = {}
            k = len(stops) - 1
            for i in range(n - 1, -1, -1):
                while k >= 0 and stops[k][0] >= self.starts[i]:
                    at, depth = stops[k]
                    nxt[depth] = (at, nxt.get(depth))
                    k -= 1
                if i not in wanted:
                    continue
                low = self.starts[i] + len(lines[i]) - len(lines[i].lstrip())
                here = nxt.get(depths[i])
                while here and here[0] < low:
                    here = here[1]
                # a statement of the same depth, unless the block around ends before
                flat = wanted[i] in ("constant", "type", "static")
                if lines[i].lstrip().startswith("#"):  # a preprocessor line and those it goes on to
                    j = i
                    while j + 1 < n and lines[j].rstrip().endswith("\\"):
                        j += 1
                    out[i] = j
                    continue
                if flat and self.language == "go":
                    j = i
                    while j + 1 < n and depths[j + 1] > depths[i]:
                        j += 1
                    out[i] = j
                    continue
                if flat:
                    while here and self.text[here[0]] == "{":
                        here = here[1]
                if not here or any(depths[j] < depths[i] for j in range(i + 1, min(self.line(here[0]) - 1, i + 200) + 1)) or lines[i].lstrip().startswith("}"):
                    out[i] = i
                    continue
                at = here[0]
                end = close.get(at, len(self.masked)) if self.masked[at] == "{" else at
                more = re.compile(r"\s*\{").match(self.masked, end + 1) if self.masked[at] == "{" and self.language in ("typescript", "javascript") else None
                if more:  # the first block was a type
                    end = close.get(more.end() - 1, len(self.masked))
                out[i] = min(self.line(end) - 1, n - 1)
        elif self.language in ("json", "css", "slint"):
            _, close, _ = _nested(self.masked)
            for i, line in enumerate(lines):
                opened = [at for at in (self.starts[i] + m.start() for m in re.finditer(r"[{\[]", line)) if at in close]
                out[i] = min(self.line(close[opened[0]]) - 1, n - 1) if opened else i
        elif self.language == "yaml":
            open_, last = [], 0
            for i, line in enumerate(lines):
                if line.strip() and not line.lstrip().startswith("#"):
                    indent = len(line) - len(line.lstrip())
                    while open_ and open_[-1][0] >= indent:
                        out[open_.pop()[1]] = last
                    open_.append((indent, i))
                    last = i
            out |= {i: last for _, i in open_}
        return out

    def _inside_strings(self) -> set[int]:
        """Lines, from 0, that begin inside of a string over several lines."""
        inside: set[int] = set()
        for m in _FORMS[self.language].finditer(self.text):
            if "\n" in m.group():
                inside.update(range(self.line(m.start()), self.line(m.end() - 1)))
        return inside

    def _doc(self, i: int) -> str | None:
        """The comment lines above a declaration; attributes and blank lines between are passed over in Rust."""
        if self.language not in ("rust", "c", "cpp"):
            return None
        out, block = [], False
        for j in range(i - 1, -1, -1):
            s = self.raw[j].strip()
            if block or (self.language != "rust" and s.endswith("*/")):
                block = not s.startswith("/*")
                out.append(re.sub(r"^/?\*+!?|\*+/$", "", s).strip())
                if not block:
                    break
            elif s.startswith("///") or (self.language != "rust" and s.startswith("//")):
                out.append(s.lstrip("/").strip())
            elif self.language == "rust" and (s.startswith("#[") or not s):
                continue
            else:
                break
        return "\n".join(x for x in reversed(out) if x) or None

    def symbols(self, types: list[str]) -> list[dict]:
        ends, out, over = self._ends(), [], []
        spanned = self.language in _BRACED or self.language in ("python", "mojo")
        for i, indent, kind, name in self._found:
            end = max(i, ends.get(i, i))
            if spanned:
                while over and over[-1][2] < i:
                    over.pop()
                owner = next((o for o in reversed(over) if o[1] < indent), None)
            else:
                owner = over[-1] if over and over[-1][1] < indent else None
            out.append({"line_no": i + 1, "kind": "method" if owner and kind == "function" else kind, "name": name, "parent": owner[0] if owner else None, "end_line": end + 1, "signature": self.raw[i].strip(), "doc": self._doc(i)})
            if kind in types:
                over.append((name, indent, end))
        return sorted(out + self._enumerators(), key=lambda s: s["line_no"]) if self.language in ("c", "cpp") else out

    def _enumerators(self) -> list[dict]:
        """The names that C enumerations list, each a constant of its enumeration."""
        out = []
        for m in _ENUM.finditer(self.masked):
            for item in _ENUMERATOR.finditer(self.masked, m.start(2), m.end(2)):
                i = self.line(item.start(1)) - 1
                shown = self.text[item.start(1) : item.end()].strip()
                out.append({"line_no": i + 1, "kind": "constant", "name": item.group(1), "parent": m.group(1), "end_line": self.line(item.end() - 1), "signature": shown, "doc": self._doc(i)})
        return out

    def calls(self, types: list[str]) -> list[dict]:
        text = self.masked
        if self.language not in ("python", "mojo", "c"):
            while True:  # type arguments, innermost first
                fewer = _TYPED.sub(lambda m: "\x01" * len(m.group()), text)
                if fewer == text:
                    break
                text = fewer
        spans = [s for s in self.symbols(types) if s["kind"] in ("function", "method")]
        firsts, most, outer = [], 0, []
        for s in spans:  # outermost ones do not overlap
            if s["line_no"] > most:
                outer.append(s)
                firsts.append(s["line_no"])
                most = s["end_line"]
        out = []
        for m in _CALL.finditer(text):
            name, at = re.sub(r"(?:::)?\x01+|\s+", "", m.group(1)), m.start(1)
            line = self.line(at)
            shown = self.lines[line - 1].lstrip()
            if name in KEYWORDS or (self.language in ("python", "mojo") and name in _STATEMENTS) or m.end(1) in self.heads or _DECLARED.search(text, max(0, at - 40), at) or (self.language in ("c", "cpp") and shown.startswith("#")):
                continue
            if self.language == "go" and re.search(r"^func\s*\([^)]*\)\s*$", text[self.starts[line - 1] : at]):
                continue
            if self.language not in _FORMS and re.match(r"//|#|/\*", shown):
                continue
            k = bisect_right(firsts, line) - 1
            inside = outer[k] if k >= 0 and outer[k]["end_line"] >= line else None
            out.append({"line_no": line, "callee": name, "caller": inside["name"] if inside else None, "caller_line": inside["line_no"] if inside else None})
        return out

    def imports(self) -> list[str]:
        out: list[str] = []
        one = lambda s: re.sub(r"\s+", " ", s).strip()
        add = lambda s: out.append(one(s)) if one(s) else None
        lang = self.language
        known = lang in _FORMS
        is_ = lambda *names: not known or lang in names
        find = lambda form: re.finditer(form, self.masked, re.M)
        raw = lambda m, g: self.text[m.start(g) : m.end(g)]
        if is_("rust"):
            for m in find(r"(?:^|[;{}])[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+([\w:{][^;]*);"):
                add(m.group(1))
        if is_("python", "mojo"):
            for m in find(r"(?:^|[;:])[ \t]*from\s+([\w.]+)\s+import\b"):
                add(m.group(1))
            for m in find(r"(?:^|[;:])[ \t]*import[ \t]+((?:[\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*(?:\\\n[ \t]*)?)?)+)[ \t]*(?=;|$|#)"):
                for part in m.group(1).split(","):
                    add(re.sub(r"\s+as\s+\w+\s*$", "", part.replace("\\", "")))
        if is_("typescript", "javascript"):
            for m in find(r"(?:^|;)[ \t]*(?:import|export)\b(?:\s+type\b)?(?:[\w\s{},*$]*?\bfrom)?\s*([\"'])([^\"'\n]*)\1"):
                add(raw(m, 2))
            for m in find(r"(?:^|;)[ \t]*import\s+\w+\s*=\s*require\s*\(\s*([\"'])([^\"'\n]*)\1"):
                add(raw(m, 2))
        if is_("go"):
            for m in find(r"^[ \t]*import\s+(?:[\w.]+[ \t]+)?([\"`])([^\"`\n]*)\1"):
                add(raw(m, 2))
            for m in find(r"^import\s*\(([^)]*)\)"):
                for s in re.finditer(r"([\"`])([^\"`\n]*)\1", m.group(1)):
                    add(self.text[m.start(1) + s.start(2) : m.start(1) + s.end(2)])
        if is_("java", "kotlin") and known:
            for m in find(r"^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)"):
                add(m.group(1))
        if is_("c", "cpp"):
            for i, line in enumerate(self.lines):
                m = re.match(r"\s*#\s*include\s*[<\"]([^>\"]+)", self.raw[i]) if line.lstrip().startswith("#") else None
                if m:
                    add(m.group(1))
        return list(dict.fromkeys(out))
