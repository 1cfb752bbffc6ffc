"""A small packrat parser for parsing-expression grammars over source text.

A grammar is a dict of rules; a rule is a regular expression (a string, or one compiled), a reference ``R(name)``, or built
from `seq`, `alt`, `many`, `opt`, `no`, `ahead` and `cap`. Rules are memoised by position, so a parse is linear in the text
whatever the grammar tries. `cap` keeps the offsets of what it matched; what a rule captured is handed on with its end.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: What a parser gives: where it ended and (label, start, end) of its captures; None if it failed.
Result = tuple[int, tuple] | None


class R(str):
    """A reference to a rule."""


def seq(*parts):
    return ("seq", parts)


def alt(*parts):
    return ("alt", parts)


def many(part, least: int = 0):
    return ("many", part, least)


def opt(part):
    return ("alt", (part, ""))


def no(part):
    return ("no", part)


def ahead(part):
    return ("ahead", part)


def cap(label: str, part):
    return ("cap", label, part)


class Grammar:
    """Compiles rules to functions of (text, position, memo)."""

    def __init__(self, rules: dict):
        self.rules: dict[str, Callable] = {}
        for name, body in rules.items():
            self.rules[name] = self._memoised(name, self._make(body))

    def _memoised(self, name: str, f: Callable) -> Callable:
        def run(text: str, at: int, memo: dict) -> Result:
            key = (name, at)
            if key not in memo:
                memo[key] = f(text, at, memo)
            return memo[key]

        return run

    def _make(self, p) -> Callable:
        if isinstance(p, R):
            rules, name = self.rules, str(p)
            return lambda text, at, memo: rules[name](text, at, memo)
        if isinstance(p, (str, re.Pattern)):
            match = re.compile(p, re.S | re.M).match if isinstance(p, str) else p.match

            def token(text: str, at: int, memo: dict) -> Result:
                m = match(text, at)
                return (m.end(), ()) if m else None

            return token
        kind = p[0]
        if kind == "seq":
            parts = [self._make(x) for x in p[1]]

            def sequence(text: str, at: int, memo: dict) -> Result:
                got: tuple = ()
                for f in parts:
                    r = f(text, at, memo)
                    if r is None:
                        return None
                    at = r[0]
                    if r[1]:
                        got += r[1]
                return at, got

            return sequence
        if kind == "alt":
            choices = [self._make(x) for x in p[1]]

            def choice(text: str, at: int, memo: dict) -> Result:
                for f in choices:
                    r = f(text, at, memo)
                    if r is not None:
                        return r
                return None

            return choice
        if kind == "many":
            one, least = self._make(p[1]), p[2]

            def repeat(text: str, at: int, memo: dict) -> Result:
                got: list = []
                n = 0
                while True:
                    r = one(text, at, memo)
                    if r is None or r[0] == at:
                        break
                    at, n = r[0], n + 1
                    got += r[1]
                return (at, tuple(got)) if n >= least else None

            return repeat
        if kind in ("no", "ahead"):
            inner, want = self._make(p[1]), kind == "ahead"
            return lambda text, at, memo: (at, ()) if (inner(text, at, memo) is not None) == want else None
        label, inner = p[1], self._make(p[2])

        def capture(text: str, at: int, memo: dict) -> Result:
            r = inner(text, at, memo)
            return None if r is None else (r[0], ((label, at, r[0]), *r[1]))

        return capture

    def emit(self, text: str, item: str, action: Callable[[str, tuple], object | None], between: re.Pattern | None = None) -> list:
        """Parses text as a row of items and gives what the action makes of each one's captures (nothing for None).
        What ``between`` matches is passed over at once: no item that matters may begin in it. A character that no item begins
        with is passed over too, so every text is read to its end."""
        f, at, out = self.rules[item], 0, []
        memo: dict = {}
        while at < len(text):
            if between is not None and (m := between.match(text, at)):
                at = m.end()
                if at == len(text):
                    break
            try:
                r = f(text, at, memo)
            except RecursionError:  # brackets nested deeper than Python's calls may be: no function's head
                r = None
                memo.clear()
            if r is None or r[0] == at:
                at += 1
                continue
            at = r[0]
            if r[1] and (made := action(text, r[1])) is not None:
                out.append(made)
            memo.clear()  # positions before an item's end are not asked for again
        return out
