"""Text to syntax tree."""

from __future__ import annotations

import re

from . import vocabulary as V
from .ast import Call, Constant, ExpressionError, Feature, Window, check_limits

_TOKENS = re.compile(r"\s*(?:(\$[A-Za-z]+)|([A-Za-z]+)|([+-]?(?:\d+\.\d*|\.\d+|\d+))|([(),]))")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ExpressionError(f"can't read {text[at:]!r}")
        out.append((("feature", "name", "number", "mark")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    return out


def parse(text: str):
    """The tree of an expression within the language's limits; nothing may follow it."""
    toks = _tokens(text)
    at = 0

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(toks) or value not in (None, toks[at][1]):
            raise ExpressionError(f"expected {value or 'an expression'} in {text!r}")
        at += 1
        return toks[at - 1]

    def node(window: bool = False):
        kind, v = take()
        if kind == "feature":
            return Feature(v[1:].lower())
        if kind == "number":
            return Window(int(float(v))) if window and float(v).is_integer() else Constant(float(v))
        if kind != "name" or v not in V.OPERATORS:
            raise ExpressionError(f"unexpected {v!r}")
        n, windowed = V.OPERATORS[v]
        take("(")
        args = []
        while True:
            args.append(node(windowed and len(args) == n))
            if toks[at : at + 1] == [("mark", ",")]:
                take(",")
                continue
            take(")")
            return Call(v, tuple(args))

    tree = node()
    if at < len(toks):
        raise ExpressionError(f"left over: {toks[at][1]!r}")
    check_limits(tree)
    return tree


def parse_tagged(response: str):
    """The expression of a response that is one <expr>...</expr> and nothing else but white space."""
    whole = response.strip()
    if not (len(whole) > 12 and whole[:6].lower() == "<expr>" and whole[-7:].lower() == "</expr>"):
        raise ExpressionError("the response is not one tagged expression")
    return parse(whole[6:-7].strip())
