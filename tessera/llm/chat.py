"""Chat formatting with a small template compiler.

The template language is a sandbox: text, ``{{ expression }}``, ``{% for x in y %}``,
``{% if %}/{% elif %}/{% else %}``, ``{% set x = e %}`` and ``{% generation %}`` blocks, whose
output is marked as generated.  Expressions have strings, integers, names, fields,
``==  !=  and or not + ~ in``, parentheses and the filters ``upper lower trim escape``; no
calls, no attributes of Python objects, no loops but over given lists.  A template is
parsed into a syntax tree, constants are folded, and the tree becomes Python closures.

Texts are escaped reversibly: the escape sign and every control string inside a text get
an escape sign in front of each of their brackets, so that no text can open a turn.

A conversation is its rows ordered by turn (null first; ties by role and text).  A null text or role
is empty.  Rows without conv_id form one conversation without id.  Turns stream through a sorted
partition, so a conversation is never gathered, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

# --- reversible escaping -----------------------------------------------------------

#: fixed values: strings that would be read as control when they stand in a text
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>")
ESCAPE = "\\"
_ESCAPED = re.compile("|".join(re.escape(x) for x in (ESCAPE, *CONTROL)))
_BACK = re.compile(re.escape(ESCAPE) + "(.)", re.S)


def escape(text: str) -> str:
    """An escape sign goes before each escape sign and each control string; the latter also get one before their last sign."""
    return _ESCAPED.sub(lambda m: ESCAPE + m[0] if m[0] == ESCAPE else ESCAPE + m[0][:-1] + ESCAPE + m[0][-1], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


# --- template language ---------------------------------------------------------------


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    expr: object


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body)
    other: tuple = ()


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[()\[\].|+~]))""")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}
FILTERS: dict[str, Callable[[str], str]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "escape": escape}
_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}", "in": lambda a, b: a in b}


class _Expr:
    """Recursive descent over one expression."""

    def __init__(self, src: str):
        self.toks, at, src = [], 0, src.strip()
        while at < len(src):
            m = _TOKEN.match(src, at)
            if not m:
                raise TemplateError(f"can't read {src[at:]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.toks) and self.toks[self.at][0] != "str" and self.toks[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.toks):
            raise TemplateError("the expression ends early")
        self.at += 1
        return self.toks[self.at - 1]

    def whole(self):
        e = self.either()
        if self.at < len(self.toks):
            raise TemplateError(f"left over: {self.toks[self.at][1]!r}")
        return e

    def _chain(self, below, *ops):
        e = below()
        while self.peek(*ops):
            e = Op(self.take()[1], (e, below()))
        return e

    def either(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        return self._chain(self.joined, "==", "!=", "in")

    def joined(self):
        return self._chain(self.filtered, "+", "~")

    def filtered(self):
        e = self.atom()
        while self.peek(".", "[", "|"):
            kind = self.take()[1]
            what, name = self.take()
            if kind == "[":
                if what != "str" or not self.peek("]"):
                    raise TemplateError("only ['name'] is allowed")
                self.take()
                name = name[1:-1]
            if kind == "|":
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                e = Op("|" + name, (e,))
            else:
                if name.startswith("_"):
                    raise TemplateError(f"{name!r} can't be reached")
                e = Field(e, name)
        return e

    def atom(self):
        kind, v = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1]))
        if kind == "int":
            return Const(int(v))
        if v == "(":
            e = self.either()
            if not self.peek(")"):
                raise TemplateError("a bracket isn't closed")
            self.take()
            return e
        if kind == "name" and v not in _WORDS:
            if v.startswith("_"):
                raise TemplateError(f"{v!r} can't be reached")
            return Name(v)
        if v in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[v])
        raise TemplateError(f"unexpected {v!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    pos = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        body: list = []
        while pos < len(parts):
            kind, src = parts[pos]
            pos += 1
            word = src.split(None, 1)[0] if kind == "tag" and src else ""
            if kind == "text":
                if src:
                    body.append(Out(Const(src)))
            elif kind == "out":
                body.append(Out(_Expr(src).whole()))
            elif word in ends:
                return tuple(body), src
            elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=(.+)", src, re.S)):
                body.append(Set(m[1], _Expr(m[2]).whole()))
            elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", src, re.S)):
                body.append(For(m[1], _Expr(m[2]).whole(), block("endfor")[0]))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            elif word == "if":
                cases, other, end = [], (), src
                while end.split(None, 1)[0] in ("if", "elif"):
                    cond = _Expr(end.split(None, 1)[1]).whole()
                    inner, end = block("elif", "else", "endif")
                    cases.append((cond, inner))
                if end == "else":
                    other, end = block("endif")
                body.append(If(tuple(cases), other))
            else:
                raise TemplateError(f"unexpected tag {src!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), ""

    return block()[0]


def _apply(op: str, args: list):
    if op == "not":
        return not args[0]
    if op == "and":
        return args[0] and args[1]
    if op == "or":
        return args[0] or args[1]
    if op[0] == "|":
        return FILTERS[op[1:]](_text(args[0]))
    try:
        return _BINARY[op](*args)
    except TypeError as e:
        raise TemplateError(f"{op} can't take these values") from e


def _folded(node):
    """The constant that an operation on constants gives; one that fails stays, and fails only if it is reached."""
    try:
        return Const(_apply(node.op, [x.value for x in node.args]))
    except TemplateError:
        return node


def fold(node):
    """The tree with constant expressions computed, dead branches gone and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Out) and isinstance(y.expr, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].expr, Const):
                    out[-1] = Out(Const(_text(out[-1].expr.value) + _text(y.expr.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(x) for x in node.args)
        return _folded(Op(node.op, args)) if all(isinstance(x, Const) for x in args) else Op(node.op, args)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Out):
        return Out(fold(node.expr))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        cases = []
        for cond, body in node.cases:
            cond = fold(cond)
            if isinstance(cond, Const):
                if cond.value:
                    return If(tuple(cases), fold(body)) if cases else fold(body)
                continue
            cases.append((cond, fold(body)))
        return If(tuple(cases), fold(node.other)) if cases else fold(node.other)
    return node


def _text(v) -> str:
    return "" if v is None else str(v)


@dataclass
class Rendering:
    """What closures write to: pieces of text, and spans [start, end) of generated characters."""

    parts: list[str] = field(default_factory=list)
    spans: list[list[int]] = field(default_factory=list)
    size: int = 0

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        v = node.value
        return lambda env: v
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Field):
        of, name = _value(node.of), node.name

        def get(env):
            x = of(env)
            return x.get(name) if isinstance(x, dict) else None

        return get
    args, op = [_value(x) for x in node.args], node.op
    if op == "and":
        return lambda env: args[0](env) and args[1](env)
    if op == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env: _apply(op, [a(env) for a in args])


def _statement(node) -> Callable[[dict, Rendering], None]:
    if isinstance(node, Out):
        v = _value(node.expr)
        return lambda env, out: out.write(_text(v(env)))
    if isinstance(node, Set):
        v, name = _value(node.expr), node.name

        def put(env, out):
            env[name] = v(env)

        return put
    if isinstance(node, If):
        cases, other = [(_value(c), _body(b)) for c, b in node.cases], _body(node.other)

        def choose(env, out):
            for c, b in cases:
                if c(env):
                    return b(env, out)
            return other(env, out)

        return choose
    if isinstance(node, For):
        over, body, name = _value(node.over), _body(node.body), node.name

        def loop(env, out):
            inner = dict(env)
            for x in over(env) or ():
                inner[name] = x
                body(inner, out)

        return loop
    if isinstance(node, Generation):
        body = _body(node.body)

        def mark(env, out):
            start = out.size
            body(env, out)
            out.spans.append([start, out.size])

        return mark
    raise TemplateError(f"can't compile {node!r}")


def _body(nodes: tuple) -> Callable[[dict, Rendering], None]:
    steps = [_statement(x) for x in nodes]

    def run(env, out):
        for s in steps:
            s(env, out)

    return run


def compile_template(source: str) -> Callable[[dict], Rendering]:
    """A function from variables to a rendering."""
    body = _body(fold(parse(source)))

    def render(env: dict) -> Rendering:
        out = Rendering()
        body(dict(env), out)
        return out

    return render


#: what stands before the first turn, one turn, and what closes a conversation; a turn is a template of its own so that conversations stream
OPENING = "<s>"
TURN = "<|turn|>{{ message.role | escape }}<|text|>{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}<|end|>"
CLOSING = "</s>"
_READ = re.compile(r"<\|turn\|>((?:[^\\<]|\\.|<(?!\|text\|>))*)<\|text\|>((?:[^\\<]|\\.|<(?!\|end\|>))*)<\|end\|>", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text and the place of the (escaped) text of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, turn_template: str = TURN, opening: str = OPENING, closing: str = CLOSING) -> DataFrame:
    """The formatted text in parts, one row for each turn: conv_id, part, formatted, spans of generated characters.

    A conversation's text is its parts joined in order; the opening belongs to the first
    part, and the last part is the closing alone (part = number of turns).
    """

    def run(batches):
        turn, first, last = compile_template(turn_template), compile_template(opening), compile_template(closing)
        now, k = object(), 0

        def close():
            return (now, k, last({}).text, [])

        for b in batches:
            rows = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                head = ""
                if c != now or k == 0:
                    if k:
                        rows.append(close())
                    now, k, head = c, 0, first({}).text
                r = turn({"message": {"role": role, "text": text}})
                rows.append((c, k, head + r.text, [{"start": x + len(head), "end": y + len(head)} for x, y in r.spans]))
                k += 1
            yield _parts(rows)
        if k:
            yield _parts([close()])

    return _sorted_turns(conversations).mapInArrow(run, "conv_id long, part long, formatted string, spans array<struct<start:long,end:long>>")


def _parts(rows: list) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return batch(conv_id=pa.array([r[0] for r in rows], pa.int64()), part=pa.array([r[1] for r in rows], pa.int64()), formatted=pa.array([r[2] for r in rows], pa.string()), spans=pa.array([r[3] for r in rows], spans))


def digest(formatted: DataFrame, opening: str = OPENING, closing: str = CLOSING) -> DataFrame:
    """Reads formatted parts back, in order and one at a time, into a row for each conversation.

    `formatted` comes from format_conversations(): a conversation's parts stand together and in order.
    """

    def run(batches):
        now = None
        for b in batches:
            rows = []
            for c, k, text, spans in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k == 0:
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[5] += len(text)
                body = text.removeprefix(opening) if k == 0 else text
                if body == closing:
                    rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    continue
                for role, said, _, _ in read_turns(body):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    own = unescape(text[s["start"] : s["end"]])
                    now[3] += len(own)
                    now[4].update(own.encode("utf-8", "surrogatepass"))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
