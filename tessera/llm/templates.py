"""A sandboxed template language for chat formats, compiled to Python closures.

    {{ expression }}            print; a null prints nothing
    {% for x in expression %}…{% endfor %}     with loop.index0, loop.first, loop.last
    {% if a %}…{% elif b %}…{% else %}…{% endif %}
    {% set x = expression %}
    {% generation %}…{% endgeneration %}       what the model is to learn
    {# a comment #}

Expressions have strings, integers, true, false, null, names, ``a.b`` and ``a['b']`` (only keys of mappings), ``not``,
``and``, ``or``, ``==``, ``!=``, ``<``, ``>``, ``in``, ``~`` (joins texts), ``+`` (of integers) and the filters that
the caller hands over. There are no calls, no attributes of Python objects and no loops but over given sequences, so a
template ends on any input and reaches nothing but what it is given.

A template is parsed into a tree, constants are folded, and the tree becomes closures that yield pieces of text, each
with whether it stands in a generation block. Pieces are yielded while a loop runs over an iterator, so a conversation
of any length is rendered in the memory of one turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template isn't in the language, or reaches for what it may not have."""


Filters = Mapping[str, Callable[[Any], Any]]
Piece = tuple[str, bool]

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~+<>().|,\[\]]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


# ---- the tree ----


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter with its operands."""

    what: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Let:
    name: str
    value: Any


@dataclass(frozen=True)
class When:
    cases: tuple  # of (condition, body)


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Learn:
    body: tuple


# ---- parsing ----


@dataclass
class _Tokens:
    source: str
    items: list[tuple[str, Any]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        pos, text = 0, self.source.rstrip()
        while pos < len(text):
            if not (m := _TOKEN.match(text, pos)):
                raise TemplateError(f"unexpected {text[pos : pos + 10]!r} in {self.source!r}")
            kind, value = m.lastgroup, m[m.lastgroup]
            if kind == "str":
                value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
            self.items.append((kind, int(value) if kind == "int" else value))
            pos = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in ("op", "name") and self.items[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected in {self.source!r}")

    def name(self) -> str:
        if self.at < len(self.items) and self.items[self.at][0] == "name":
            self.at += 1
            return self.items[self.at - 1][1]
        raise TemplateError(f"a name expected in {self.source!r}")

    def end(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r} in {self.source!r}")


def _either(t: _Tokens) -> Any:
    left = _both(t)
    while t.take("or"):
        left = Apply("or", (left, _both(t)))
    return left


def _both(t: _Tokens) -> Any:
    left = _negated(t)
    while t.take("and"):
        left = Apply("and", (left, _negated(t)))
    return left


def _negated(t: _Tokens) -> Any:
    return Apply("not", (_negated(t),)) if t.take("not") else _compared(t)


def _compared(t: _Tokens) -> Any:
    left = _joined(t)
    while what := t.take("==", "!=", "<", ">", "in"):
        left = Apply(what, (left, _joined(t)))
    return left


def _joined(t: _Tokens) -> Any:
    left = _filtered(t)
    while what := t.take("~", "+"):
        left = Apply(what, (left, _filtered(t)))
    return left


def _filtered(t: _Tokens) -> Any:
    value = _single(t)
    while t.take("|"):
        value = Apply(f"|{t.name()}", (value,))
    return value


def _single(t: _Tokens) -> Any:
    if t.take("("):
        value = _either(t)
        t.need(")")
    elif t.at < len(t.items) and t.items[t.at][0] in ("int", "str"):
        value = Const(t.items[t.at][1])
        t.at += 1
    elif (name := t.name()) in ("true", "false", "null"):
        value = Const({"true": True, "false": False, "null": None}[name])
    else:
        value = Name(name)
    while what := t.take(".", "["):
        value = Item(value, Const(t.name()) if what == "." else _either(t))
        if what == "[":
            t.need("]")
    return value


def parse(source: str) -> tuple:
    """The tree of a template."""
    pieces, pos = [], 0
    for m in _TAG.finditer(source):
        if m.start() > pos:
            pieces.append(("text", source[pos : m.start()]))
        if m[1] is not None or m[2] is not None:
            pieces.append(("print", m[1]) if m[1] is not None else ("tag", m[2]))
        pos = m.end()
    if pos < len(source):
        pieces.append(("text", source[pos:]))
    for kind, value in pieces:
        if kind == "text" and (left := re.search(r"\{[{%#]", value)):
            raise TemplateError(f"a tag that isn't closed: {value[left.start() : left.start() + 20]!r}")
    return _body(pieces, 0, ())[0]


def _body(pieces: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int, _Tokens | None]:
    """Nodes up to one of the end tags, the place after it, and its tokens after the keyword."""
    nodes: list = []
    while at < len(pieces):
        kind, source = pieces[at]
        at += 1
        if kind == "text":
            nodes.append(Text(source))
            continue
        t = _Tokens(source)
        if kind == "print":
            nodes.append(Print(_either(t)))
            t.end()
            continue
        word = t.name()
        if word in ends:
            t.items.insert(t.at, ("end", word))
            return tuple(nodes), at, t
        if word == "set":
            name = t.name()
            if not source.split("=", 1)[0].split() == ["set", name]:
                raise TemplateError(f"set needs a name and a value: {source!r}")
            nodes.append(Let(name, _expression(source.split("=", 1)[1])))
        elif word == "for":
            name = t.name()
            t.need("in")
            over = _either(t)
            t.end()
            inner, at, _ = _body(pieces, at, ("endfor",))
            nodes.append(Loop(name, over, inner))
        elif word == "generation":
            t.end()
            inner, at, _ = _body(pieces, at, ("endgeneration",))
            nodes.append(Learn(inner))
        elif word == "if":
            condition, cases = _either(t), []
            t.end()
            while True:
                inner, at, end = _body(pieces, at, ("elif", "else", "endif"))
                cases.append((condition, inner))
                closing = end.items[end.at][1]
                end.at += 1
                if closing == "endif":
                    break
                condition = _either(end) if closing == "elif" else Const(True)
                end.end()
            nodes.append(When(tuple(cases)))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return tuple(nodes), at, None


def _expression(source: str) -> Any:
    t = _Tokens(source)
    value = _either(t)
    t.end()
    return value


# ---- folding ----


def _printed(value: Any) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


_OPERATORS: dict[str, Callable] = {
    "not": lambda a: not a,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a is not None and b is not None and a < b,
    ">": lambda a, b: a is not None and b is not None and a > b,
    "in": lambda a, b: b is not None and a in b,
    "~": lambda a, b: _printed(a) + _printed(b),
    "+": lambda a, b: a + b,
}


def fold(node: Any, filters: Filters) -> Any:
    """The same tree with constant parts computed, dead branches gone and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x, filters)
            if isinstance(x, Print) and isinstance(x.value, Const):
                x = Text(_printed(x.value.value))
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + y.value)
                elif y != Text(""):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(fold(a, filters) for a in node.args)
        if node.what in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.what == "and") else args[0]
        if node.what not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_function(node.what, filters)(*(a.value for a in args)))
        return Apply(node.what, args)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Print):
        return Print(fold(node.value, filters))
    if isinstance(node, Let):
        return Let(node.name, fold(node.value, filters))
    if isinstance(node, Learn):
        return Learn(fold(node.body, filters))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, When):
        cases = []
        for condition, body in node.cases:
            condition = fold(condition, filters)
            if isinstance(condition, Const) and not condition.value:
                continue
            cases.append((condition, fold(body, filters)))
            if isinstance(condition, Const):
                break
        if cases and isinstance(cases[0][0], Const):
            return cases[0][1]
        return When(tuple(cases)) if cases else ()
    return node


def _function(what: str, filters: Filters) -> Callable:
    if what.startswith("|"):
        if what[1:] not in filters:
            raise TemplateError(f"unknown filter {what[1:]!r}")
        return filters[what[1:]]
    return _OPERATORS[what]


# ---- closures ----

Scope = dict[str, Any]


def _value(node: Any, filters: Filters) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope: Scope) -> Any:
            held = of(scope)
            if held is not None and not isinstance(held, Mapping):
                raise TemplateError("only keys of mappings can be reached")
            return None if held is None else held.get(key(scope))

        return item
    args = [_value(a, filters) for a in node.args]
    if node.what == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.what == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    f = _function(node.what, filters)
    if len(args) == 1:
        return lambda scope, a=args[0]: f(a(scope))
    return lambda scope, a=args[0], b=args[1]: f(a(scope), b(scope))


Render = Callable[[Scope, bool], Iterator[Piece]]


def _render(node: Any, filters: Filters) -> Render:
    if isinstance(node, tuple):
        parts = [_render(x, filters) for x in node]

        def run(scope: Scope, learn: bool) -> Iterator[Piece]:
            for part in parts:
                yield from part(scope, learn)

        return run
    if isinstance(node, Text):
        return lambda scope, learn, value=node.value: iter(((value, learn),))
    if isinstance(node, Learn):
        body = _render(node.body, filters)
        return lambda scope, learn: body(scope, True)
    if isinstance(node, Print):
        value = _value(node.value, filters)
        return lambda scope, learn: iter(((_printed(value(scope)), learn),))
    if isinstance(node, Let):
        value = _value(node.value, filters)

        def let(scope: Scope, learn: bool) -> Iterator[Piece]:
            scope[node.name] = value(scope)
            return iter(())

        return let
    if isinstance(node, When):
        cases = [(_value(c, filters), _render(b, filters)) for c, b in node.cases]

        def when(scope: Scope, learn: bool) -> Iterator[Piece]:
            for condition, body in cases:
                if condition(scope):
                    return body(scope, learn)
            return iter(())

        return when
    over, body = _value(node.over, filters), _render(node.body, filters)

    def loop(scope: Scope, learn: bool) -> Iterator[Piece]:
        items = iter(over(scope) or ())
        nothing = object()
        following = next(items, nothing)
        index = 0
        while following is not nothing:
            current, following = following, next(items, nothing)
            inner = scope | {node.name: current, "loop": {"index0": index, "first": index == 0, "last": following is nothing}}
            yield from body(inner, learn)
            index += 1

    return loop


@dataclass
class Template:
    """A compiled template; ``pieces`` renders lazily."""

    source: str
    filters: Filters = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.tree = fold(parse(self.source), self.filters)
        self._run = _render(self.tree, self.filters)

    def pieces(self, **scope: Any) -> Iterator[Piece]:
        return ((text, learn) for text, learn in self._run(dict(scope), False) if text)

    def text(self, **scope: Any) -> str:
        return "".join(text for text, _ in self.pieces(**scope))


def spans(pieces: Iterable[Piece]) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the spans of code points under the loss mask."""
    out, marked, at = [], [], 0
    for text, learn in pieces:
        out.append(text)
        if learn:
            marked.append((at, at + len(text)))
        at += len(text)
    return "".join(out), marked
