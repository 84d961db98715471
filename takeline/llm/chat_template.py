"""Compiler for a small sandboxed template language.

``parse`` builds a syntax tree, ``fold`` evaluates what does not depend on the input, and ``compile_template``
turns the tree into Python closures.  A rendered template is a lazy stream of events, so a conversation of any
length is rendered turn by turn:

* ``("text", s)``: a piece of output,
* ``("begin", "")`` and ``("end", "")``: the marks of ``{% generation %} ... {% endgeneration %}``.

Sandbox: names and dotted names look up keys of dicts only, filters come from a fixed table, and there are no
calls, no Python attributes and no unbounded loops.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

Event = tuple[str, str]

#: Control strings of the default template; see ``escape_controls``.
CONTROL = re.compile(r"\\|[<\[](?=/?(?:s>|INST\]))")


def escape_controls(text: str) -> str:
    """Double each backslash and put one behind the first character of a control string; reversible."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape_controls(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


FILTERS: dict[str, Callable[[object], object]] = {
    "controls": lambda x: escape_controls(_text(x)),
    "line": lambda x: _text(x).replace("\\", "\\\\").replace("\n", "\\n"),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: 0 if x is None else len(x),
}


class TemplateError(ValueError):
    """The template is not in the language."""


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


TOKEN = re.compile(r"""\s*(?:(?P<str>'[^']*'|"[^"]*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.~()\[\]]))""")


class _Expression:
    """Recursive descent over one expression; nodes are ``(kind, *parts)``."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(source.rstrip())
        while at < end:
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        for op in ("==", "!=", "in"):
            if self.take(op):
                return (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take("~"):
            node = ("~", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        if kind == "op":
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        if kind == "str":
            return ("const", value[1:-1].encode().decode("unicode_escape") if value.isascii() else value[1:-1])
        if kind == "int":
            return ("const", int(value))
        if value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        node = ("name", value)
        while self.take("."):
            node = ("key", node, self.name())
        return node


def parse(source: str) -> list[tuple]:
    """Statements: text, out, set, if, for, generation."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.DOTALL)
    root: list[tuple] = []
    stack: list[tuple[str, tuple, list]] = []  # kind, what the closing tag needs, the body that is being filled
    body = root
    for piece in pieces:
        if piece.startswith("{#"):
            continue
        if piece.startswith("{{"):
            body.append(("out", _Expression(piece[2:-2]).whole()))
        elif piece.startswith("{%"):
            word, _, rest = piece[2:-2].strip().strip("-").strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
                if not m:
                    raise TemplateError(f"cannot read {piece!r}")
                stack.append(("for", (m[1], _Expression(m[2]).whole()), body))
                body = []
                stack.append(("", (), body))
            elif word == "if":
                stack.append(("if", ([],), body))
                body = []
                stack.append(("", (_Expression(rest).whole(),), body))
            elif word == "generation":
                stack.append(("generation", (), body))
                body = []
                stack.append(("", (), body))
            elif word in ("elif", "else"):
                if len(stack) < 2 or stack[-2][0] != "if":
                    raise TemplateError(f"{word} outside if")
                _, (test,), filled = stack.pop()
                stack[-1][1][0].append((test, filled))
                body = []
                stack.append(("", (_Expression(rest).whole() if word == "elif" else ("const", True),), body))
            elif word in ("endfor", "endif", "endgeneration"):
                if len(stack) < 2 or stack[-2][0] != word[3:]:
                    raise TemplateError(f"{word} closes nothing")
                _, test, filled = stack.pop()
                kind, head, outer = stack.pop()
                if kind == "for":
                    outer.append(("for", *head, filled))
                elif kind == "if":
                    outer.append(("if", [*head[0], (test[0], filled)]))
                else:
                    outer.append(("generation", filled))
                body = outer
            elif word == "set":
                name, _, value = rest.partition("=")
                body.append(("set", name.strip(), _Expression(value).whole()))
            else:
                raise TemplateError(f"no statement {word!r}")
        elif piece:
            body.append(("text", piece))
    if stack:
        raise TemplateError(f"{stack[-2][0]} is not closed")
    return root


def _evaluate(node: tuple, env: dict) -> object:
    return _closure(node)(env)


def fold_expression(node: tuple) -> tuple:
    """Replace each subtree of constants by its value."""
    if node[0] in ("const", "name"):
        return node
    parts = tuple(fold_expression(x) if isinstance(x, tuple) else x for x in node[1:])
    node = (node[0], *parts)
    if node[0] in ("or", "and") and parts[0][0] == "const":
        return parts[bool(parts[0][1]) == (node[0] == "and")]
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _evaluate(node, {}))
    return node


def fold(body: list[tuple]) -> list[tuple]:
    """Constant output becomes text, neighbouring texts join, and branches with a constant test are decided."""
    out: list[tuple] = []
    for node in body:
        new: list[tuple]
        if node[0] == "out":
            value = fold_expression(node[1])
            new = [("text", _text(value[1]))] if value[0] == "const" else [("out", value)]
        elif node[0] == "set":
            new = [("set", node[1], fold_expression(node[2]))]
        elif node[0] == "for":
            new = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1]))]
        elif node[0] == "if":
            cases = []
            for test, then in node[1]:
                test = fold_expression(test)
                if test[0] == "const" and not test[1]:
                    continue
                cases.append((test, fold(then)))
                if test[0] == "const":
                    break
            new = cases[0][1] if cases and cases[0][0][0] == "const" else [("if", cases)] if cases else []
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _closure(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "key":
        of = _closure(node[1])
        return lambda env, key=node[2]: x.get(key) if isinstance(x := of(env), dict) else None
    if kind == "filter":
        apply, of = FILTERS[node[1]], _closure(node[2])
        return lambda env: apply(of(env))
    a = _closure(node[1])
    if kind == "not":
        return lambda env: not a(env)
    b = _closure(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "==":
        return lambda env: a(env) == b(env)
    if kind == "!=":
        return lambda env: a(env) != b(env)
    if kind == "in":
        return lambda env: a(env) in (b(env) or ())
    return lambda env: _text(a(env)) + _text(b(env))


def _numbered(items: Iterable) -> Iterator[tuple[object, dict]]:
    """Items with ``loop`` values; reads one item ahead to know the last."""
    items = iter(items)
    try:
        now = next(items)
    except StopIteration:
        return
    index = 0
    for after in items:
        yield now, {"index0": index, "index": index + 1, "first": index == 0, "last": False}
        now, index = after, index + 1
    yield now, {"index0": index, "index": index + 1, "first": index == 0, "last": True}


def _statements(body: list[tuple]) -> Callable[[dict], Iterator[Event]]:
    runs = [_statement(x) for x in body]

    def run(env: dict) -> Iterator[Event]:
        for x in runs:
            yield from x(env)

    return run


def _statement(node: tuple) -> Callable[[dict], Iterator[Event]]:
    kind = node[0]
    if kind == "text":
        event = ("text", node[1])
        return lambda env: (event,)
    if kind == "out":
        value = _closure(node[1])
        return lambda env: (("text", _text(value(env))),)
    if kind == "set":
        value = _closure(node[2])

        def assign(env: dict) -> tuple:
            env[node[1]] = value(env)
            return ()

        return assign
    if kind == "generation":
        inner = _statements(node[1])

        def marked(env: dict) -> Iterator[Event]:
            yield ("begin", "")
            yield from inner(env)
            yield ("end", "")

        return marked
    if kind == "for":
        items, inner = _closure(node[2]), _statements(node[3])

        def loop(env: dict) -> Iterator[Event]:
            for item, numbers in _numbered(items(env) or ()):
                yield from inner({**env, node[1]: item, "loop": numbers})

        return loop
    cases = [(_closure(test), _statements(then)) for test, then in node[1]]

    def choose(env: dict) -> Iterator[Event]:
        for test, then in cases:
            if test(env):
                yield from then(env)
                return

    return choose


def compile_template(source: str) -> Callable[[dict], Iterator[Event]]:
    """Parse, fold and close over; the result maps an environment to a stream of events."""
    run = _statements(fold(parse(source)))
    return lambda env: run(dict(env))
