"""A sandboxed template language for chat formats, compiled to Python closures.

Templates are text with `{{ expression }}`, `{% for x in xs %} .. {% else %} .. {% endfor %}`, `{% if %} .. {% elif %} .. {% else %}
.. {% endif %}`, `{% set name = expression %}`, `{% generation %} .. {% endgeneration %}` and `{# comment #}`. A `-` inside a
tag's edge strips the white space beside it; with trim_blocks (the default) the line break after a block tag goes. Expressions
have literals, lists, names, `a.key`, `a[key]`, `+ - * / // %`, `~`, comparisons, `in`, `and or not`, `x if c else y`, filters,
`is defined`, `is none`, and the functions range, namespace and raise_exception.

Sandbox: values are strings, numbers, booleans, none, lists and mappings; `.` and `[]` read entries of mappings and lists and
never attributes of Python objects; only the filters and functions listed here can be called; range is bounded, strings
cannot be multiplied, and templates nest at most MOST_DEPTH deep.

parse() gives a syntax tree, fold() evaluates what is constant in it, Template generates the closures. Rendering yields pieces
of text and the markers BEGIN and END of generation blocks, and reads messages as a stream if the template only loops over them.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

MOST_DEPTH, MOST_RANGE = 60, 10_000
BEGIN, END = object(), object()


class TemplateError(ValueError):
    pass


# -- syntax tree ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Items:
    items: tuple


@dataclass(frozen=True)
class Get:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    named: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    none: tuple


@dataclass(frozen=True)
class Set:
    name: str
    key: str | None
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- reading ----------------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"""\s*(?:(?P<end>-?%\}|-?\}\})|(?P<number>\d+(?:\.\d+)?)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*/%~<>|.,()\[\]=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _string(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _lex(source: str, trim_blocks: bool) -> Iterator[tuple[str, Any]]:
    """("text", s), ("output", tokens) and ("block", tokens); tokens are (kind, value)."""
    at, strip = 0, False
    for_text = re.compile(r"\{[{%#]-?")
    while True:
        opened = for_text.search(source, at)
        text = source[at : opened.start() if opened else len(source)]
        if strip:
            text = text.lstrip()
        if opened and opened[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not opened:
            return
        at, kind = opened.end(), opened[0][1]
        if kind == "#":
            if (closed := source.find("#}", at)) < 0:
                raise TemplateError("a comment is not closed")
            strip, at = source[closed - 1] == "-" and closed > at, closed + 2
        else:
            tokens: list[tuple[str, str]] = []
            while not tokens or tokens[-1][0] != "end":
                m = TOKEN.match(source, at)
                if not m:
                    raise TemplateError(f"line {source.count(chr(10), 0, at) + 1}: cannot read {source[at : at + 20]!r}")
                tokens.append((m.lastgroup, m[m.lastgroup]))
                at = m.end()
            if tokens[-1][1].lstrip("-") != ("}}" if kind == "{" else "%}"):
                raise TemplateError(f"line {source.count(chr(10), 0, at) + 1}: the tag is closed by {tokens[-1][1]!r}")
            strip = tokens[-1][1][0] == "-"
            yield ("output" if kind == "{" else "block"), tokens
        if kind != "{" and trim_blocks and not strip and source[at : at + 1] == "\n":
            at += 1


class _Expressions:
    """Recursive descent over the tokens of one tag."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in", "not in", "is"), ("+", "-", "~"), ("*", "/", "//", "%"))

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at]
        return None if kind in ("end", "string", "number") else value

    def take(self, *wanted: str) -> str | None:
        if (found := self.peek()) in wanted:
            self.at += 1
            return found
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing before {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def done(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        found = self.expression()
        self.done()
        return found

    def expression(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("an expression nests too deep")
        found = self.level(0)
        if self.take("if"):
            test = self.level(0)
            found = Choice(test, found, self.expression() if self.take("else") else Const(""))
        self.depth -= 1
        return found

    def level(self, i: int):
        if i == len(self.LEVELS):
            return self.signed()
        if self.LEVELS[i] == ("not",):
            return Op("not", (self.level(i),)) if self.take("not") else self.level(i + 1)
        left = self.level(i + 1)
        while True:
            if i == 3 and self.peek() == "not" and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                left = Op("not", (Op("in", (left, self.level(i + 1))),))
            elif not (op := self.take(*self.LEVELS[i])):
                return left
            elif op == "is":
                flip, test = self.take("not"), self.name()
                if test not in ("defined", "none", "string", "true", "false"):
                    raise TemplateError(f"there is no test {test!r}")
                left = Op(f"is {test}", (left,))
                left = Op("not", (left,)) if flip else left
            else:
                left = Op(op, (left, self.level(i + 1)))

    def signed(self):
        return Op("neg", (self.signed(),)) if self.take("-") else self.postfix(self.atom())

    def atom(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(_string(value))
        if kind == "number":
            return Const(float(value) if "." in value else int(value))
        if kind == "name":
            words = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return Const(words[value]) if value in words else Name(value)
        if value == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if value == "[":
            return Items(self.arguments("]")[0])
        raise TemplateError(f"unexpected {value!r}")

    def arguments(self, close: str) -> tuple[tuple, tuple]:
        args, named = [], []
        while not self.take(close):
            if args or named:
                self.need(",")
                if self.take(close):
                    break
            if self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("sign", "=") and close == ")":
                key = self.name()
                self.need("=")
                named.append((key, self.expression()))
            else:
                args.append(self.expression())
        return tuple(args), tuple(named)

    def postfix(self, found):
        while True:
            if self.take("."):
                found = Get(found, Const(self.name()))
            elif self.take("["):
                found = Get(found, self.expression())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name!r}")
                found = Filter(name, (found, *(self.arguments(")")[0] if self.take("(") else ())))
            elif self.peek() == "(" and isinstance(found, Name):
                self.at += 1
                if found.name not in FUNCTIONS:
                    raise TemplateError(f"there is no function {found.name!r}")
                found = Call(found.name, *self.arguments(")"))
            else:
                return found


def parse(source: str, trim_blocks: bool = True) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    parts = list(_lex(source, trim_blocks))
    at = 0

    def block(ends: tuple[str, ...], depth: int) -> tuple[tuple, str | None, _Expressions | None]:
        nonlocal at
        if depth > MOST_DEPTH:
            raise TemplateError("blocks nest too deep")
        body: list = []
        while at < len(parts):
            kind, value = parts[at]
            at += 1
            if kind == "text":
                body.append(Text(value))
            elif kind == "output":
                body.append(Output(_Expressions(value).whole()))
            else:
                tag = _Expressions(value)
                word = tag.name()
                if word in ends:
                    return tuple(body), word, tag
                body.append(statement(word, tag, depth))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(body), None, None

    def conditional(tag: _Expressions, depth: int) -> If:
        test = tag.whole()
        yes, word, more = block(("elif", "else", "endif"), depth + 1)
        if word == "elif":
            return If(test, yes, (conditional(more, depth),))
        return If(test, yes, block(("endif",), depth + 1)[0] if word == "else" else ())

    def statement(word: str, tag: _Expressions, depth: int):
        if word == "if":
            return conditional(tag, depth)
        if word == "for":
            name = tag.name()
            tag.need("in")
            over = tag.whole()
            body, ended, _ = block(("else", "endfor"), depth + 1)
            return For(name, over, body, block(("endfor",), depth + 1)[0] if ended == "else" else ())
        if word == "set":
            name, key = tag.name(), tag.name() if tag.take(".") else None
            tag.need("=")
            return Set(name, key, tag.whole())
        if word == "generation":
            tag.done()
            return Generation(block(("endgeneration",), depth + 1)[0])
        raise TemplateError(f"there is no tag {word!r}")

    return block((), 0)[0]


# -- values -----------------------------------------------------------------------------------------------------------------


class Undefined:
    def __bool__(self) -> bool:
        return False


class Namespace(dict):
    """A mapping that `set name.key = value` may change."""


UNDEFINED = Undefined()


def shown(x) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)):
        return str(x)
    if x is UNDEFINED:
        return ""
    raise TemplateError(f"a {type(x).__name__} cannot be shown")


def _get(of, key):
    if isinstance(of, dict):
        return of.get(key, UNDEFINED)
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    if of is UNDEFINED:
        raise TemplateError(f"{key!r} is read from something undefined")
    return UNDEFINED


def _numbers(f: Callable) -> Callable:
    def run(a, b):
        if not all(isinstance(x, (int, float)) for x in (a, b)):
            raise TemplateError("numbers are needed")
        return f(a, b)

    return run


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
        return a + b
    return _numbers(operator.add)(a, b)


OPS: dict[str, Callable] = {
    "+": _add, "-": _numbers(operator.sub), "*": _numbers(operator.mul), "/": _numbers(operator.truediv), "//": _numbers(operator.floordiv), "%": _numbers(operator.mod),
    "~": lambda a, b: shown(a) + shown(b), "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b,
    "not": operator.not_, "neg": operator.neg, "is defined": lambda a: a is not UNDEFINED, "is none": lambda a: a is None, "is string": lambda a: isinstance(a, str), "is true": lambda a: a is True, "is false": lambda a: a is False,
}


def escape(text) -> str:
    """Texts without `<|`: each run of `<`, any number of backslashes and `|` gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", shown(text))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text) -> str:
    """escape() for texts that a line break ends: line breaks become `<n|`, which escape() leaves to no text."""
    return re.sub(r"<(\\*)(n?)\|", r"<\\\1\2|", shown(text)).replace("\n", "<n|")


def unescape_line(text: str) -> str:
    return re.sub(r"<\\(\\*)(n?)\|", r"<\1\2|", text.replace("<n|", "\n"))


FILTERS: dict[str, Callable] = {
    "escape": escape, "escape_line": escape_line, "trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "string": shown,
    "length": len, "first": lambda x: _get(x, 0), "last": lambda x: _get(x, -1), "default": lambda x, other="": other if x is UNDEFINED else x,
    "join": lambda xs, by="": by.join(map(shown, xs)), "replace": lambda x, old, new: shown(x).replace(old, new),
}


def _range(*args):
    if len(found := range(*args)) > MOST_RANGE:
        raise TemplateError("the range is too long")
    return list(found)


def _raise(message):
    raise TemplateError(shown(message))


FUNCTIONS: dict[str, Callable] = {"range": _range, "namespace": lambda **named: Namespace(named), "raise_exception": _raise}


# -- folding ----------------------------------------------------------------------------------------------------------------


def _quiet(f: Callable, *args):
    """Const of f's value; None if it fails, which it shall then do when it is rendered."""
    try:
        return Const(f(*args))
    except Exception:
        return None


def fold(node):
    """The same tree with constant expressions evaluated, branches that cannot be taken removed, and texts joined."""
    if isinstance(node, tuple):
        return _fold_body(node) if node and isinstance(node[0], (Text, Output, If, For, Set, Generation)) else tuple(map(fold, node))
    if not is_dataclass(node) or isinstance(node, (Const, Name, Text)):
        return node
    node = replace(node, **{f.name: fold(getattr(node, f.name)) for f in fields(node)})
    known = lambda xs: all(isinstance(x, Const) for x in xs)
    if isinstance(node, Op):
        if node.op in ("and", "or") and isinstance(node.args[0], Const):
            return node.args[bool(node.args[0].value) == (node.op == "and")]
        return node.op not in ("and", "or") and known(node.args) and _quiet(OPS[node.op], *(x.value for x in node.args)) or node
    if isinstance(node, Filter):
        return known(node.args) and _quiet(FILTERS[node.name], *(x.value for x in node.args)) or node
    if isinstance(node, Get):
        return known((node.of, node.key)) and _quiet(_get, node.of.value, node.key.value) or node
    if isinstance(node, Items):
        return Const([x.value for x in node.items]) if known(node.items) else node
    if isinstance(node, Choice) and isinstance(node.test, Const):
        return node.yes if node.test.value else node.no
    if isinstance(node, Output) and isinstance(node.value, Const):
        return (text := _quiet(shown, node.value.value)) and Text(text.value) or node
    return node


def _fold_body(body: tuple) -> tuple:
    out: list = []
    for node in map(fold, body):
        if isinstance(node, If) and isinstance(node.test, Const):
            new = node.yes if node.test.value else node.no
        else:
            new = (node,)
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif x != Text(""):
                out.append(x)
    return tuple(out)


# -- closures ---------------------------------------------------------------------------------------------------------------


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name, UNDEFINED)
    if isinstance(node, Get):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _get(of(env), key(env))
    if isinstance(node, Op) and node.op in ("and", "or"):
        a, b = map(_value, node.args)
        return (lambda env: a(env) and b(env)) if node.op == "and" else (lambda env: a(env) or b(env))
    if isinstance(node, (Op, Filter)):
        f, args = OPS[node.op] if isinstance(node, Op) else FILTERS[node.name], [_value(x) for x in node.args]
        if len(args) == 1:
            one = args[0]
            return lambda env: f(one(env))
        return lambda env: f(*[x(env) for x in args])
    if isinstance(node, Choice):
        test, yes, no = _value(node.test), _value(node.yes), _value(node.no)
        return lambda env: yes(env) if test(env) else no(env)
    if isinstance(node, Items):
        items = [_value(x) for x in node.items]
        return lambda env: [x(env) for x in items]
    f, args, named = FUNCTIONS[node.name], [_value(x) for x in node.args], [(k, _value(x)) for k, x in node.named]
    return lambda env: f(*[x(env) for x in args], **{k: x(env) for k, x in named})


def _body(nodes: tuple) -> Callable[[dict], Iterator]:
    parts = [_statement(x) for x in nodes]
    if len(parts) == 1:
        return parts[0]

    def run(env):
        for part in parts:
            yield from part(env)

    return run


def _looped(xs: Iterable) -> Iterator[tuple[Any, dict]]:
    """Each item with what `loop` says of it; holds the items beside it, no others."""
    before, i, nothing = UNDEFINED, 0, object()
    rest = iter(xs)
    now = next(rest, nothing)
    while now is not nothing:
        after = next(rest, nothing)
        last = after is nothing
        yield now, {"index": i + 1, "index0": i, "first": i == 0, "last": last, "previtem": before, "nextitem": UNDEFINED if last else after}
        before, now, i = now, after, i + 1


def _statement(node) -> Callable[[dict], Iterator]:
    if isinstance(node, Text):
        texts = (node.text,)
        return lambda env: iter(texts)
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda env: iter((shown(value(env)),))
    if isinstance(node, If):
        test, yes, no = _value(node.test), _body(node.yes), _body(node.no)
        return lambda env: (yes if test(env) else no)(env)
    if isinstance(node, For):
        name, over, body, none = node.name, _value(node.over), _body(node.body), _body(node.none)

        def each(env):
            found, any_item = over(env), False
            if found is UNDEFINED or isinstance(found, (str, int, float)) or found is None:
                raise TemplateError(f"{name!r} cannot loop over this")
            for item, loop in _looped(found):
                any_item = True
                yield from body({**env, name: item, "loop": loop})
            if not any_item:
                yield from none(env)

        return each
    if isinstance(node, Generation):
        inner = _body(node.body)

        def marked(env):
            yield BEGIN
            yield from inner(env)
            yield END

        return marked
    name, key, value = node.name, node.key, _value(node.value)

    def put(env):
        if key is None:
            env[name] = value(env)
        elif isinstance(env.get(name), Namespace):
            env[name][key] = value(env)
        else:
            raise TemplateError(f"{name!r} is no namespace")
        return iter(())

    return put


def _uses(node, name: str) -> int:
    if isinstance(node, tuple):
        return sum(_uses(x, name) for x in node)
    if isinstance(node, Name):
        return node.name == name
    return sum(_uses(getattr(node, f.name), name) for f in fields(node)) if is_dataclass(node) else 0


class Template:
    """A compiled template. streams: whether it reads `messages` once, by a loop that stands in no other loop."""

    def __init__(self, source: str, trim_blocks: bool = True):
        self.tree = fold(parse(source, trim_blocks))
        self._run = _body(self.tree)
        self.streams = _uses(self.tree, "messages") == self._loops(self.tree) <= 1

    def _loops(self, body: tuple) -> int:
        found = 0
        for x in body:
            if isinstance(x, For):
                found += x.over == Name("messages")
            elif isinstance(x, If):
                found += self._loops(x.yes) + self._loops(x.no)
            elif isinstance(x, Generation):
                found += self._loops(x.body)
        return found

    def render(self, messages: Iterable[dict], **names) -> Iterator:
        """Yields texts, BEGIN and END."""
        return self._run({**names, "messages": messages if self.streams else list(messages)})
