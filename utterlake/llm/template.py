"""A small sandboxed template language for conversations, compiled to closures.

::

    {{ expression }}  {% if e %} {% elif e %} {% else %} {% endif %}  {% set x = e %}  {# comment #}
    {% for m in messages %} ... {% endfor %}          once, at the outermost level
    {% generation %} ... {% endgeneration %}          marks what the model is to learn

Expressions are strings, integers, true, false, none, names, ``a.b``, ``a['b']``, ``+``, ``==``, ``!=``, ``<``, ``<=``,
``>``, ``>=``, ``in``, ``not``, ``and``, ``or``, parentheses and filters (``x | escape(':')``). A ``-`` inside a tag strips the
white space beside it. There are no calls, and a lookup reads the fields of a message or of ``loop`` and nothing else, so a
template can neither reach Python objects nor run for longer than its own length and its messages' allow.

A template is parsed into a syntax tree; what has no variables is computed then, branches that cannot be taken go, and
neighbouring texts become one. As nothing that is set inside the loop outlives a turn, a template falls into what comes
before the turns, a turn, and what comes after: three closures that can run on different machines.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter by its name."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """``and``, ``or``: the right side only counts if the left one does not decide."""

    name: str
    left: object
    right: object


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Let:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class Turns:
    name: str
    body: tuple


def escape(value: str, controls: tuple[str, ...]) -> str:
    """A backslash before each backslash and before each place where a control string begins."""
    if "\\" not in value and not any(c in value for c in controls):
        return value
    return re.sub("(?=" + "|".join(map(re.escape, ("\\", *controls))) + ")", r"\\", value)


def unescape(value: str) -> str:
    return re.sub(r"\\(.)", r"\1", value, flags=re.S) if "\\" in value else value


def _text(value: object) -> str:
    return "" if value is None else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def _add(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


_APPLY: dict[str, Callable] = {
    "+": _add, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: _text(a) in _text(b), "not": operator.not_,
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
    "capitalize": lambda x: _text(x).capitalize(), "length": lambda x: len(_text(x)), "default": lambda x, y: y if x is None else x,
    "replace": lambda x, old, new: _text(x).replace(_text(old), _text(new)),
}
#: Filters and their numbers of arguments, from and to.
_FILTERS = {"trim": (0, 0), "upper": (0, 0), "lower": (0, 0), "capitalize": (0, 0), "length": (0, 0), "default": (1, 1), "replace": (2, 2), "escape": (0, 9)}
_LOOP = ("index", "index0", "first", "last", "length")
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<sign>==|!=|<=|>=|[<>+|().,\[\]=])|(?P<end>-?[%}]\}))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class _Parser:
    def __init__(self, source: str, constants: dict[str, object], controls: tuple[str, ...]):
        self.source, self.constants, self.controls = source, constants, controls
        self.at, self.token, self.scope, self.loop = 0, ("", ""), set(), ""
        self.used: set[str] = set()  # fields of loop

    # --- tokens of a tag

    def step(self) -> None:
        found = _TOKEN.match(self.source, self.at)
        if not found:
            raise TemplateError(f"at {self.at}: {self.source[self.at : self.at + 20]!r}")
        self.at, self.token = found.end(), (found.lastgroup, found[found.lastgroup])

    def take(self, value: str) -> bool:
        if self.token[0] != "string" and self.token[1] == value:
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, not {self.token[1]!r}")

    def name(self) -> str:
        kind, value = self.token
        if kind != "name":
            raise TemplateError(f"a name expected, not {value!r}")
        self.step()
        return value

    def close(self, sign: str) -> None:
        """The end of a tag; the token after it is not read yet."""
        kind, value = self.token
        if kind != "end" or value[-2:] != sign:
            raise TemplateError(f"{sign!r} expected, not {value!r}")
        if value[0] == "-":
            self.at = re.compile(r"\s*").match(self.source, self.at).end()

    # --- expressions, folded as they are read

    def expression(self):
        left = self.both()
        while self.take("or"):
            left = self.choice("or", left, self.both())
        return left

    def both(self):
        left = self.inverse()
        while self.take("and"):
            left = self.choice("and", left, self.inverse())
        return left

    @staticmethod
    def choice(name: str, left, right):
        if isinstance(left, Const):
            return right if bool(left.value) == (name == "and") else left
        return Choice(name, left, right)

    def inverse(self):
        return self.apply("not", self.inverse()) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        for sign in ("==", "!=", "<=", ">=", "<", ">", "in"):
            if self.take(sign):
                return self.apply(sign, left, self.sum())
        return left

    def sum(self):
        left = self.filtered()
        while self.take("+"):
            left = self.apply("+", left, self.filtered())
        return left

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            name, args = self.name(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.expression())
                    if not self.take(","):
                        self.need(")")
                        break
            if name not in _FILTERS or not _FILTERS[name][0] <= len(args) <= _FILTERS[name][1]:
                raise TemplateError(f"no filter {name!r} of {len(args)} arguments")
            value = self.apply(name, value, *args)
        return value

    def apply(self, name: str, *args):
        if name == "escape":
            if not all(isinstance(x, Const) and isinstance(x.value, str) and x.value for x in args[1:]):
                raise TemplateError("escape takes constant strings")
            args = (args[0], Const((*self.controls, *(x.value for x in args[1:]))))
        if all(isinstance(x, Const) for x in args):
            return Const(_call(name)(*(x.value for x in args)))
        return Apply(name, args)

    def atom(self):
        kind, value = self.token
        if kind == "string":
            self.step()
            node = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "number":
            self.step()
            node = Const(int(value))
        elif self.take("("):
            node = self.expression()
            self.need(")")
        else:
            node = self.variable(self.name())
        while True:
            if self.take("."):
                key = self.name()
            elif self.take("["):
                kind, key = self.token
                if kind != "string":
                    raise TemplateError("a lookup takes a constant string")
                key = key[1:-1]
                self.step()
                self.need("]")
            else:
                return node
            node = self.lookup(node, key)

    def variable(self, name: str):
        if name in _WORDS:
            return Const(_WORDS[name])
        if name in self.constants:
            return Const(self.constants[name])
        if name not in self.scope:
            raise TemplateError(f"no variable {name!r}")
        return Name(name)

    def lookup(self, node, key: str):
        if node == Name("loop") and self.loop:
            if key not in _LOOP:
                raise TemplateError(f"loop has no {key!r}")
            self.used.add(key)
        elif not isinstance(node, Name) or node.name != self.loop or key not in ("role", "text", "turn"):
            raise TemplateError(f"no field {key!r} to look up")
        return Get(node, key)

    # --- texts and tags

    def until(self, *words: str) -> tuple[tuple, str]:
        """Nodes up to a tag that begins with one of ``words`` (or the end, for none), and that word."""
        nodes: list = []

        def add(node) -> None:
            if isinstance(node, Output) and isinstance(node.value, Const):
                node = Text(_text(node.value.value))
            if isinstance(node, Text) and nodes and isinstance(nodes[-1], Text):
                nodes[-1] = Text(nodes[-1].value + node.value)
            elif node != Text(""):
                nodes.append(node)

        while True:
            found = re.compile(r"\{[{%#]").search(self.source, self.at)
            text = self.source[self.at : found.start() if found else len(self.source)]
            if found and self.source[found.end() : found.end() + 1] == "-":
                text, self.at = text.rstrip(), found.end() + 1
            else:
                self.at = found.end() if found else len(self.source)
            add(Text(text))
            if not found:
                if words:
                    raise TemplateError(f"{' or '.join(words)} is missing")
                return tuple(nodes), ""
            if found[0] == "{#":
                end = self.source.find("#}", self.at)
                if end < 0:
                    raise TemplateError("a comment has no end")
                self.at = end + 2
                continue
            self.step()
            if found[0] == "{{":
                add(Output(self.expression()))
                self.close("}}")
                continue
            word = self.name()
            if word in words:
                return tuple(nodes), word
            for node in self.tag(word):
                add(node)

    def tag(self, word: str) -> tuple:
        if word == "if":
            return self.branch()
        if word == "set":
            name = self.name()
            self.need("=")
            value = self.expression()
            self.close("%}")
            if name in self.constants or name in ("loop", "messages", *_WORDS) or name == self.loop:
                raise TemplateError(f"{name!r} cannot be set")
            self.scope.add(name)
            return (Let(name, value),)
        if word == "generation":
            self.close("%}")
            body, _ = self.until("endgeneration")
            self.close("%}")
            return (Generation(body),)
        if word == "for":
            name = self.name()
            self.need("in")
            if self.name() != "messages" or self.loop:
                raise TemplateError("the loop is over messages, and there is one")
            self.close("%}")
            self.loop, outer = name, set(self.scope)
            self.scope |= {name, "loop"}
            body, _ = self.until("endfor")
            self.close("%}")
            self.scope, self.loop = outer, " done"
            return (Turns(name, body),)
        raise TemplateError(f"no tag {word!r}")

    def branch(self) -> tuple:
        test = self.expression()
        self.close("%}")
        body, word = self.until("elif", "else", "endif")
        if word == "elif":
            other = self.branch()
        else:
            other = ()
            self.close("%}")
            if word == "else":
                other, _ = self.until("endif")
                self.close("%}")
        return (body if test.value else other) if isinstance(test, Const) else (If(test, body, other),)


def _call(name: str) -> Callable:
    return (lambda x, controls: escape(_text(x), controls)) if name == "escape" else _APPLY[name]


@dataclass
class Writer:
    """What a closure has written, and the spans (in code points) under generation marks."""

    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, x=node.value: x
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Get):
        return lambda scope, of=node.of.name, key=node.key: scope[of].get(key)
    if isinstance(node, Choice):
        left, right, keep = _value(node.left), _value(node.right), node.name == "or"
        return lambda scope: x if bool(x := left(scope)) == keep else right(scope)
    call, args = _call(node.name), [_value(x) for x in node.args]
    if len(args) == 1:
        return lambda scope, a=args[0]: call(a(scope))
    if len(args) == 2:
        return lambda scope, a=args[0], b=args[1]: call(a(scope), b(scope))
    return lambda scope: call(*(x(scope) for x in args))


def _block(nodes: tuple) -> Callable[[dict, Writer], None]:
    made = [_node(x) for x in nodes]

    def run(scope: dict, out: Writer) -> None:
        for each in made:
            each(scope, out)

    return made[0] if len(made) == 1 else run


def _node(node) -> Callable[[dict, Writer], None]:
    if isinstance(node, Text):
        return lambda scope, out, text=node.value: out.add(text)
    if isinstance(node, Generation):
        body = _block(node.body)

        def marked(scope: dict, out: Writer) -> None:
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))

        return marked
    if isinstance(node, If):
        test, body, other = _value(node.test), _block(node.body), _block(node.other)
        return lambda scope, out: (body if test(scope) else other)(scope, out)
    value = _value(node.value)
    if isinstance(node, Let):
        return lambda scope, out, name=node.name: scope.__setitem__(name, value(scope))
    return lambda scope, out: out.add(_text(value(scope)))


class Template:
    """A compiled template: ``before``, ``turn`` and ``after`` each give a text and its spans."""

    def __init__(self, source: str, constants: dict[str, object] | None = None, controls: tuple[str, ...] = ()):
        if not all(controls):
            raise TemplateError("a control string is empty")
        parser = _Parser(source, constants or {}, controls)
        self.tree, _ = parser.until()
        at = [i for i, node in enumerate(self.tree) if isinstance(node, Turns)]
        if len(at) != 1:
            raise TemplateError("the template has no outermost loop over messages")
        self.loop_fields = parser.used
        loop, before = self.tree[at[0]], self.tree[: at[0]]
        self._name = loop.name
        #: What is set before the loop is computed again for each turn: it depends on constants alone.
        self._set = _block(tuple(x for x in before if not isinstance(x, (Text, Output, Generation))))
        self._before, self._turn, self._after = _block(before), _block(loop.body), _block(self.tree[at[0] + 1 :])

    def _run(self, block: Callable, scope: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Writer()
        block(scope, out)
        return out.text(), out.spans

    def _outer(self) -> dict:
        scope: dict = {}
        self._set(scope, Writer())
        return scope

    def before(self) -> tuple[str, list[tuple[int, int]]]:
        return self._run(self._before, {})

    def after(self) -> tuple[str, list[tuple[int, int]]]:
        return self._run(self._after, self._outer())

    def turn(self, message: dict, loop: dict | None = None) -> tuple[str, list[tuple[int, int]]]:
        return self._run(self._turn, {**self._outer(), self._name: message, "loop": loop or {}})
