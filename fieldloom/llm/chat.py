"""Conversations rendered by compiled templates.

A small template language is parsed into a syntax tree, constants are folded, and
the tree becomes nested Python closures; nothing is evaluated as Python source.
The language reads data and nothing else: subscripts and attributes are looked up
in mappings and lists only, names that begin with an underscore are refused, and
a rendering may take only so many steps and make texts of only so many characters,
both in proportion to what it is given.

Text, ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in list %} {% endfor %}`` (with ``loop``), ``{% set x = .. %}``,
``{% generation %} {% endgeneration %}`` and ``{# comments #}``; a minus inside a
tag strips the white space on its side. ``generation`` marks what the model is to
write; its character ranges come with the text.
"""

from __future__ import annotations

import json
import operator
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

CHATML = (
    "{% for message in messages %}<|im_start|>{{ message.role }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content }}<|im_end|>{% endgeneration %}"
    "{% else %}{{ message.content }}<|im_end|>{% endif %}\n{% endfor %}"
)


class TemplateError(ValueError):
    """A template that can't be compiled, or a rendering that it refuses."""


class _Missing:
    def __bool__(self) -> bool:
        return False


MISSING = _Missing()
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~<>()\[\].,|:=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(v: Any) -> str:
    if v is None or v is MISSING:
        return ""
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else str(v)


def _number(f):
    def apply(a, b):
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in (a, b)):
            raise TemplateError("arithmetic needs numbers")
        try:
            return f(a, b)
        except ZeroDivisionError:
            raise TemplateError("division by zero") from None

    return apply


def _plus(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
        return a + b
    return _number(operator.add)(a, b)


def _ordered(f):
    def apply(a, b):
        try:
            return f(a, b)
        except TypeError:
            raise TemplateError("values that can't be ordered") from None

    return apply


def _contains(a, b):
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    if isinstance(b, (list, dict)):
        return a in b
    raise TemplateError("'in' needs a text, a list or a mapping")


def _item(v, k):
    if isinstance(v, dict):
        return v.get(k, MISSING) if isinstance(k, (str, int)) else MISSING
    if isinstance(v, (list, str)) and isinstance(k, int) and -len(v) <= k < len(v):
        return v[k]
    return MISSING


_BINARY = {
    "+": _plus, "-": _number(operator.sub), "*": _number(operator.mul), "//": _number(operator.floordiv), "%": _number(operator.mod),
    "~": lambda a, b: _text(a) + _text(b), "==": operator.eq, "!=": operator.ne,
    "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt), ">=": _ordered(operator.ge),
    "in": _contains, "not in": lambda a, b: not _contains(a, b),
}


def _refuse(message="refused"):
    raise TemplateError(_text(message))


_FILTERS = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "string": _text,
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0, "tojson": lambda v: json.dumps(None if v is MISSING else v, ensure_ascii=False, sort_keys=True),
    "default": lambda v, d="": d if v is MISSING else v, "join": lambda v, sep="": _text(sep).join(map(_text, v)) if isinstance(v, list) else _text(v),
    "first": lambda v: _item(v, 0), "last": lambda v: _item(v, -1), "replace": lambda v, a, b: _text(v).replace(_text(a), _text(b)) if a else _text(v),
}
_TESTS = {"defined": lambda v: v is not MISSING, "undefined": lambda v: v is MISSING, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "mapping": lambda v: isinstance(v, dict)}


class _Expression:
    """Recursive descent over one expression; nodes are tuples, constants ``("const", value)``."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            number, text, name, sign = m.groups()
            if number:
                self.tokens.append(("const", float(number) if "." in number else int(number)))
            elif text:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
            elif name in ("true", "True", "false", "False", "none", "None"):
                self.tokens.append(("const", {"t": True, "f": False, "n": None}[name[0].lower()]))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        found = self.tokens[self.at - 1][1]
        if found.startswith("_"):
            raise TemplateError(f"the name {found!r} is refused")
        return found

    def whole(self):
        node = self.ternary()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def ternary(self):
        node = self.either()
        if self.take("if"):
            test = self.either()
            node = ("choose", test, node, self.ternary() if self.take("else") else ("const", ""))
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.sum()
        while True:
            if sign := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                node = ("binary", sign, node, self.sum())
            elif self.take("not"):
                self.need("in")
                node = ("binary", "not in", node, self.sum())
            elif self.take("is"):
                inverse = self.take("not")
                test = self.name() if self.tokens[self.at : self.at + 1] != [("const", None)] else "none"
                if test == "none" and self.tokens[self.at : self.at + 1] == [("const", None)]:
                    self.at += 1
                if test not in _TESTS:
                    raise TemplateError(f"no test {test!r}")
                node = ("test", test, node)
                node = ("not", node) if inverse else node
            else:
                return node

    def sum(self):
        node = self.product()
        while sign := self.take("+", "-", "~"):
            node = ("binary", sign, node, self.product())
        return node

    def product(self):
        node = self.unary()
        while sign := self.take("*", "//", "%"):
            node = ("binary", sign, node, self.unary())
        return node

    def unary(self):
        return ("binary", "-", ("const", 0), self.unary()) if self.take("-") else self.suffixed()

    def arguments(self, end: str):
        out = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.ternary())
        return out

    def suffixed(self):
        node = self.atom()
        while True:
            if self.take("."):
                node = ("item", node, ("const", self.name()))
            elif self.take("["):
                start = None if self.take(":") else self.ternary()
                if start is None or self.take(":"):
                    stop = None if self.take("]") else self.ternary()
                    if stop is not None:
                        self.need("]")
                    node = ("slice", node, start or ("const", None), stop or ("const", None))
                else:
                    self.need("]")
                    node = ("item", node, start)
            elif self.take("|"):
                f = self.name()
                if f not in _FILTERS:
                    raise TemplateError(f"no filter {f!r}")
                node = ("filter", f, node, self.arguments(")") if self.take("(") else [])
            else:
                return node

    def atom(self):
        if self.take("("):
            node = self.ternary()
            self.need(")")
            return node
        if self.take("["):
            return ("list", self.arguments("]"))
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return self.tokens[self.at - 1]
        name = self.name()
        if self.take("("):
            if name != "raise_exception":
                raise TemplateError(f"no function {name!r}")
            return ("raise", self.arguments(")"))
        return ("name", name)


def parse(source: str) -> list:
    """The syntax tree: a list of ``text``, ``print``, ``if``, ``for``, ``set`` and ``generation`` nodes."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        pieces.append(["text", source[at : m.start()]])
        left, right = (m[1] or m[4]), (m[3] or m[6])
        if left:
            pieces[-1][1] = pieces[-1][1].rstrip()
        if m[2] is not None:
            pieces.append(["print", m[2]])
        elif m[5] is not None:
            pieces.append(["tag", m[5].strip()])
        at = m.end()
        if right:
            at += len(source[at:]) - len(source[at:].lstrip())
    pieces.append(["text", source[at:]])
    position = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal position
        body: list = []
        while position < len(pieces):
            kind, value = pieces[position]
            position += 1
            if kind == "text":
                if value:
                    body.append(("text", value))
            elif kind == "print":
                body.append(("print", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return body, value
                if word == "if":
                    arms, head = [], rest
                    while True:
                        inner, end = block("elif", "else", "endif")
                        arms.append((_Expression(head).whole(), inner))
                        if end.startswith("elif"):
                            head = end[4:]
                            continue
                        last, _ = block("endif") if end == "else" else ([], "")
                        body.append(("if", arms, last))
                        break
                elif word == "for":
                    e = _Expression(rest)
                    name = e.name()
                    e.need("in")
                    body.append(("for", name, e.whole(), block("endfor")[0]))
                elif word == "set":
                    e = _Expression(rest)
                    name = e.name()
                    e.need("=")
                    body.append(("set", name, e.whole()))
                elif word == "generation":
                    body.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, ""

    return block()[0]


def fold(node):
    """The expression with every part that depends on no name computed, unless computing it fails."""
    if not isinstance(node, tuple) or node[0] in ("const", "name"):
        return node
    node = tuple([fold(x) for x in part] if isinstance(part, list) else fold(part) for part in node)
    if node[0] == "choose" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    parts = [x for part in node[1:] for x in (part if isinstance(part, list) else [part]) if isinstance(x, tuple)]
    if node[0] not in ("raise", "list") and all(x[0] == "const" for x in parts):
        try:
            return ("const", _expression(node)({}))
        except (TemplateError, TypeError):
            pass
    return node


def fold_block(body: list) -> list:
    """Folded statements: constant prints become text, dead arms go, neighbouring texts are joined."""
    out: list = []

    def add(node) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "print":
            e = fold(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("print", e))
        elif node[0] == "if":
            arms, last = [], fold_block(node[2])
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const":
                    if not test[1]:
                        continue
                    last = fold_block(inner)
                    break
                arms.append((test, fold_block(inner)))
            if arms:
                out.append(("if", arms, last))
            else:
                for inner in last:
                    add(inner)
        elif node[0] == "for":
            out.append(("for", node[1], fold(node[2]), fold_block(node[3])))
        elif node[0] == "set":
            out.append(("set", node[1], fold(node[2])))
        elif node[0] == "generation":
            out.append(("generation", fold_block(node[1])))
        else:
            add(node)
    return out


#: Under this key, which no template can name, variables hold the longest text or list that may be made.
_LIMIT = " limit"


def _bounded(value, c):
    if isinstance(value, (str, list)) and len(value) > c.get(_LIMIT, 1 << 20):
        raise TemplateError("too long a value")
    return value


def _size(v) -> int:
    """Characters and items in a value."""
    if isinstance(v, str):
        return len(v)
    if isinstance(v, dict):
        return sum(1 + _size(x) for x in v.values())
    return sum(1 + _size(x) for x in v) if isinstance(v, list) else 1


def _expression(node):
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda c: value
    if kind == "name":
        name = node[1]
        return lambda c: c.get(name, MISSING)
    if kind == "list":
        parts = [_expression(x) for x in node[1]]
        return lambda c: [p(c) for p in parts]
    if kind == "raise":
        args = [_expression(x) for x in node[1]]
        return lambda c: _refuse(*[a(c) for a in args[:1]])
    if kind == "filter":
        f, inner, args = _FILTERS[node[1]], _expression(node[2]), [_expression(x) for x in node[3]]

        def filtered(c):
            try:
                return _bounded(f(inner(c), *[a(c) for a in args]), c)
            except TypeError:
                raise TemplateError(f"filter {node[1]!r} can't take that") from None

        return filtered
    if kind == "test":
        t, inner = _TESTS[node[1]], _expression(node[2])
        return lambda c: t(inner(c))
    if kind == "binary":
        f, a, b = _BINARY[node[1]], _expression(node[2]), _expression(node[3])
        return lambda c: _bounded(f(a(c), b(c)), c)
    parts = [_expression(x) for x in node[1:]]
    if kind == "not":
        return lambda c: not parts[0](c)
    if kind == "and":
        return lambda c: parts[0](c) and parts[1](c)
    if kind == "or":
        return lambda c: parts[0](c) or parts[1](c)
    if kind == "choose":
        return lambda c: parts[1](c) if parts[0](c) else parts[2](c)
    if kind == "item":
        return lambda c: _item(parts[0](c), parts[1](c))

    def sliced(c):
        v, a, b = (p(c) for p in parts)
        if not isinstance(v, (list, str)) or not all(x is None or isinstance(x, int) for x in (a, b)):
            raise TemplateError("a slice needs a list or a text, and whole numbers")
        return v[a:b]

    return sliced


class _Output:
    def __init__(self, steps: int, chars: int):
        self.parts, self.length, self.spans, self.steps, self.chars = [], 0, [], steps, chars

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)
        if self.length > self.chars:
            raise TemplateError("too long an output")

    def step(self) -> None:
        self.steps -= 1
        if self.steps < 0:
            raise TemplateError("too many steps")


def _block(body: list):
    runs = [_statement(x) for x in body]

    def run(c, out):
        for r in runs:
            r(c, out)

    return run


def _statement(node):
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda c, out: out.write(text)
    if kind == "print":
        e = _expression(node[1])

        def show(c, out):
            out.step()
            out.write(_text(e(c)))

        return show
    if kind == "set":
        name, e = node[1], _expression(node[2])

        def assign(c, out):
            c[name] = e(c)

        return assign
    if kind == "if":
        arms, last = [(_expression(t), _block(b)) for t, b in node[1]], _block(node[2])

        def branch(c, out):
            for test, inner in arms:
                if test(c):
                    return inner(c, out)
            return last(c, out)

        return branch
    if kind == "generation":
        inner = _block(node[1])

        def mark(c, out):
            start = out.length
            inner(c, out)
            out.spans.append((start, out.length))

        return mark
    name, e, inner = node[1], _expression(node[2]), _block(node[3])

    def loop(c, out):
        items = e(c)
        if items is MISSING or items is None:
            return
        if not isinstance(items, list):
            raise TemplateError("only lists are looped over")
        for k, item in enumerate(items):
            out.step()
            inner({**c, name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k + 1 == len(items), "length": len(items)}}, out)

    return loop


def compile_template(source: str, max_steps: int | None = None, max_chars: int | None = None):
    """A function from variables to ``text, spans``; what a loop's body sets ends with the turn of the loop.

    A rendering may take ``max_steps`` prints and turns of loops, and its output,
    or any one value, ``max_chars`` characters. By default both are a million and
    a hundred times the size of the variables, so long inputs aren't refused for
    being long. A template whose tags or brackets nest too deeply is refused.
    """
    try:
        run = _block(fold_block(parse(source)))
    except RecursionError:
        raise TemplateError("nested too deeply") from None

    def render(**variables) -> tuple[str, list[tuple[int, int]]]:
        room = 1_000_000 + 100 * _size(variables)
        chars = room if max_chars is None else max_chars
        out = _Output(room if max_steps is None else max_steps, chars)
        try:
            run({**variables, _LIMIT: chars}, out)
        except RecursionError:
            raise TemplateError("nested too deeply") from None
        return "".join(out.parts), out.spans

    return render


def render_conversations(turns: DataFrame, template: str = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", variables: dict | None = None, max_steps: int | None = None, max_chars: int | None = None) -> DataFrame:
    """One row for each conversation: ``id_col, text, generation, error``.

    The template sees ``messages``, a list of ``role`` and ``content`` in the
    order of turn (null first), then role, then content, besides ``variables``.
    ``generation`` has the start and end character of every generation block.

    Where the template raises or can't do what it says, text and generation are
    null and ``error`` says why; elsewhere error is null. Null roles and contents
    are none to the template and print as nothing; empty contents are empty texts.
    A row with a null id is a conversation alone, as nothing says which it is of.
    Repeated rows are repeated turns. An empty table gives no rows. Other columns
    are ignored. ``max_steps`` and ``max_chars`` are those of ``compile_template``;
    beyond them is an error like others. A conversation is one value of one row.
    """
    compile_template(template)  # a wrong template fails here, not in a task
    given = dict(variables or {})

    def render(turns: pa.Array) -> pa.Array:
        run = compile_template(template, max_steps, max_chars)
        texts, spans, errors = [], [], []
        for messages in turns.to_pylist():
            try:
                text, marks = run(messages=[{"role": m["role"], "content": m["content"]} for m in messages], **given)
                error = None
            except TemplateError as e:
                text, marks, error = None, None, str(e)
            texts.append(text)
            spans.append(None if marks is None else [{"start": a, "end": b} for a, b in marks])
            errors.append(error)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, kind), pa.array(errors, pa.string())], names=["text", "generation", "error"])

    render.__annotations__ = {"turns": pa.Array, "return": pa.Array}
    made = F.arrow_udf(render, "text string, generation array<struct<start: long, end: long>>, error string")
    part = F.struct(col(turns, turn_col).cast("long").alias("turn"), col(turns, role_col).alias("role"), col(turns, text_col).alias("content"))
    alone = F.when(col(turns, id_col).isNull(), F.monotonically_increasing_id())
    grouped = turns.select(col(turns, id_col).alias("id"), alone.alias("alone"), part.alias("part")).groupBy("id", "alone").agg(F.sort_array(F.collect_list("part")).alias("turns"))
    return grouped.select("id", made("turns").alias("r")).select(F.col("id").alias(id_col), "r.*")
