"""Chat formatting with a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python
closures. The language: ``{{ expression }}``, ``{% for x in y %}``, ``{% if %} {% elif %}
{% else %}``, ``{% set name = expression %}``, ``{% generation %}``, which marks its output as
generated by the model, and comments ``{# #}``. Expressions have literals, names, ``a.b`` and
``a['b']`` on plain mappings, ``== != < <= > >= in``, ``and or not``, ``+ - * %``, ``~`` (joins
text), ``x if c else y`` and the filters below. There is no attribute access to Python objects and
no call, so a template reaches nothing but the values it is given.

Messages are rendered as they come: the loop looks one message ahead, and each turn's output leaves
as a piece of its own, so a conversation is never held whole. Conversations are sorted by Spark
into partitions by id.

``escape`` makes any text safe inside a turn: a backslash is doubled and ``<|`` gets a backslash
between, so no text can hold a control string; ``unescape`` is its inverse. Roles also escape line
breaks.

Null texts and roles are empty. Rows with a null ``conv_id`` are one conversation; turns are ordered
by turn (nulls first), role and text; repeated rows are repeated turns. Further columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_start|>' ~ message.role | escape_role ~ '\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\n' }}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)), "escape_role": lambda x: escape_role(_text(x)), "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "string": lambda x: _text(x),
}


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


@dataclass(frozen=True)
class Node:
    """``kind`` with its operands: nodes, values or tuples of nodes."""

    kind: str
    parts: tuple = ()


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>()\[\].|]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_BINARY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
            number, string, name, sign = m.groups()
            if number:
                self.tokens.append(("value", int(number)))
            elif string:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind != "value" and value in wanted:
                return value
        return None

    def take(self, *wanted: str) -> str | None:
        found = self.peek(*wanted)
        self.at += found is not None
        return found

    def need(self, kind: str, value: str | None = None):
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind and value in (None, self.tokens[self.at][1]):
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"expected {value or kind}")

    def whole(self) -> Node:
        out = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> Node:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("name", "else")
            return Node("choice", (test, value, self.choice()))
        return value

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.joined()
        while sign := self.take(*_COMPARE, "in"):
            left = Node("compare", (sign, left, self.joined()))
        return left

    def joined(self) -> Node:
        left = self.summed()
        while self.take("~"):
            left = Node("join", (left, self.summed()))
        return left

    def summed(self) -> Node:
        left = self.product()
        while sign := self.take("+", "-"):
            left = Node("binary", (sign, left, self.product()))
        return left

    def product(self) -> Node:
        left = self.filtered()
        while sign := self.take("*", "%"):
            left = Node("binary", (sign, left, self.filtered()))
        return left

    def filtered(self) -> Node:
        out = self.atom()
        while True:
            if self.take("."):
                out = Node("item", (out, Node("value", (self.need("name"),))))
            elif self.take("["):
                out = Node("item", (out, self.choice()))
                self.need("sign", "]")
            elif self.take("|"):
                name = self.need("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                out = Node("filter", (name, out))
            else:
                return out

    def atom(self) -> Node:
        if self.take("("):
            out = self.choice()
            self.need("sign", ")")
            return out
        if self.take("-"):
            return Node("binary", ("-", Node("value", (0,)), self.atom()))
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "value":
            return Node("value", (value,))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Node("value", (fixed[value.lower()],)) if value.lower() in fixed else Node("name", (value,))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """Syntax tree of a template: a ``block`` of statements."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("print", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2]))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def block(*ends: str) -> tuple[Node, str]:
        out = []
        while parts:
            kind, value = parts.pop()
            if kind == "text":
                out.append(Node("print", (Node("value", (value,)),)))
                continue
            if kind == "print":
                out.append(Node("print", (_Expression(value).whole(),)))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return Node("block", tuple(out)), value
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad loop: {value!r}")
                body, _ = block("endfor")
                out.append(Node("for", (m[1], _Expression(m[2]).whole(), body)))
            elif word == "if":
                out.append(branch(rest))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.*)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad assignment: {value!r}")
                out.append(Node("set", (m[1], _Expression(m[2]).whole())))
            elif word == "generation":
                body, _ = block("endgeneration")
                out.append(Node("generation", (body,)))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return Node("block", tuple(out)), ""

    def branch(test: str) -> Node:
        then, end = block("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        other = branch(rest) if word == "elif" else block("endif")[0] if word == "else" else Node("block")
        return Node("if", (_Expression(test).whole(), then, other))

    return block()[0]


def fold(node: Node) -> Node:
    """The tree with constant parts computed, fixed branches taken and neighbouring texts joined."""
    parts = tuple(fold(p) if isinstance(p, Node) else p for p in node.parts)
    node = Node(node.kind, parts)
    if node.kind == "if" and parts[0].kind == "value":
        return parts[1] if parts[0].parts[0] else parts[2]
    if node.kind == "block":
        out: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "print" and q.parts[0].kind == "value":
                    text = _text(q.parts[0].parts[0])
                    if out and out[-1].kind == "print" and out[-1].parts[0].kind == "value":
                        text = out.pop().parts[0].parts[0] + text
                    q = Node("print", (Node("value", (text,)),))
                out.append(q)
        return Node("block", tuple(out))
    if node.kind in ("binary", "compare", "join", "not", "and", "or", "choice", "filter", "item") and all(
        p.kind == "value" for p in parts if isinstance(p, Node)
    ):
        return Node("value", (_evaluator(node)({}),))
    return node


def _evaluator(node: Node) -> Callable[[dict], object]:
    kind, parts = node.kind, node.parts
    if kind == "value":
        value = parts[0]
        return lambda env: value
    if kind == "name":
        name = parts[0]
        return lambda env: env.get(name)
    f = [_evaluator(p) for p in parts if isinstance(p, Node)]
    if kind == "item":
        return lambda env: _item(f[0](env), f[1](env))
    if kind == "filter":
        apply = FILTERS[parts[0]]
        return lambda env: apply(f[0](env))
    if kind == "join":
        return lambda env: _text(f[0](env)) + _text(f[1](env))
    if kind == "binary":
        combine = _BINARY[parts[0]]
        return lambda env: combine(f[0](env), f[1](env))
    if kind == "compare":
        test = _COMPARE.get(parts[0]) or (lambda a, b: a in b)
        return lambda env: test(f[0](env), f[1](env))
    if kind == "not":
        return lambda env: not f[0](env)
    if kind == "and":
        return lambda env: f[0](env) and f[1](env)
    if kind == "or":
        return lambda env: f[0](env) or f[1](env)
    if kind == "choice":
        return lambda env: f[1](env) if f[0](env) else f[2](env)
    raise TemplateError(f"not an expression: {kind}")


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


@dataclass
class Output:
    """Text written so far in the piece, and the spans of it that are generated."""

    texts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    generating: int = 0

    def write(self, text: str) -> None:
        if text:
            if self.generating:
                self.spans.append((self.length, self.length + len(text)))
            self.texts.append(text)
            self.length += len(text)


def _statement(node: Node) -> Callable[[dict, Output], Iterator[None]]:
    """A closure that writes and yields after each turn of a loop."""
    kind, parts = node.kind, node.parts
    if kind == "block":
        steps = [_statement(p) for p in parts]

        def run_block(env, out):
            for step in steps:
                yield from step(env, out)

        return run_block
    if kind == "print":
        if parts[0].kind == "value":
            fixed = _text(parts[0].parts[0])
            write = lambda env, out: out.write(fixed)
        else:
            value = _evaluator(parts[0])
            write = lambda env, out: out.write(_text(value(env)))
        return _silent(write)
    if kind == "set":
        name, value = parts[0], _evaluator(parts[1])
        return _silent(lambda env, out: env.__setitem__(name, value(env)))
    if kind == "if":
        test, then, other = _evaluator(parts[0]), _statement(parts[1]), _statement(parts[2])
        return lambda env, out: (then if test(env) else other)(env, out)
    if kind == "generation":
        body = _statement(parts[0])

        def run_generation(env, out):
            out.generating += 1
            yield from body(env, out)
            out.generating -= 1

        return run_generation
    name, value, body = parts[0], _evaluator(parts[1]), _statement(parts[2])

    def run_loop(env, out):
        items = iter(value(env) or ())
        saved = env.get(name), env.get("loop")
        item, index = next(items, items), 0
        while item is not items:
            following = next(items, items)
            env[name], env["loop"] = item, {"index": index + 1, "index0": index, "first": index == 0, "last": following is items}
            yield from body(env, out)
            yield
            item, index = following, index + 1
        env[name], env["loop"] = saved

    return run_loop


def _silent(act: Callable[[dict, Output], object]):
    def run(env, out):
        act(env, out)
        return
        yield

    return run


@dataclass(frozen=True)
class Template:
    """A compiled template."""

    source: str

    @cached_property
    def program(self) -> Callable[[dict, Output], Iterator]:
        """The closure of the whole template, made once."""
        return _statement(fold(parse(self.source)))

    def pieces(self, messages: Iterable[dict], **values) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Formatted pieces in order, each with its generated spans (code points in the piece)."""
        out = Output()
        for _ in self.program({"messages": messages, **values}, out):
            if out.length:
                yield "".join(out.texts), out.spans
                out.texts, out.length, out.spans = [], 0, []
        if out.length:
            yield "".join(out.texts), out.spans

    def render(self, messages: Iterable[dict], **values) -> str:
        return "".join(text for text, _ in self.pieces(messages, **values))


def _conversations(batches, columns: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows of one id, as they stream by."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True)

    stream = rows()
    state = {"next": next(stream, None)}

    def of(conv_id):
        while state["next"] is not None and state["next"][0] == conv_id:
            row, state["next"] = state["next"], next(stream, None)
            yield row

    while state["next"] is not None:
        conv_id = state["next"][0]
        yield conv_id, (own := of(conv_id))
        for _ in own:
            pass


def _in_batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


PIECES = "conv_id bigint, piece bigint, text string, generated array<struct<start bigint, end bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(turns: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``conv_id, piece, text, generated``: the formatted conversations of ``turns`` (``conv_id,
    turn, role, text``), a piece per turn. The texts of a conversation's pieces in order are its
    format; ``generated`` holds the spans of the piece that the model is trained to write.

    Pieces of a conversation follow each other in one partition.
    """
    parse(template)  # a bad template fails here
    rows = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    )

    def run(batches):
        compiled = Template(template)

        def pieces():
            for conv_id, own in _conversations(batches, 3):
                for k, (text, spans) in enumerate(compiled.pieces({"role": r, "content": t} for _, r, t in own)):
                    yield conv_id, k, text, [{"start": a, "end": b} for a, b in spans]

        yield from _in_batches(pieces(), [pa.int64(), pa.int64(), pa.string(), _SPANS], ["conv_id", "piece", "text", "generated"])

    return rows.mapInArrow(run, PIECES)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts of a conversation in the default format, from its pieces."""
    rest = ""
    for piece in pieces:
        rest += piece
        at = 0
        while m := _TURN.match(rest, at):
            yield unescape(m[1]), unescape(m[2])
            at = m.end()
        rest = rest[at:]
    if rest:
        raise ValueError(f"not a turn: {rest[:40]!r}")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_conversations`` in the default format: ``conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""

    def run(batches):
        def rows():
            for conv_id, own in _conversations(batches, 3):
                turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

                def texts(own=own, loss=loss):
                    nonlocal loss_chars, chars
                    for _, text, spans in own:
                        chars += len(text)
                        for s in spans:
                            masked = unescape(text[s["start"] : s["end"]])
                            loss_chars += len(masked)
                            loss.update(masked.encode())
                        yield text

                for role, text in read_back(texts()):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                yield conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield from _in_batches(rows(), kinds, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "text", "generated").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
