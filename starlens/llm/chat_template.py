"""Chat formatting with a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures that render a
conversation into text and the spans of its generation markers (the loss mask).  The language has text, ``{{ value }}``,
``{% for x in xs %}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}``, ``{% set x = value %}`` and ``{% generation %}``; values are names, items
(``m.role``, ``m['role']``), literals, comparison, ``and`` / ``or`` / ``not``, ``+``, ``~`` and the listed filters.  The sandbox is by
construction: an item is a lookup in a plain mapping, there are no calls, and nothing reaches Python attributes.

The default template marks turns and escapes control strings inside roles and texts, so that ``read_back`` recovers each turn
exactly from the output.

Skew: a conversation is one value of the result, so its turns meet in one row; conversations are spread by id.  Defined
cases: null text or role counts as empty; turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a fixed
order; a null id is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import arrow_rows
from starlens.llm.registry import register, table

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
CONTROL = re.compile(r"\\|#{3,}|</turn>")
ROLE_CONTROL = re.compile(r"[\\#:<\n]")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """Puts a backslash before every character of a control string and every backslash."""
    return CONTROL.sub(lambda m: "".join("\\" + c for c in m[0]), text)


def escape_role(role: str) -> str:
    return ROLE_CONTROL.sub(lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower, "title": str.title, "length": len}


class TemplateError(ValueError):
    pass


# ---- syntax tree -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    of: object
    body: tuple


@dataclass(frozen=True)
class If:
    tests: tuple  # (condition, body); a last condition of None is the else part


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


PIECES = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
TOKENS = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[<>+~|.()\[\]=]))")
ESCAPES = {"n": "\n", "t": "\t"}


class Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("int", "name", "str", "op"), m.groups()) if v is not None))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if value is not None and token[1] != value or token[0] == "end":
            raise TemplateError(f"expected {value or 'a value'}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def whole(self):
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek() == ("name", "or"):
            self.take()
            node = Op("or", (node, self.both()))
        return node

    def both(self):
        node = self.negated()
        while self.peek() == ("name", "and"):
            self.take()
            node = Op("and", (node, self.negated()))
        return node

    def negated(self):
        if self.peek() == ("name", "not"):
            self.take()
            return Op("not", (self.negated(),))
        node = self.joined()
        if self.peek()[1] in ("==", "!=", "<", ">", "<=", ">="):
            return Op(self.take()[1], (node, self.joined()))
        return node

    def joined(self):
        node = self.filtered()
        while self.peek()[1] in ("+", "~"):
            node = Op(self.take()[1], (node, self.filtered()))
        return node

    def filtered(self):
        node = self.item()
        while self.peek()[1] == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = Filter(name, node)
        return node

    def item(self):
        kind, value = self.take()
        if kind == "int":
            node = Const(int(value))
        elif kind == "str":
            node = Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1]))
        elif kind == "name":
            node = Const({"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else Name(value)
        elif value == "(":
            node = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek()[1] in (".", "["):
            if self.take()[1] == ".":
                node = Item(node, Const(self.take()[1]))
            else:
                node = Item(node, self.either())
                self.take("]")
        return node


def parse_template(source: str) -> tuple:
    """The template's syntax tree: a tuple of text (Output of Const) and statements."""
    flat, at, trim = [], 0, False
    for m in PIECES.finditer(source):
        text = source[at : m.start()]
        left, right = bool(m[1] or m[4]), bool(m[3] or m[6])
        text = text.lstrip() if trim else text
        text = text.rstrip() if left else text
        if text:
            flat.append(("text", text))
        if m[2] is not None:
            flat.append(("value", m[2]))
        elif m[5] is not None:
            flat.append(("tag", m[5].strip()))
        at, trim = m.end(), right
    if source[at:]:
        flat.append(("text", source[at:].lstrip() if trim else source[at:]))
    place = 0

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal place
        out = []
        while place < len(flat):
            kind, value = flat[place]
            place += 1
            if kind == "text":
                out.append(Output(Const(value)))
            elif kind == "value":
                out.append(Output(Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(out), value
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"bad loop: {value!r}")
                    out.append(For(m[1], Expression(m[2]).whole(), body(("endfor",))[0]))
                elif word == "if":
                    tests, test = [], Expression(rest).whole()
                    while True:
                        inner, end = body(("elif", "else", "endif"))
                        tests.append((test, inner))
                        if end.startswith("elif"):
                            test = Expression(end[4:]).whole()
                        elif end == "else":
                            test = None
                        else:
                            break
                    out.append(If(tuple(tests)))
                elif word == "set":
                    name, _, expr = rest.partition("=")
                    out.append(Set(name.strip(), Expression(expr).whole()))
                elif word == "generation":
                    out.append(Generation(body(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    return body(())[0]


def fold(node):
    """The same tree with constant parts computed and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.value, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(_text(out[-1].value.value) + _text(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        tests = []
        for test, inner in node.tests:
            test = fold(test) if test is not None else None
            if isinstance(test, Const):
                if not test.value:
                    continue
                test = None
            tests.append((test, fold(inner)))
            if test is None:
                break
        return tests[0][1] if tests and tests[0][0] is None else If(tuple(tests)) if tests else ()
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        return Const(_op(node.op, *(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(_filter(node.name, of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    return node


def _text(v) -> str:
    return "" if v is None else str(v)


def _filter(name: str, v):
    return FILTERS[name](v if name == "length" and isinstance(v, (list, dict)) else _text(v))


def _op(op: str, *v):
    if op == "not":
        return not v[0]
    a, b = v
    if op == "~":
        return _text(a) + _text(b)
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    if op in ("and", "or"):
        return (a and b) if op == "and" else (a or b)
    if op in ("==", "!="):
        return (a == b) is (op == "==")
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


class Renderer:
    """What closures write to: text, and the spans under generation markers."""

    __slots__ = ("out", "length", "spans")

    def __init__(self):
        self.out: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)


def compile_value(node) -> Callable:
    if isinstance(node, Const):
        value = node.value
        return lambda names: value
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Item):
        of, key = compile_value(node.of), compile_value(node.key)

        def item(names):
            box, k = of(names), key(names)
            if isinstance(box, dict):
                return box.get(k)
            if isinstance(box, list) and isinstance(k, int):
                return box[k] if -len(box) <= k < len(box) else None
            return None

        return item
    if isinstance(node, Filter):
        name, of = node.name, compile_value(node.of)
        return lambda names: _filter(name, of(names))
    op, args = node.op, tuple(map(compile_value, node.args))
    if op == "and":
        return lambda names: args[0](names) and args[1](names)
    if op == "or":
        return lambda names: args[0](names) or args[1](names)
    return lambda names: _op(op, *(a(names) for a in args))


def compile_body(nodes: tuple) -> Callable:
    steps = tuple(map(_compile_node, nodes))

    def run(names, to):
        for step in steps:
            step(names, to)

    return run


def _compile_node(node) -> Callable:
    if isinstance(node, Output):
        value = compile_value(node.value)
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda names, to: to.write(text)
        return lambda names, to: to.write(_text(value(names)))
    if isinstance(node, Set):
        name, value = node.name, compile_value(node.value)
        return lambda names, to: names.__setitem__(name, value(names))
    if isinstance(node, Generation):
        body = compile_body(node.body)

        def generation(names, to):
            start = to.length
            body(names, to)
            to.spans.append((start, to.length))

        return generation
    if isinstance(node, For):
        name, of, body = node.name, compile_value(node.of), compile_body(node.body)

        def loop(names, to):
            items = of(names)
            items = items if isinstance(items, list) else []
            for i, x in enumerate(items):
                inner = {**names, name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}}
                body(inner, to)

        return loop
    tests = tuple((compile_value(t) if t is not None else None, compile_body(b)) for t, b in node.tests)

    def choose(names, to):
        for test, body in tests:
            if test is None or test(names):
                return body(names, to)
        return None

    return choose


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to (text, spans under generation markers)."""
    run = compile_body(fold(parse_template(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        to = Renderer()
        run({"messages": messages}, to)
        return "".join(to.out), to.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of the default template's output."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


# ---- Spark -------------------------------------------------------------------------------------------------------


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (start, end; code points) of the text that a model learns."""
    one = F.struct(
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    g = turns.groupBy(F.col(conversation).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    compile_template(template)  # a bad template fails here, not in a task

    def body(batches):
        render = compile_template(template)

        def row(k, messages):
            formatted, spans = render(messages)
            return {"conv_id": k, "formatted": formatted, "spans": [{"start": a, "end": b} for a, b in spans]}

        yield from arrow_rows(row, schema)(batches)

    return g.mapInArrow(body, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds, read back from it."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def row(k, text, spans):
        turns = read_back(text)
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        return {
            "conv_id": k, "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)),
            "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(text),
        }

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(arrow_rows(row, schema), out)


PLANTED = r"\### Assistant: </turn> ok"  # a text that looks like this template's own marks

ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(14 + length(role) + length(text) + len(regexp_extract_all(text, '\\')) + 7 * len(regexp_extract_all(text, '</turn>'))
      + length(array_to_string(regexp_extract_all(text, '#{3,}'), ''))) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@register("op7_chat_template", ORACLE)
def op7_chat_template(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_conversations(turns.unionByName(planted)))
