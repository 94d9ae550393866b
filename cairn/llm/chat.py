"""Chat formatting by a template compiler: syntax tree, constant folding, closures.

The template language is a sandbox: text, ``{{ expression }}``, ``{% for x in xs %}``,
``{% if %} {% elif %} {% else %}``, and ``{% generation %}``, whose output is marked as
what a model is trained on.  Expressions are literals, names, fields of records, ``==``,
``!=``, ``not``, ``and``, ``or``, ``~`` (joins texts) and the filters of FILTERS; there
are no calls and no access to Python objects.  A template is parsed once, constants are
folded, and each node becomes a Python closure.  Loops pull their records one at a time,
so a conversation of any length renders in bounded memory.

Control strings inside texts are escaped: wherever one begins, also within another, its
first character is written as a code (CODES), and each backslash twice.  So are a first
``>`` and a last ``<``, which could become part of one beside the template's own text.  No
control string is left then but the template's, and ``unescape`` restores every text.

Defined results: null roles and texts are empty; rows with equal turns go by role and
text; a null conv_id is a conversation of its own; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.store import columns, session

CONTROLS = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"]
TEMPLATE = (
    "{% for m in messages %}<|{{ m.role | escape }}|>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)
#: Characters after which a conversation's output goes on in another row.
PART = 1 << 16
#: What stands for the first character of a control string, and for a backslash.
CODES = {"<": "\\l", ">": "\\g", "|": "\\p", "[": "\\b", "\\": "\\\\"}
_escapes = re.compile(r"\\|\A>|<\Z|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_plain = {code[1]: c for c, code in CODES.items()}


def escape(text: str) -> str:
    return _escapes.sub(lambda m: CODES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _plain[m[1]], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not in the language."""


# -- syntax tree: ("text", s) ("out", e) ("for", name, e, body) ("if", [(e, body)], other) ("gen", body)
#    expressions: ("const", v) ("name", n) ("field", e, n) ("not", e) ("op", o, a, b) ("filter", e, n)

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'[^'\\]*(?:\\.[^'\\]*)*')|(?P<int>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|[().|~]))")
_WORDS = {"and", "or", "not", "true", "false", "for", "in", "if"}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError("the expression ends early or has the wrong part")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> tuple:
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _chain(self, ops: tuple[str, ...], below: Callable[[], tuple]) -> tuple:
        out = below()
        while self.peek(*ops):
            out = ("op", self.take(), out, below())
        return out

    def either(self) -> tuple:
        return self._chain(("or",), self.both)

    def both(self) -> tuple:
        return self._chain(("and",), self.negated)

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self._chain(("==", "!="), lambda: self._chain(("~",), self.filtered))

    def filtered(self) -> tuple:
        out = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = ("filter", out, name)
        return out

    def atom(self) -> tuple:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if value == "(":
            out = self.either()
            if self.take() != ")":
                raise TemplateError("a bracket stays open")
            return out
        if value in ("true", "false"):
            return ("const", value == "true")
        if kind != "name" or value in _WORDS:
            raise TemplateError(f"unexpected {value!r}")
        out = ("name", value)
        while self.peek("."):
            self.take()
            out = ("field", out, self.take("name"))
        return out


def parse(source: str) -> list[tuple]:
    """The template's syntax tree."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        pieces += [("text", source[at : m.start()]), ("expr", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    pieces.append(("text", source[at:]))
    out, place = _body(pieces, 0, ())
    if place != len(pieces):
        raise TemplateError(f"unexpected {pieces[place][1]!r}")
    return out


def _body(pieces: list, at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    out: list[tuple] = []
    while at < len(pieces):
        kind, value = pieces[at]
        at += 1
        if kind == "text":
            out += [("text", value)] if value else []
        elif kind == "expr":
            out.append(("out", _Expression(value).parse()))
        else:
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, at - 1
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read {value!r}")
                body, at = _body(pieces, at, ("endfor",))
                out.append(("for", m[1], _Expression(m[2]).parse(), body))
            elif word == "if":
                cases, other = [], []
                while word in ("if", "elif"):
                    body, at = _body(pieces, at, ("elif", "else", "endif"))
                    cases.append((_Expression(rest).parse(), body))
                    word, _, rest = pieces[at][1].partition(" ") if at < len(pieces) else ("", "", "")
                    at += 1
                if word == "else":
                    other, at = _body(pieces, at, ("endif",))
                    at += 1
                out.append(("if", cases, other))
                continue
            elif word == "generation":
                body, at = _body(pieces, at, ("endgeneration",))
                out.append(("gen", body))
            else:
                raise TemplateError(f"unknown tag {value!r}")
            at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return out, at


def fold(node: tuple) -> tuple:
    """An expression with its constant parts computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(node[1])
        return ("const", FILTERS[node[2]](_text(a[1]))) if a[0] == "const" else ("filter", a, node[2])
    _, op, a, b = node
    a, b = fold(a), fold(b)
    if a[0] == "const" and op in ("and", "or"):
        return b if bool(a[1]) == (op == "and") else a
    if a[0] == b[0] == "const":
        return ("const", _apply(op, a[1], b[1]))
    return ("op", op, a, b)


def fold_body(body: list[tuple]) -> list[tuple]:
    """Statements with constants folded, decided branches taken and texts joined."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "out":
            e = fold(node[1])
            node = ("text", _text(e[1])) if e[0] == "const" else ("out", e)
        elif node[0] == "for":
            node = ("for", node[1], fold(node[2]), fold_body(node[3]))
        elif node[0] == "gen":
            node = ("gen", fold_body(node[1]))
        elif node[0] == "if":
            cases, other = [], fold_body(node[2])
            for test, inner in node[1]:
                test = fold(test)
                if test[0] != "const":
                    cases.append((test, fold_body(inner)))
                elif test[1]:
                    other = fold_body(inner)
                    break
            if not cases:
                for x in other:
                    _join(out, x)
                continue
            node = ("if", cases, other)
        _join(out, node)
    return out


def _join(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _text(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def _apply(op: str, a: object, b: object) -> object:
    return {"==": lambda: a == b, "!=": lambda: a != b, "~": lambda: _text(a) + _text(b), "and": lambda: a and b, "or": lambda: a or b}[op]()


Scope = dict[str, object]
Emit = Callable[[Scope, bool], Iterator[tuple[str, bool]]]


def _value(node: tuple) -> Callable[[Scope], object]:
    kind = node[0]
    if kind == "const":
        return lambda s, v=node[1]: v
    if kind == "name":
        return lambda s, n=node[1]: s.get(n)
    if kind == "field":
        return lambda s, f=_value(node[1]), n=node[2]: x.get(n) if isinstance(x := f(s), dict) else None
    if kind == "not":
        return lambda s, f=_value(node[1]): not f(s)
    if kind == "filter":
        return lambda s, f=_value(node[1]), g=FILTERS[node[2]]: g(_text(f(s)))
    _, op, a, b = node
    f, g = _value(a), _value(b)
    if op == "and":
        return lambda s: f(s) and g(s)
    if op == "or":
        return lambda s: f(s) or g(s)
    return lambda s: _apply(op, f(s), g(s))


def _emit(body: list[tuple]) -> Emit:
    parts: list[Emit] = []
    for node in body:
        if node[0] == "text":
            parts.append(lambda s, g, t=node[1]: iter([(t, g)]))
        elif node[0] == "out":
            parts.append(lambda s, g, f=_value(node[1]): iter([(_text(f(s)), g)]))
        elif node[0] == "gen":
            parts.append(lambda s, g, f=_emit(node[1]): f(s, True))
        elif node[0] == "for":
            parts.append(_loop(node[1], _value(node[2]), _emit(node[3])))
        else:
            parts.append(_branch([(_value(t), _emit(b)) for t, b in node[1]], _emit(node[2])))

    def run(s: Scope, g: bool) -> Iterator[tuple[str, bool]]:
        for p in parts:
            yield from p(s, g)

    return run


def _loop(name: str, items: Callable[[Scope], object], body: Emit) -> Emit:
    def run(s: Scope, g: bool) -> Iterator[tuple[str, bool]]:
        for i, x in enumerate(items(s) or ()):
            yield from body(s | {name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0}}, g)

    return run


def _branch(cases: list, other: Emit) -> Emit:
    def run(s: Scope, g: bool) -> Iterator[tuple[str, bool]]:
        for test, body in cases:
            if test(s):
                return body(s, g)
        return other(s, g)

    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """messages to pieces (text, inside a generation mark)."""
    run = _emit(fold_body(parse(source)))
    return lambda messages: run({"messages": messages}, False)


# -- over tables -----------------------------------------------------------------------


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict]]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "role", "text")]
        for conv, role, text in zip(*cols, strict=True):
            yield conv, {"role": role or "", "text": text or ""}


def _format(source: str):
    from itertools import groupby

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compile_template(source), []
        for conv, own in groupby(_conversations(batches), key=lambda r: r[0]):
            part, size, out, spans, cut = 0, 0, [], [], [False]

            def messages(own=own, cut=cut):
                for _, m in own:
                    yield m
                    cut[0] = True  # a message has been rendered: a part may end here

            for text, generated in render(messages()):
                if cut[0] and size >= PART:
                    rows.append((conv, part, "".join(out), spans))
                    part, size, out, spans = part + 1, 0, [], []
                cut[0] = False
                if generated and text:
                    spans.append({"start": size, "stop": size + len(text)})
                out.append(text)
                size += len(text)
            rows.append((conv, part, "".join(out), spans))
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


def format_conversations(spark: SparkSession, rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, text, spans: each conversation's text in parts that end between turns,
    and where in a part the generation marks lie (code points).

    Parts of a conversation follow each other in one partition, in order.
    """
    session(spark)
    rows = columns(rows, conv_id="long", turn="long", role="string", text="string")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(template), "conv_id long, part long, text string, spans array<struct<start:long,stop:long>>")


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn that the default template wrote."""
    at = 0
    while at < len(text):
        # Neither string can be part of an escaped role or text.
        head = text.index("|>\n", at + 2)
        end = text.index("<|end|>\n", head + 3)
        yield unescape(text[at + 2 : head]), unescape(text[head + 3 : end])
        at = end + len("<|end|>\n")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, rows = None, []

    def done(s: list) -> tuple:
        return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

    def table() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for b in batches:
        for conv, part, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "text", "spans")), strict=True):
            if part == 0:
                rows += [done(now)] if now else []
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[5] += len(text)
            for role, said in read_back(text):
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for s in spans:
                learnt = unescape(text[s["start"] : s["stop"]])
                now[3] += len(learnt)
                now[4].update(learnt.encode("utf-8", "surrogatepass"))
        if len(rows) >= 256:
            yield table()
            rows = []
    rows += [done(now)] if now else []
    yield table()


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, a row each; in place, without a shuffle."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
