"""Chat templates as native expressions: a template is parsed once on the driver and compiled to a Column, loops as ``transform``, branches as ``when``.

The language is the part of Jinja that chat templates use: text, ``{{ }}`` and ``{% %}`` with their white-space marks, ``for`` over lists (with ``loop.first``,
``last``, ``index``, ``index0``), ``if`` / ``elif`` / ``else``, ``set``; literals, names, attributes, items, slices, ``+`` and ``~``, comparisons, ``in``, ``and``,
``or``, ``not``, ``is (not) defined``, ``is (not) none``, the filters trim, upper, lower, length, tojson and default, and ``raise_exception``. Newlines behind a block tag are dropped
and blanks before one (trim_blocks, lstrip_blocks). Fields of structs are looked up in the schema when the template is compiled, so a field that isn't there is undefined,
not an error; what is null is none and spells nothing. A construct outside this list is a ValueError that names it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, NumericType, StringType, StructType

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#-?.*?-?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~.,|()\[\]:<>=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class Value:
    """A compiled expression and its type; no column means undefined."""

    column: Column | None
    kind: DataType

    @property
    def text(self) -> Column:
        if self.column is None:
            return F.lit("")
        shown = F.when(self.column, "True").otherwise("False") if isinstance(self.kind, BooleanType) else F.to_json(self.column) if isinstance(self.kind, (StructType, ArrayType)) else self.column.cast("string")
        return F.coalesce(shown, F.lit(""))

    @property
    def truth(self) -> Column:
        if self.column is None:
            return F.lit(False)
        held = self.column if isinstance(self.kind, BooleanType) else self.column != "" if isinstance(self.kind, StringType) else F.size(self.column) > 0 if isinstance(self.kind, ArrayType) else self.column != 0 if isinstance(self.kind, NumericType) else self.column.isNotNull()
        return F.coalesce(held, F.lit(False))


STR, INT, BOOL = StringType(), IntegerType(), BooleanType()
Env = dict[str, Value]


def _split(source: str) -> list[tuple[str, str]]:
    """("text" | "say" | "do", content) in order, with white space trimmed as the tags ask."""
    parts = _TAG.split(source)
    out: list[tuple[str, str]] = []
    for i, p in enumerate(parts):
        if i % 2:
            if not p.startswith("{#"):
                out.append(("say" if p.startswith("{{") else "do", p[2:-2].strip("-").strip()))
            continue
        if i and parts[i - 1][-3] == "-":
            p = p.lstrip()
        elif i and parts[i - 1].startswith(("{%", "{#")):
            p = p.removeprefix("\n")
        if i + 1 < len(parts):
            if parts[i + 1][2] == "-":
                p = p.rstrip()
            elif parts[i + 1].startswith(("{%", "{#")):
                p = re.sub(r"(^|\n)[ \t]+$", r"\1", p) if i or "\n" in p else p.lstrip(" \t") if not p.strip(" \t") else p
        out.append(("text", p))
    return [x for x in out if x[0] != "text" or x[1]]


class _Words:
    def __init__(self, source: str):
        self.source, self.words, at = source, [], 0
        while at < len(source.rstrip()):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"not understood in a template: {source[at:at + 20]!r}")
            self.words.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *want: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] != "text" and self.words[self.at][1] in want

    def take(self, *want: str) -> tuple[str, str]:
        if self.at >= len(self.words) or want and not self.peek(*want):
            raise ValueError(f"{' or '.join(want) or 'more'} wanted in {self.source!r}")
        self.at += 1
        return self.words[self.at - 1]


def expression(source: str, env: Env) -> Value:
    """The Value of one expression."""
    w = _Words(source)
    out = _either(w, env)
    if w.at < len(w.words):
        raise ValueError(f"not understood in a template: {source!r}")
    return out


def _either(w: _Words, env: Env) -> Value:
    out = _both(w, env)
    while w.peek("or"):
        w.take()
        out = Value(out.truth | _both(w, env).truth, BOOL)
    return out


def _both(w: _Words, env: Env) -> Value:
    out = _negated(w, env)
    while w.peek("and"):
        w.take()
        out = Value(out.truth & _negated(w, env).truth, BOOL)
    return out


def _negated(w: _Words, env: Env) -> Value:
    if w.peek("not"):
        w.take()
        return Value(~_negated(w, env).truth, BOOL)
    return _compared(w, env)


def _compared(w: _Words, env: Env) -> Value:
    out = _added(w, env)
    while True:
        if w.peek("==", "!=", "<", ">", "<=", ">="):
            op, other = w.take()[1], _added(w, env)
            if out.column is None or other.column is None:
                same = F.lit(out.column is None and other.column is None)
                out = Value(same if op == "==" else ~same if op == "!=" else F.lit(False), BOOL)
                continue
            a, b = out.column, other.column
            out = Value({"==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}[op](), BOOL)
        elif w.peek("is"):
            w.take()
            no = w.peek("not") and bool(w.take())
            test = w.take()[1]
            if test not in ("defined", "none", "string"):
                raise ValueError(f"unknown test {test!r}")
            held = F.lit(out.column is not None) if test == "defined" else F.lit(isinstance(out.kind, StringType)) if test == "string" else F.lit(True) if out.column is None else out.column.isNull()
            out = Value(~held if no else held, BOOL)
        elif w.peek("in", "not"):
            no = w.take()[1] == "not"
            if no:
                w.take("in")
            other = _added(w, env)
            held = F.lit(False) if out.column is None or other.column is None else F.array_contains(other.column, out.column) if isinstance(other.kind, ArrayType) else F.contains(other.column, out.column)
            held = F.coalesce(held, F.lit(False))
            out = Value(~held if no else held, BOOL)
        else:
            return out


def _added(w: _Words, env: Env) -> Value:
    out = _postfix(w, env)
    while w.peek("+", "~", "-"):
        op, other = w.take()[1], _postfix(w, env)
        numbers = isinstance(out.kind, NumericType) and isinstance(other.kind, NumericType) and op != "~"
        out = Value(out.column + other.column if op == "+" else out.column - other.column, INT) if numbers else Value(F.concat(out.text, other.text), STR)
    return out


def _field(of: Value, name: str) -> Value:
    if of.column is not None and isinstance(of.kind, StructType) and name in of.kind.names:
        return Value(of.column[name], of.kind[name].dataType)
    return Value(None, STR)


def _number(w: _Words, env: Env) -> Column:
    sign = -1 if w.peek("-") and w.take() else 1
    return _added(w, env).column * sign


def _item(of: Value, w: _Words, env: Env) -> Value:
    """An item or a slice, behind its opening bracket."""
    if w.words[w.at][0] == "text":
        name = _literal(w.take()[1])
        w.take("]")
        return _field(of, name)
    first = F.lit(0) if w.peek(":") else _number(w, env)
    if not w.peek(":"):
        w.take("]")
        if of.column is None:
            return of
        return Value(F.get(of.column, F.when(first < 0, F.size(of.column) + first).otherwise(first)), of.kind.elementType)
    w.take(":")
    size = F.size(of.column)
    last = size if w.peek("]") else _number(w, env)
    w.take("]")
    low, high = (F.when(x < 0, F.greatest(size + x, F.lit(0))).otherwise(F.least(x, size)) for x in (first, last))
    return Value(F.slice(of.column, low + 1, F.greatest(high - low, F.lit(0))), of.kind)


def _filtered(of: Value, name: str, w: _Words, env: Env) -> Value:
    given = None
    if w.peek("("):
        w.take()
        given = None if w.peek(")") else _either(w, env)
        w.take(")")
    if name == "trim":
        return Value(F.regexp_replace(of.text, r"^\s+|\s+$", ""), STR)
    if name in ("upper", "lower"):
        return Value(getattr(F, name)(of.text), STR)
    if name == "length":
        return Value(F.lit(0) if of.column is None else F.size(of.column) if isinstance(of.kind, ArrayType) else F.length(of.text), INT)
    if name == "tojson":
        if of.column is None:
            return Value(F.lit("null"), STR)
        whole = F.to_json(of.column) if isinstance(of.kind, (StructType, ArrayType)) else F.to_json(F.struct(of.column.alias("x")))
        return Value(F.when(of.column.isNull(), "null").otherwise(whole if isinstance(of.kind, (StructType, ArrayType)) else F.substring(whole, F.lit(6), F.length(whole) - 6)), STR)
    if name == "default":
        return given if of.column is None else Value(F.coalesce(of.column, given.column) if type(of.kind) is type(given.kind) else of.column, of.kind)
    raise ValueError(f"unknown filter {name!r}")


def _literal(word: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S)


def _postfix(w: _Words, env: Env) -> Value:
    kind, word = w.take()
    if kind == "text":
        out = Value(F.lit(_literal(word)), STR)
    elif kind == "number":
        out = Value(F.lit(int(word)), INT)
    elif word == "(":
        out = _either(w, env)
        w.take(")")
    elif word == "raise_exception":
        w.take("(")
        out = Value(F.raise_error(_either(w, env).text).cast("string"), STR)
        w.take(")")
    elif word.lower() in ("true", "false"):
        out = Value(F.lit(word.lower() == "true"), BOOL)
    elif word.lower() == "none":
        out = Value(F.lit(None).cast("string"), STR)
    elif kind == "name":
        out = env.get(word, Value(None, STR))
    else:
        raise ValueError(f"not understood in a template: {word!r} in {w.source!r}")
    while w.peek(".", "[", "|"):
        mark = w.take()[1]
        out = _field(out, w.take()[1]) if mark == "." else _item(out, w, env) if mark == "[" else _filtered(out, w.take()[1], w, env)
    return out


def _body(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    """The nodes up to one of ``ends`` and where that is."""
    nodes: list = []
    while at < len(parts):
        kind, content = parts[at]
        word = content.split(None, 1)[0] if kind == "do" and content else ""
        if word in ends:
            return nodes, at
        if kind != "do":
            nodes.append((kind, content))
        elif word == "for":
            name, over = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", content, re.S).groups()
            inner, at = _body(parts, at + 1, ("endfor",))
            nodes.append(("for", name, over, inner))
        elif word == "if":
            branches, test = [], content[2:]
            while True:
                inner, at = _body(parts, at + 1, ("elif", "else", "endif"))
                branches.append((test, inner))
                word, _, test = parts[at][1].partition(" ")
                if word == "endif":
                    break
                test = test if word == "elif" else None
            nodes.append(("if", branches))
        elif word == "set":
            name, value = re.fullmatch(r"set\s+(\w+)\s*=\s*(.+)", content, re.S).groups()
            nodes.append(("set", name, value))
        else:
            raise ValueError(f"unknown tag {content!r}")
        at += 1
    if ends:
        raise ValueError(f"{ends[0]} is missing")
    return nodes, at


def _render(nodes: list, env: Env) -> Column:
    """The nodes' text; ``env`` gets what they set."""
    out = [F.lit("")]
    for node in nodes:
        if node[0] == "text":
            out.append(F.lit(node[1]))
        elif node[0] == "say":
            out.append(expression(node[1], env).text)
        elif node[0] == "set":
            env[node[1]] = expression(node[2], env)
        elif node[0] == "for":
            over = expression(node[2], env)
            if over.column is not None:
                out.append(F.coalesce(F.array_join(F.transform(over.column, _each(node, over, env)), ""), F.lit("")))
        else:
            text, sets, tests = None, [], []
            for test, inner in node[1]:
                mine = dict(env)
                tests.append(None if test is None else expression(test, env).truth)
                text = text or []
                text.append(_render(inner, mine))
                sets.append(mine)
            out.append(_choose(tests, text, F.lit("")))
            for name in {n for mine in sets for n in mine if mine[n] is not env.get(n)}:
                kind = next(m[name].kind for m in sets if name in m and m[name] is not env.get(name))
                values = [m[name].column if name in m and m[name].column is not None else F.lit(None).cast(kind) for m in sets]
                old = env[name].column if name in env and env[name].column is not None else F.lit(None).cast(kind)
                env[name] = Value(_choose(tests, values, old), kind)
    return F.concat(*out)


def _each(node: tuple, over: Value, env: Env):
    loop = lambda i: F.struct((i == 0).alias("first"), (i == F.size(over.column) - 1).alias("last"), (i + 1).alias("index"), i.alias("index0"))
    kind = StructType().add("first", BOOL).add("last", BOOL).add("index", INT).add("index0", INT)
    return lambda x, i: _render(node[3], {**env, node[1]: Value(x, over.kind.elementType), "loop": Value(loop(i), kind)})


def _choose(tests: list[Column | None], values: list[Column], otherwise: Column) -> Column:
    out = otherwise
    for t, v in reversed(list(zip(tests, values, strict=True))):
        out = v if t is None else F.when(t, v).otherwise(out)
    return out


def compile_template(source: str, schema: StructType, **values: str | int | bool) -> Column:
    """A template over the columns of a DataFrame's ``schema`` and constant ``values`` as a Column."""
    env: Env = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in schema}
    for name, v in values.items():
        env[name] = Value(F.lit(v), BOOL if isinstance(v, bool) else INT if isinstance(v, int) else STR)
    return _render(_body(_split(source), 0, ())[0], env)


#: Three families of answers with tool calls; messages have role, content and calls (name, arguments as JSON text).
FAMILIES = {
    "hermes": """{% for m in messages %}
{% if m.role == 'tool' %}
<|im_start|>tool
<tool_response>
{{ m.content }}
</tool_response><|im_end|>
{% else %}
<|im_start|>{{ m.role }}
{{ m.content }}{% for c in m.calls %}

<tool_call>
{"name": "{{ c.name }}", "arguments": {{ c.arguments }}}
</tool_call>{% endfor %}<|im_end|>
{% endif %}
{% endfor %}
{% if add_generation_prompt %}
<|im_start|>assistant
{% endif %}""",
    "llama3": """{{ bos_token }}{% for m in messages %}
{% set role = m.role %}
{%- if m.role == 'tool' %}{% set role = 'ipython' %}{% endif -%}
<|start_header_id|>{{ role }}<|end_header_id|>

{% if m.calls is defined and m.calls | length == 1 -%}
{"name": "{{ m.calls[0].name }}", "parameters": {{ m.calls[0]['arguments'] }}}
{%- else -%}
{{ m.content | trim }}
{%- endif -%}
<|eot_id|>{% endfor %}
{%- if add_generation_prompt %}<|start_header_id|>assistant<|end_header_id|>

{% endif %}""",
    "mistral": """{{ bos_token }}{% for m in messages %}
{%- if m.role == 'user' or m.role == 'system' -%}
[INST] {{ m.content }}[/INST]
{%- elif m.role == 'tool' -%}
[TOOL_RESULTS] {"content": {{ m.content | tojson }}}[/TOOL_RESULTS]
{%- elif m.calls | length > 0 -%}
[TOOL_CALLS] [{% for c in m.calls %}{"name": "{{ c.name }}", "arguments": {{ c.arguments }}}{% if not loop.last %}, {% endif %}{% endfor %}]{{ eos_token }}
{%- else %} {{ m.content }}{{ eos_token }}
{%- endif %}
{%- endfor %}""",
}
