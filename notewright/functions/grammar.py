"""Grammars of answers: a rule language (alternatives, classes, repetition), its matcher, JSON schemas as grammars, and half-finished JSON.

``parse`` reads rules of the form ``name ::= "literal" [a-z]+ ( other | "x" ){2,4} .``. ``to_regex`` turns a grammar without recursion
into one pattern for the JVM, so that a whole column is validated by ``rlike``; ``accepts`` walks any grammar, left recursion excepted,
and also tells whether a text is the beginning of a sentence, which is what masking candidates needs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escapes of literals and classes.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', "[": "[", "]": "]", "-": "-", "^": "^"}

# A node is a tuple: ("lit", text), ("set", ranges, negated), ("any",), ("ref", name), ("seq", nodes), ("alt", nodes)
# or ("rep", node, least, most or None).


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self, lines: bool) -> None:
        while m := re.compile(r"[ \t]+|#[^\r\n]*" + (r"|[\r\n]+" if lines else "")).match(self.text, self.at):
            self.at = m.end()

    def take(self, pattern: str) -> str | None:
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m[0] if m else None

    def need(self, pattern: str, what: str) -> str:
        got = self.take(pattern)
        if got is None:
            raise ValueError(f"expected {what} at {self.at}: {self.text[self.at : self.at + 20]!r}")
        return got

    def char(self) -> str:
        if self.take(r"\\"):
            kind = self.need(r".", "an escape")
            if kind in "xuU":
                n = {"x": 2, "u": 4, "U": 8}[kind]
                return chr(int(self.need(f"[0-9A-Fa-f]{{{n}}}", f"{n} hexadecimal digits"), 16))
            if kind not in ESCAPES:
                raise ValueError(f"unknown escape {kind!r} at {self.at}")
            return ESCAPES[kind]
        return self.need(r"[\s\S]", "a character")


def parse(text: str) -> dict[str, tuple]:
    """Rules by name; ValueError for bad syntax, unknown names and left recursion."""
    r, rules = _Reader(text), {}
    r.space(True)
    while r.at < len(text):
        name = r.need(r"[A-Za-z0-9-]+", "a rule's name")
        r.space(False)
        r.need("::=", "::=")
        r.space(True)
        rules[name] = _alternatives(r, False)
        r.space(False)
        if r.at < len(text):
            r.need(r"[\r\n]+", "the end of a rule")
        r.space(True)
    for name, node in rules.items():
        for ref in _refs(node):
            if ref not in rules:
                raise ValueError(f"rule {name} names {ref}, which isn't there")
    _no_left_recursion(rules)
    return rules


def _alternatives(r: _Reader, nested: bool) -> tuple:
    out = [_sequence(r, nested)]
    while r.take(r"\|"):
        r.space(True)
        out.append(_sequence(r, nested))
    return out[0] if len(out) == 1 else ("alt", tuple(out))


def _sequence(r: _Reader, nested: bool) -> tuple:
    out: list[tuple] = []
    while True:
        if r.take('"'):
            chars = []
            while not r.take('"'):
                chars.append(r.char())
            node = ("lit", "".join(chars))
        elif r.take(r"\["):
            negated, ranges = bool(r.take(r"\^")), []
            while not r.take(r"\]"):
                low = r.char()
                high = r.char() if r.take(r"-(?!\])") else low
                ranges.append((low, high))
            node = ("set", tuple(ranges), negated)
        elif r.take(r"\("):
            r.space(True)
            node = _alternatives(r, True)
            r.need(r"\)", "a closing bracket")
        elif r.take(r"\."):
            node = ("any",)
        elif name := r.take(r"[A-Za-z0-9-]+(?![A-Za-z0-9-]*\s*::=)"):
            node = ("ref", name)
        else:
            return out[0] if len(out) == 1 else ("seq", tuple(out))
        r.space(nested)
        while mark := r.take(r"[*+?]|\{\d+(,\d*)?\}"):
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(mark, (0, 0))
            if mark[0] == "{":
                a, comma, b = mark[1:-1].partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            node = ("rep", node, low, high)
            r.space(nested)
        out.append(node)


def _refs(node: tuple) -> Iterator[str]:
    if node[0] == "ref":
        yield node[1]
    for x in node[1] if node[0] in ("seq", "alt") else node[1:2] if node[0] == "rep" else ():
        yield from _refs(x)


def _empty(node: tuple, rules: dict, busy: frozenset = frozenset()) -> bool:
    kind = node[0]
    if kind == "ref":
        return node[1] not in busy and _empty(rules[node[1]], rules, busy | {node[1]})
    if kind in ("seq", "alt"):
        return (all if kind == "seq" else any)(_empty(x, rules, busy) for x in node[1])
    return node[2] == 0 or _empty(node[1], rules, busy) if kind == "rep" else kind == "lit" and not node[1]


def _leading(node: tuple, rules: dict) -> Iterator[str]:
    kind = node[0]
    if kind == "ref":
        yield node[1]
    elif kind == "alt":
        for x in node[1]:
            yield from _leading(x, rules)
    elif kind == "rep":
        yield from _leading(node[1], rules)
    elif kind == "seq":
        for x in node[1]:
            yield from _leading(x, rules)
            if not _empty(x, rules):
                break


def _no_left_recursion(rules: dict) -> None:
    first = {n: set(_leading(x, rules)) for n, x in rules.items()}
    for name in rules:
        seen, todo = set(), list(first[name])
        while todo:
            x = todo.pop()
            if x == name:
                raise ValueError(f"rule {name} is left-recursive")
            if x not in seen:
                seen.add(x)
                todo += first[x]


def _in_class(text: str) -> str:
    return re.sub(r"([\\\]\[^&~-])", r"\\\1", text)


def to_regex(rules: dict[str, tuple], root: str = "root") -> str:
    """One anchored pattern of a grammar without recursion, for Java and Python alike; ValueError for a recursive one."""

    def of(node: tuple, path: tuple) -> str:
        kind = node[0]
        if kind == "lit":
            return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", node[1])
        if kind == "any":
            return r"[\s\S]"
        if kind == "set":
            return f"[{'^' * node[2]}{''.join(_in_class(a) if a == b else f'{_in_class(a)}-{_in_class(b)}' for a, b in node[1])}]"
        if kind == "ref":
            if node[1] in path:
                raise ValueError(f"rule {node[1]} is recursive")
            return f"(?:{of(rules[node[1]], (*path, node[1]))})"
        if kind == "seq":
            return "".join(f"(?:{of(x, path)})" if x[0] == "alt" else of(x, path) for x in node[1])
        if kind == "alt":
            return "|".join(of(x, path) for x in node[1])
        most = "" if node[3] is None else node[3]
        return f"(?:{of(node[1], path)}){{{node[2]},{most}}}"

    return rf"\A(?:{of(rules[root], (root,))})\z"


class Matcher:
    """All the ways through a grammar at once: a set of stacks of what is still to come, advanced character by character."""

    def __init__(self, rules: dict[str, tuple], root: str = "root"):
        self.rules = rules
        self.start = self._open({(("ref", root),)})
        self.known: dict[tuple, frozenset] = {}

    def _open(self, stacks: set[tuple]) -> frozenset:
        """Stacks whose top is a character to read, or empty ones for a sentence that ends here."""
        out, seen, todo = set(), set(), list(stacks)
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            if not s:
                out.add(s)
                continue
            node, rest = s[0], s[1:]
            kind = node[0]
            if kind == "ref":
                todo.append((self.rules[node[1]], *rest))
            elif kind == "seq":
                todo.append((*node[1], *rest))
            elif kind == "alt":
                todo += [(x, *rest) for x in node[1]]
            elif kind == "rep":
                x, low, high = node[1:]
                if low <= 0:
                    todo.append(rest)
                if high is None or high > 0:
                    todo.append((x, ("rep", x, max(0, low - 1), None if high is None else high - 1), *rest))
            elif kind == "lit" and not node[1]:
                todo.append(rest)
            else:
                out.add(s)
        return frozenset(out)

    def step(self, stacks: frozenset, char: str) -> frozenset:
        key = (stacks, char)
        if key not in self.known:
            nxt = set()
            for s in stacks:
                if not s:
                    continue
                node, rest = s[0], s[1:]
                if node[0] == "lit":
                    if node[1][0] == char:
                        nxt.add((("lit", node[1][1:]), *rest))
                elif node[0] == "any" or any(a <= char <= b for a, b in node[1]) != node[2]:
                    nxt.add(rest)
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self._open(nxt)
        return self.known[key]

    def advance(self, text: str, stacks: frozenset | None = None) -> frozenset:
        stacks = self.start if stacks is None else stacks
        for c in text:
            stacks = self.step(stacks, c)
            if not stacks:
                break
        return stacks

    def accepts(self, text: str) -> bool:
        """Whether the text is a whole sentence."""
        return () in self.advance(text)

    def begins(self, text: str) -> bool:
        """Whether some sentence begins with the text."""
        return bool(self.advance(text))


def validate(d: DataFrame, text: str, grammar: str, keep: list[str], root: str = "root") -> DataFrame:
    """``keep`` and ok: by one pattern in the JVM if the grammar isn't recursive, else by the matcher in Arrow batches."""
    rules = parse(grammar)
    try:
        pattern = to_regex(rules, root)
    except ValueError:
        pattern = None
    if pattern is not None:
        return d.select(*keep, F.coalesce(F.col(text).rlike(pattern), F.lit(False)).alias("ok"))
    return _per_text(d, text, keep, "ok boolean", pa.bool_(), lambda: (lambda m: lambda t: t is not None and m.accepts(t))(Matcher(rules, root)))


def _per_text(d: DataFrame, text: str, keep: list[str], column: str, kind: pa.DataType, make: Callable) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in d.select(*keep).dtypes) + f", {column}"
    name = column.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            out = pa.array([f(x) for x in b.column("x_text").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], out], [*keep, name])

    return d.select(*keep, F.col(text).alias("x_text")).mapInArrow(run, schema)


def grammar_mask(candidates: DataFrame, grammar: str, key: str, so_far: str, piece: str, root: str = "root") -> DataFrame:
    """Candidates (key, so_far, piece, ...) whose piece can follow what a sentence has so far; an empty piece needs a whole sentence."""
    rules = parse(grammar)
    kinds = candidates.dtypes
    names = [c for c, _ in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(rules, root)
        for b in batches:
            keep = []
            for before, more in zip(b.column(so_far).to_pylist(), b.column(piece).to_pylist(), strict=True):
                at = m.advance(before or "")
                keep.append(() in at if not more else bool(at) and bool(m.advance(more, at)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return candidates.select(*names).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds))


# JSON schemas

#: The common rules of JSON.
JSON_RULES = r'''
ws ::= [ \t\n]{0,20}
string ::= "\"" char* "\""
char ::= [^"\\\x00-\x1F] | "\\" (["\\bfnrt/] | "u" [0-9a-fA-F]{4})
integer ::= "-"? ("0" | [1-9] [0-9]{0,15})
number ::= integer ("." [0-9]{1,16})? ([eE] [-+]? [0-9]{1,15})?
boolean ::= "true" | "false"
null ::= "null"
value ::= object | array | string | number | boolean | null
object ::= "{" ws (string ws ":" ws value (ws "," ws string ws ":" ws value)*)? ws "}"
array ::= "[" ws (value (ws "," ws value)*)? ws "]"
'''


def digits_between(low: int, high: int) -> str:
    """Alternatives of digit classes for the whole numbers from low to high, both 0 or more."""
    out = []

    def upto(prefix: str, a: str, b: str) -> None:
        if a == b:
            out.append(f'"{prefix}{a}"')
            return
        if len(a) == 1:
            out.append((f'"{prefix}" ' if prefix else "") + f"[{a}-{b}]")
            return
        if set(a) == {"0"} and set(b) == {"9"}:
            out.append((f'"{prefix}" ' if prefix else "") + f"[0-9]{{{len(a)}}}")
            return
        if a[0] == b[0]:
            upto(prefix + a[0], a[1:], b[1:])
            return
        first, last = int(a[0]), int(b[0])
        if set(a[1:]) != {"0"}:
            upto(prefix + a[0], a[1:], "9" * (len(a) - 1))
            first += 1
        end = last if set(b[1:]) == {"9"} else last - 1
        if first <= end:
            out.append((f'"{prefix}" ' if prefix else "") + f"[{first}-{end}] [0-9]{{{len(a) - 1}}}")
        if end < last:
            upto(prefix + b[0], "0" * (len(b) - 1), b[1:])

    for n in range(len(str(low)), len(str(high)) + 1):
        a, b = max(low, 10 ** (n - 1) if n > 1 else 0), min(high, 10**n - 1)
        upto("", str(a), str(b))
    return " | ".join(out)


def integers(low: int | None, high: int | None) -> str:
    """Rule body for integers within the limits that are given (16 digits at most)."""
    top = 10**15 - 1
    low, high = -top if low is None else low, top if high is None else high
    parts = []
    if low < 0:
        parts.append(f'"-" ({digits_between(max(1, -high), -low)})')
    if high >= 0:
        parts.append(f"({digits_between(max(0, low), high)})")
    return " | ".join(parts)


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


class _Schema:
    def __init__(self, schema: dict):
        self.schema, self.rules, self.names = schema, {}, {}

    def add(self, hint: str, body: str) -> str:
        name = re.sub(r"[^A-Za-z0-9-]+", "-", hint) or "x"
        while name in self.rules and self.rules[name] != body:
            name += "-x"
        self.rules[name] = body
        return name

    def visit(self, s, hint: str) -> str:
        """The rule's name or body for a schema."""
        if s is True or s == {}:
            return "value"
        if "$ref" in s:
            ref = s["$ref"]
            if ref not in self.names:
                self.names[ref] = name = f"ref{len(self.names)}"
                at = self.schema
                for part in ref.removeprefix("#").strip("/").split("/") if ref != "#" else []:
                    at = at[part]
                self.rules[name] = self.visit(at, name)
            return self.names[ref]
        if "const" in s:
            return quoted(json.dumps(s["const"], ensure_ascii=False))
        if "enum" in s:
            return "(" + " | ".join(quoted(json.dumps(x, ensure_ascii=False)) for x in s["enum"]) + ")"
        for word in ("oneOf", "anyOf"):
            if word in s:
                return "(" + " | ".join(self.visit(x, f"{hint}-{i}") for i, x in enumerate(s[word])) + ")"
        if isinstance(s.get("type"), list):
            return "(" + " | ".join(self.visit({**s, "type": t}, f"{hint}-{t}") for t in s["type"]) + ")"
        if "allOf" in s:
            return self.visit(self.merged(s), hint)
        kind = s.get("type")
        if kind == "object" or "properties" in s:
            return self.object(s, hint)
        if kind == "array" or "items" in s or "prefixItems" in s:
            return self.array(s, hint)
        if kind == "string":
            low, high = s.get("minLength", 0), s.get("maxLength", "")
            return "string" if not low and high == "" else f'("\\"" char{{{low},{high}}} "\\"")'
        if kind == "integer" and {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"} & s.keys():
            low, high = s.get("minimum"), s.get("maximum")
            low = s["exclusiveMinimum"] + 1 if "exclusiveMinimum" in s else low
            high = s["exclusiveMaximum"] - 1 if "exclusiveMaximum" in s else high
            return self.add(f"{hint}-range", integers(low, high))
        if kind in ("integer", "number", "boolean", "null"):
            return kind
        return "value"

    def merged(self, s: dict) -> dict:
        out = {k: v for k, v in s.items() if k != "allOf"} | {"type": "object"}
        out["properties"], out["required"] = dict(out.get("properties", {})), list(out.get("required", []))
        for part in s["allOf"]:
            while "$ref" in part:
                at = self.schema
                for x in part["$ref"].removeprefix("#").strip("/").split("/"):
                    at = at[x]
                part = at
            part = self.merged(part) if "allOf" in part else part
            out["properties"] |= part.get("properties", {})
            out["required"] += part.get("required", [])
        return out

    def object(self, s: dict, hint: str) -> str:
        props, required = s.get("properties", {}), set(s.get("required", []))
        pair = {k: self.add(f"{hint}-{k}-kv", f"{quoted(json.dumps(k))} ws \":\" ws {self.visit(v, f'{hint}-{k}')}") for k, v in props.items()}
        must, may = [pair[k] for k in props if k in required], [pair[k] for k in props if k not in required]
        extra = s.get("additionalProperties", False if props else True)
        if extra is not False:
            may.append(self.add(f"{hint}-more", f"string ws \":\" ws {self.visit(extra, f'{hint}-value')} (ws \",\" ws string ws \":\" ws {self.visit(extra, f'{hint}-value')})*"))
        tail = ""
        for x in reversed(may):  # optional ones in order, each with the comma before it
            tail = f'(ws "," ws {x})? {tail}'.strip()
        if must:
            body = ' ws "," ws '.join(must) + (f" {tail}" if tail else "")
        else:
            options = [f"{x} " + " ".join(f'(ws "," ws {y})?' for y in may[i + 1 :]) for i, x in enumerate(may)]
            body = f"({' | '.join(o.strip() for o in options)})?" if options else ""
        return self.add(f"{hint}-object", f'"{{" ws {body} ws "}}"')

    def array(self, s: dict, hint: str) -> str:
        if "prefixItems" in s:
            body = ' ws "," ws '.join(self.visit(x, f"{hint}-{i}") for i, x in enumerate(s["prefixItems"]))
            return self.add(f"{hint}-tuple", f'"[" ws {body} ws "]"')
        item = self.add(f"{hint}-item", self.visit(s.get("items", {}), f"{hint}-item"))
        low, high = s.get("minItems", 0), s.get("maxItems")
        if high == 0:
            return '"[" ws "]"'
        more = f'{item} (ws "," ws {item}){{{max(0, low - 1)},{"" if high is None else high - 1}}}'
        return self.add(f"{hint}-array", f'"[" ws ({more}){"" if low else "?"} ws "]"')


def schema_grammar(schema: dict) -> str:
    """Rules for the JSON texts of a schema: $ref, oneOf, anyOf, allOf, const, enum, objects, arrays, string lengths, integer ranges.

    Properties come in the schema's order. ``oneOf`` takes any of its forms, as a grammar can't exclude the texts that two of them share;
    ``contracts.schema_to_checks`` counts the forms that hold.
    """
    s = _Schema(schema)
    root = s.visit(schema, "root")
    rules = {"root": root} | s.rules
    return "\n".join(f"{n} ::= {b}" for n, b in rules.items()) + JSON_RULES


# Half-finished JSON


STRING = re.compile(r'"(?:[^"\\]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*')
HALF_ESCAPE = re.compile(r"\\(?:u[0-9A-Fa-f]{0,3})?")
UNFINISHED = re.compile(r"-?\d*\.?\d*(?:[eE][-+]?\d*)?|t(?:r(?:ue?)?)?|f(?:a(?:l(?:se?)?)?)?|n(?:u(?:ll?)?)?")


def heal(text: str, marker: str | None = None) -> str | None:
    """Valid JSON from the beginning of one: open strings, arrays and objects are closed; null if it can't begin a JSON text.

    What can't be finished (a key without a value, a half-written word or number behind a comma) becomes null, or is left out if
    it is a key. With ``marker`` the place of the cut is marked by it, as a string's end or as a value.
    """
    stack: list[str] = []
    state, out, i = "value", [], 0
    mark = marker or ""
    word = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
    n = len(text)
    while i < n:
        c = text[i]
        if c in " \t\r\n":
            out.append(c)
            i += 1
        elif state in ("value", "first") and c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
            state, i = ("key1" if c == "{" else "first"), i + 1
        elif c == '"' and state in ("value", "first", "key", "key1"):
            m = STRING.match(text, i)
            end = m.end()
            if end >= n or HALF_ESCAPE.fullmatch(text, end):  # the string is open
                if state in ("key", "key1"):
                    return _closed(out + ([f'{m[0]}{mark}": null'] if marker else []), stack, trim=not marker)
                return _closed([*out, f'{m[0]}{mark}"'], stack)
            if text[end] != '"':
                return None
            out.append(text[i : end + 1])
            state, i = ("colon" if state in ("key", "key1") else "after"), end + 1
        elif state in ("value", "first") and (m := word.match(text, i)) and (m.end() < n and text[m.end()] not in ".eE" or m[0] in ("true", "false", "null") or m.end() == n and not stack):
            out.append(m[0])
            state, i = "after", m.end()
        elif state in ("value", "first") and UNFINISHED.fullmatch(text, i):
            return _closed([*out, f'"{mark}"' if marker else "null"], stack)
        elif state == "colon" and c == ":":
            out.append(c)
            state, i = "value", i + 1
        elif state == "after" and c == "," and stack:
            out.append(c)
            state, i = ("key" if stack[-1] == "}" else "value"), i + 1
        elif c in "}]" and stack and stack[-1] == c and state in ("after", "key1" if c == "}" else "first"):
            out.append(stack.pop())
            state, i = "after", i + 1
        else:
            return None
    if state == "colon":
        out.append(": null")
    elif state == "value":
        out.append(f'"{mark}"' if marker else "null")
    elif state == "key":
        return _closed(out, stack, trim=True)
    return _closed(out, stack)


def _closed(out: list[str], stack: list[str], trim: bool = False) -> str:
    text = "".join(out)
    if trim:
        text = re.sub(r",\s*$", "", text)
    return text + "".join(reversed(stack))


def heal_json(d: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and healed: the column's half-finished JSON texts as whole ones; null where there is none to be had."""
    return _per_text(d, text, keep, "healed string", pa.string(), lambda: lambda t: heal(t) if t is not None else None)


def partial_match(pattern: str, text: str) -> tuple[int, int] | None:
    """(start, end) of the first match, or (start, len(text)) of the longest ending that could still become one; None else.

    For patterns of literals, classes, groups without look-around: each beginning of the pattern is tried as an optional tail.
    """
    m = re.search(pattern, text)
    if m:
        return m.start(), m.end()
    tail = re.search(f"(?:{_prefixes(pattern)})\\Z", text)
    return (tail.start(), len(text)) if tail and tail.end() > tail.start() else None


def _prefixes(pattern: str) -> str:
    """A pattern for the non-empty beginnings of what ``pattern`` matches."""
    from re import _constants as K
    from re import _parser as P

    def one(op, av) -> tuple[str, str]:
        """(the whole item, its beginnings)."""
        if op is K.LITERAL:
            return re.escape(chr(av)), re.escape(chr(av))
        if op is K.NOT_LITERAL:
            return f"[^{re.escape(chr(av))}]", f"[^{re.escape(chr(av))}]"
        if op is K.ANY:
            return ".", "."
        if op is K.IN:
            body = "".join(_class_item(o, a) for o, a in av)
            return f"[{body}]", f"[{body}]"
        if op is K.SUBPATTERN:
            return seq(av[3])
        if op is K.BRANCH:
            parts = [seq(x) for x in av[1]]
            return f"(?:{'|'.join(w for w, _ in parts)})", f"(?:{'|'.join(b for _, b in parts)})"
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, x = av
            whole, begin = seq(x)
            most = "" if high is K.MAXREPEAT else int(high)
            before = "" if high is K.MAXREPEAT else max(0, int(high) - 1)
            return f"(?:{whole}){{{int(low)},{most}}}", f"(?:{whole}){{0,{before}}}(?:{begin})"
        raise ValueError(f"partial matches of {op} aren't known")

    def seq(items) -> tuple[str, str]:
        parts = [one(o, a) for o, a in items]
        begins = ["".join(w for w, _ in parts[:i]) + parts[i][1] for i in range(len(parts))]
        return "(?:" + "".join(w for w, _ in parts) + ")", "(?:" + "|".join(reversed(begins)) + ")"

    return seq(P.parse(pattern))[1]


def _class_item(op, av) -> str:
    from re import _constants as K

    if op is K.NEGATE:
        return "^"
    if op is K.RANGE:
        return f"{re.escape(chr(av[0]))}-{re.escape(chr(av[1]))}"
    if op is K.CATEGORY:
        return {K.CATEGORY_DIGIT: r"\d", K.CATEGORY_NOT_DIGIT: r"\D", K.CATEGORY_SPACE: r"\s", K.CATEGORY_NOT_SPACE: r"\S", K.CATEGORY_WORD: r"\w", K.CATEGORY_NOT_WORD: r"\W"}[av]
    return re.escape(chr(av))
