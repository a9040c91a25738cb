"""Messages of models taken apart: reasoning, content and tool calls, whole or as far as they have come."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar import heal

#: The marks of reasoning and of calls.
THINK = ("<think>", "</think>")
CALL = ("<tool_call>", "</tool_call>")
NAMED_CALL = re.compile(r"<function=([^>\s]+)>")
NAMED_END = "</function>"


def _call(body: str, partial: bool) -> tuple[str, str] | None:
    """(name, arguments as JSON) of a call's object; None if it has no name yet or is no object."""
    text = heal(body.strip()) if partial else body.strip()
    try:
        x = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(x, dict) or not isinstance(x.get("name"), str):
        return None
    args = x.get("arguments", x.get("parameters", {}))
    return x["name"], args if isinstance(args, str) else json.dumps(args, ensure_ascii=False)


def parse_message(text: str, partial: bool = False) -> tuple[str | None, str, list[tuple[str, str]]]:
    """(reasoning, content, calls) of a message.

    Calls are ``<tool_call>{...}</tool_call>``, ``<function=name>{...}</function>``, or a message that is one object with ``tool_calls``. What isn't a
    call stays content. With ``partial`` an open mark's text counts as far as it has come, and a half-written mark at the end is held back.
    """
    reasoning, calls = None, []
    rest = text
    if rest.lstrip().startswith(THINK[0]):
        inner = rest.lstrip()[len(THINK[0]) :]
        thought, end, after = inner.partition(THINK[1])
        if end or partial:
            reasoning, rest = thought.strip(), after.lstrip() if end else ""
    if rest.lstrip().startswith('{"tool_calls"'):
        whole = heal(rest.strip()) if partial else rest.strip()
        try:
            listed = [_call(json.dumps(c), False) for c in json.loads(whole or "")["tool_calls"]]
            return reasoning, "", [c for c in listed if c]
        except (ValueError, TypeError, KeyError):
            pass
    out, at = [], 0
    while at < len(rest):
        plain, named = rest.find(CALL[0], at), NAMED_CALL.search(rest, at)
        start = min(x for x in (plain if plain >= 0 else len(rest), named.start() if named else len(rest)))
        out.append(rest[at:start])
        if start == len(rest):
            break
        by_name = named is not None and named.start() == start
        first = named.end() if by_name else start + len(CALL[0])
        stop = rest.find(NAMED_END if by_name else CALL[1], first)
        body = rest[first : stop if stop >= 0 else len(rest)]
        if by_name:
            args = heal(body.strip()) if partial and stop < 0 else body.strip()
            found = (named[1], args) if args and _is_json(args) else None
        else:
            found = _call(body, partial and stop < 0)
        after = len(rest) if stop < 0 else stop + len(NAMED_END if by_name else CALL[1])
        if found and (stop >= 0 or partial):
            calls.append(found)
        elif not partial or stop >= 0:
            out.append(rest[start:after])
        at = after
    content = "".join(out)
    if partial:
        for mark in (CALL[0], "<function="):
            for n in range(len(mark) - 1, 0, -1):
                if content.endswith(mark[:n]):
                    content = content[:-n]
                    break
    return reasoning, content.strip() if calls else content, calls


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def parse_messages(d: DataFrame, text: str, keep: list[str], partial: bool = False) -> DataFrame:
    """``keep``, reasoning, content and calls (array of name and arguments) of a column; a null text has an empty content."""
    call = pa.struct([("name", pa.string()), ("arguments", pa.string())])
    schema = ", ".join(f"{c} {t}" for c, t in d.select(*keep).dtypes) + ", reasoning string, content string, calls array<struct<name:string,arguments:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_message(t or "", partial) for t in b.column("x_text").to_pylist()]
            calls = pa.array([[{"name": n, "arguments": a} for n, a in c] for _, _, c in got], pa.list_(call))
            columns = [pa.array([r for r, _, _ in got], pa.string()), pa.array([c for _, c, _ in got], pa.string()), calls]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *columns], [*keep, "reasoning", "content", "calls"])

    return d.select(*keep, F.col(text).alias("x_text")).mapInArrow(run, schema)
