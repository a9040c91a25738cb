"""Output contracts: parsers of extraction answers into typed columns, chat templates, and prompt suffixes.

An answer that breaks its contract gives null columns and ``valid`` false. Values are fixed.
"""

from __future__ import annotations

import json
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = "(Low|Medium|High|Certain)"
REPORT_FIELDS = ["indication", "colitis_extent", "colitis_severity", "landmarks_reached", "bowel_prep_quality", "random_biopsies_taken", "number_of_visible_lesions", "max_visible_lesion_size"]
LESION_FIELDS = ["sample_ID", "size", "location", "morphology", "completeness_of_resection", "random_bx"]
DYSPLASIA_FIELDS = [
    "sample_ID", "number_of_fragments", "description", "length", "specimen_type", "lesion_type", "number_of_concerning_lesions", "indication",
    "location", "shape", "dysplasia_grade", "inflammation_severity", "inflammation_type", "T_stage", "N_stage",
]


def _struct(fields: list[str]) -> str:
    return "struct<" + ",".join(f"{f}:string" for f in fields) + ">"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    v = F.regexp_extract(text, pattern, group)
    return F.when(v != "", v)


def parse_yes_no(d: DataFrame, answer: str = "answer") -> DataFrame:
    v = _found(F.col(answer), r"^Answer: (Yes|No)\s*$")
    return d.withColumn("value", v).withColumn("valid", v.isNotNull())


def parse_resection(d: DataFrame, answer: str = "answer") -> DataFrame:
    v = _found(F.col(answer), r"^Answer: (R0|R1|R2|Uncertain|Insufficient information)\s*$")
    return d.withColumn("value", v).withColumn("valid", v.isNotNull())


def parse_cancer(d: DataFrame, answer: str = "answer") -> DataFrame:
    """value, confidence, year, month."""
    a = F.col(answer)
    d = d.withColumn("value", _found(a, r"(?im)^Answer: (Yes|No)")).withColumn("confidence", _found(a, rf"(?im)^Confidence: {CONFIDENCE}"))
    d = d.withColumn("year", _found(a, r"(?im)^Year: (\d{4}|Unknown)")).withColumn("month", _found(a, r"(?im)^Month: (\d{1,2}|Unknown)"))
    return d.withColumn("valid", F.col("value").isNotNull() & F.col("confidence").isNotNull())


def parse_diagnosis(d: DataFrame, answer: str = "answer") -> DataFrame:
    """summary, diagnosis, confidence, confirmed."""
    a = F.col(answer)
    d = d.withColumn("summary", _found(a, r"(?im)^Summary: (.+)$")).withColumn("diagnosis", _found(a, r"(?im)^Diagnosis: (.+)$"))
    d = d.withColumn("confidence", _found(a, rf"(?im)^Confidence: {CONFIDENCE}")).withColumn("confirmed", _found(a, r"(?im)^Confirmed: (Yes|No)"))
    return d.withColumn("valid", F.col("diagnosis").isNotNull() & F.col("confidence").isNotNull() & F.col("confirmed").isNotNull())


def parse_year(d: DataFrame, answer: str = "answer") -> DataFrame:
    """summary, thoughts, year_text, confidence, and the first year in year_text."""
    a = F.col(answer)
    d = d.withColumn("summary", _found(a, r"(?im)^Summary: (.+)$")).withColumn("thoughts", _found(a, r"(?im)^Thoughts: (.+)$"))
    d = d.withColumn("year_text", _found(a, r"(?im)^Year: (.+)$")).withColumn("confidence", _found(a, rf"(?im)^Confidence: {CONFIDENCE}"))
    return d.withColumn("year", F.expr("try_cast(nullif(regexp_extract(year_text, '((?:19|20)[0-9]{2})', 1), '') as int)")).withColumn("valid", F.col("year_text").isNotNull())


def parse_procedures(d: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per procedure line "type; segments; month; year", at most three; none for "No"."""
    a = F.col(answer)
    lines = F.slice(F.regexp_extract_all(a, F.lit(r"(?m)^- (.+)$"), F.lit(1)), 1, 3)
    p = d.withColumn("value", _found(a, r"(?im)^Answer: (Yes|No)")).select("*", F.posexplode(lines).alias("no", "line"))
    f = F.split("line", r"\s*;\s*")
    return p.select(*d.columns, "value", "no", F.get(f, F.lit(0)).alias("procedure"), F.split(F.get(f, F.lit(1)), r"\s*,\s*").alias("segments"), F.get(f, F.lit(2)).alias("month"), F.get(f, F.lit(3)).alias("year"))


def parse_history(d: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per "year, month, site" line, at most 20."""
    lines = F.slice(F.regexp_extract_all(answer, F.lit(r"(?m)^(\d{4}|Unknown), *(\d{1,2}|Unknown), *(.+)$"), F.lit(0)), 1, 20)
    p = d.select("*", F.posexplode(lines).alias("no", "line"))
    f = F.split("line", r",\s*", 3)
    return p.select(*d.columns, "no", f[0].alias("year"), f[1].alias("month"), f[2].alias("site"))


def parse_report(d: DataFrame, answer: str = "answer") -> DataFrame:
    """The report object's eight fields."""
    d = d.withColumn("x_j", F.from_json(answer, _struct(REPORT_FIELDS)))
    return d.select(*[c for c in d.columns if c != "x_j"], *[F.col(f"x_j.{f}").alias(f) for f in REPORT_FIELDS], F.col("x_j").isNotNull().alias("valid"))


def parse_lesions(d: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per lesion object of a JSON array."""
    x = d.select("*", F.posexplode(F.from_json(answer, f"array<{_struct(LESION_FIELDS)}>")).alias("no", "x_l"))
    return x.select(*d.columns, "no", "x_l.*")


def parse_dysplasia(d: DataFrame, answer: str = "answer") -> DataFrame:
    """Summary and one row per entry; none for "No concerning samples."."""
    body = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    x = d.select("*", _found(F.col(answer), r"(?m)^Summary: (.+)$").alias("summary"), F.posexplode(F.from_json(body, f"array<{_struct(DYSPLASIA_FIELDS)}>")).alias("no", "x_l"))
    return x.select(*d.columns, "summary", "no", "x_l.*")


#: Turn formats; {role} and {text} are filled in, the last part opens the assistant's turn.
TEMPLATES: dict[str, tuple[str, str]] = {
    "chatml": ("<|im_start|>{role}\n{text}<|im_end|>\n", "<|im_start|>assistant\n"),
    "llama3": ("<|start_header_id|>{role}<|end_header_id|>\n\n{text}<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "phi3": ("<|{role}|>\n{text}<|end|>\n", "<|assistant|>\n"),
    "zephyr": ("<|{role}|>\n{text}<|endoftext|>\n", "<|assistant|>\n"),
    "gemma": ("<start_of_turn>{role}\n{text}<end_of_turn>\n", "<start_of_turn>model\n"),
}


def detect_template(source: Column) -> Column:
    """The template's name by its marks; null if unknown."""
    has = lambda s: source.contains(s)
    return F.when(has("<|im_start|>"), "chatml").when(has("<|start_header_id|>"), "llama3").when(has("<start_of_turn>"), "gemma").when(has("<|end|>"), "phi3").when(has("<|endoftext|>") & has("<|user|>"), "zephyr")


def render_turn(template: str, role: Column, text: Column) -> Column:
    before, rest = TEMPLATES[template][0].split("{role}")
    middle, after = rest.split("{text}")
    if template == "gemma":
        role = F.when(role == "assistant", "model").otherwise(role)
    return F.concat(F.lit(before), role, F.lit(middle), F.trim(text) if template in ("llama3", "gemma") else text, F.lit(after))


def render_chat(messages: DataFrame, template: str, by: str = "conv_id", order: str = "turn", add_assistant: bool = True) -> DataFrame:
    """(by, prompt): a conversation's turns in order."""
    m = messages.select(by, order, render_turn(template, F.col("role"), F.col("text")).alias("x"))
    g = m.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "x"))), lambda s: s["x"]), "").alias("prompt"))
    return g.withColumn("prompt", F.concat("prompt", F.lit(TEMPLATES[template][1]))) if add_assistant else g


def _resolved(s, root: dict, seen: tuple = ()):
    """A schema with its references put in; one that leads back to itself has no finite check."""
    if not isinstance(s, dict):
        return s
    if "$ref" in s:
        ref = s["$ref"]
        if ref in seen or ref == "#":
            raise ValueError(f"recursive reference {ref!r}")
        at = root
        for part in ref.removeprefix("#").strip("/").split("/"):
            at = at[part]
        rest = {k: v for k, v in s.items() if k != "$ref"}
        one = _resolved(at, root, (*seen, ref))
        return {"allOf": [one, _resolved(rest, root, seen)]} if rest else one
    return {
        k: {n: _resolved(x, root, seen) for n, x in v.items()} if k == "properties" else [_resolved(x, root, seen) for x in v] if k in ("anyOf", "oneOf", "allOf", "prefixItems")
        else _resolved(v, root, seen) if k in ("items", "additionalProperties", "not") else v
        for k, v in s.items()
    }


#: What schema_of_variant calls the values of a JSON type.
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "boolean": "^BOOLEAN", "null": "^VOID", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"}


def schema_to_checks(schema: dict | bool, value: Column) -> Column:
    """Whether a JSON text meets a JSON schema, natively: the text becomes a variant, items and properties are checked by ``forall``.

    Known: type (one or several), const, enum, anyOf, oneOf (exactly one form), allOf, not, $ref within the schema (recursive ones are a ValueError), ranges, multipleOf,
    lengths, pattern, properties, required, additionalProperties, items, prefixItems, minItems, maxItems. Other keys are ignored. A whole number is an integer however it is
    written. A null text and one that isn't JSON meet no schema.
    """

    def same(v: Column, kind: Column, x) -> Column:
        if isinstance(x, bool) or x is None or isinstance(x, str):
            held = {bool: "boolean", str: "string"}.get(type(x))
            return kind.rlike(_KINDS[held or "null"]) & (F.lit(True) if held is None else F.coalesce(F.try_variant_get(v, "$", held) == x, F.lit(False)))
        if isinstance(x, (int, float)):
            return kind.rlike(_KINDS["number"]) & F.coalesce(F.try_variant_get(v, "$", "double") == float(x), F.lit(False))
        return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(x))))

    def check(s, v: Column) -> Column:
        if isinstance(s, bool):
            return F.lit(s)
        kind = F.schema_of_variant(v)
        is_ = lambda k: kind.rlike(_KINDS[k])
        number = F.try_variant_get(v, "$", "double")
        parts: list[Column] = []

        def of(k: str, *tests: Column) -> None:
            """The tests hold if the value is of this type."""
            for t in tests:
                parts.append(~is_(k) | F.coalesce(t, F.lit(False)))

        if "type" in s:
            kinds = [s["type"]] if isinstance(s["type"], str) else s["type"]
            typed = lambda k: is_("number") & (number == F.floor(number)) if k == "integer" else is_(k)
            parts.append(reduce(operator.or_, map(typed, kinds)))
        if "const" in s:
            parts.append(same(v, kind, s["const"]))
        if "enum" in s:
            parts.append(reduce(operator.or_, [same(v, kind, x) for x in s["enum"]], F.lit(False)))
        if "anyOf" in s:
            parts.append(reduce(operator.or_, [check(x, v) for x in s["anyOf"]], F.lit(False)))
        if "oneOf" in s:
            parts.append(reduce(operator.add, [check(x, v).cast("int") for x in s["oneOf"]], F.lit(0)) == 1)
        parts += [check(x, v) for x in s.get("allOf", [])]
        if "not" in s:
            parts.append(~check(s["not"], v))
        for k, f in (("minimum", operator.ge), ("maximum", operator.le), ("exclusiveMinimum", operator.gt), ("exclusiveMaximum", operator.lt)):
            if k in s:
                of("number", f(number, F.lit(float(s[k]))))
        if "multipleOf" in s:
            of("number", number / float(s["multipleOf"]) == F.floor(number / float(s["multipleOf"])))
        text = F.try_variant_get(v, "$", "string")
        for k, f in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n), ("pattern", text.rlike)):
            if k in s:
                of("string", f(s[k]))
        if {"items", "prefixItems", "minItems", "maxItems"} & s.keys():
            held, first = F.try_variant_get(v, "$", "array<variant>"), s.get("prefixItems", [])
            of("array", F.size(held) >= s.get("minItems", 0), F.size(held) <= s.get("maxItems", 2**31 - 1))
            of("array", *[(F.size(held) <= i) | check(x, F.get(held, F.lit(i))) for i, x in enumerate(first)])
            if "items" in s:
                of("array", F.forall(F.slice(held, len(first) + 1, F.greatest(F.size(held) - len(first), F.lit(0))), lambda x: check(s["items"], x)))
        if {"properties", "required", "additionalProperties"} & s.keys():
            held, known = F.try_variant_get(v, "$", "map<string,variant>"), s.get("properties", {})
            of("object", *[F.map_contains_key(held, name) for name in s.get("required", [])])
            of("object", *[~F.map_contains_key(held, name) | check(x, F.element_at(held, F.lit(name))) for name, x in known.items()])
            extra = s.get("additionalProperties", True)
            if extra is not True:
                others = F.map_filter(held, lambda k, x: ~k.isin(*known)) if known else held
                of("object", F.size(others) == 0 if extra is False else F.forall(F.map_values(others), lambda x: check(extra, x)))
        return F.coalesce(reduce(operator.and_, parts, F.lit(True)), F.lit(False))

    v = F.try_parse_json(value)
    return v.isNotNull() & check(_resolved(schema, schema if isinstance(schema, dict) else {}), v)
