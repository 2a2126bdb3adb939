"""Documents under a schema (S19, X23) against a plain validator that goes through them key by key."""

import json
import math
import re

from pyspark.sql import functions as F

from tidemark.operators.gates import schema_problems
from tidemark.sources import readers


def kind_of(x):
    if x is None or isinstance(x, bool):
        return "null" if x is None else "boolean"
    return {dict: "object", list: "array", str: "string"}.get(type(x), "number")


def is_kind(x, kind):
    if kind in ("number", "integer"):
        return kind_of(x) == "number" and math.isfinite(x) and (kind == "number" or x == int(x))
    return kind_of(x) == kind


def same(a, b):
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return len(a) == len(b) and all(map(same, a, b)) if isinstance(a, list) else a == b


def problems_by_hand(x, schema, path="$"):
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(is_kind(x, k) for k in kinds):
        return [f"{path}: expected {' or '.join(kinds)}, got {kind_of(x)}"]
    out = []
    if "enum" in schema and not any(same(x, c) for c in schema["enum"]):
        out.append(f"{path}: must be one of the choices")
    if "const" in schema and not same(x, schema["const"]):
        out.append(f"{path}: must equal {json.dumps(schema['const'], ensure_ascii=False, separators=(',', ':'))}")
    if kind_of(x) == "number":
        for key, sign, bad in (("minimum", ">=", lambda a, b: a < b), ("exclusiveMinimum", ">", lambda a, b: a <= b), ("maximum", "<=", lambda a, b: a > b)):
            if key in schema and bad(x, schema[key]):
                out.append(f"{path}: must be {sign} {schema[key]}")
    if isinstance(x, str):
        out += [f"{path}: must have at least {schema.get('minLength')} characters"] * (len(x.encode("utf-16-be")) // 2 < schema.get("minLength", 0))
        pattern = schema.get("pattern", "")
        here = re.sub(r"(?<!\\)[.$]", lambda m: r"\Z" if m[0] == "$" else r"[^\n\r\u2028\u2029]", pattern)
        out += [f"{path}: does not match /{pattern}/"] * (not re.search(here, x))
    if isinstance(x, list) and "items" in schema:
        out += [p for i, item in enumerate(x) for p in problems_by_hand(item, schema["items"], f"{path}[{i}]")]
    if isinstance(x, dict):
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in x]
        for k, item in x.items():
            other = schema.get("additionalProperties")
            if k in schema.get("properties", {}):
                out += problems_by_hand(item, schema["properties"][k], f"{path}.{k}")
            elif other is False:
                out.append(f"{path}.{k}: unknown key")
            elif isinstance(other, dict):
                out += problems_by_hand(item, other, f"{path}.{k}")
    return out


def problems(spark, texts, schema):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.parse_json("text").alias("v"))
    return {r.i: r.problems for r in rows.select("i", schema_problems(F.col("v"), schema).alias("problems")).collect()}


SCALARS = [None, True, False, 0, 1, -1, 2.5, 10**30, "", "a", "1", "true", "null", "ab", "2024", "2024\n", "\U0001f600", "a b", "a\xa0b", "a\rb"]
VALUES = [
    *SCALARS, [], [1], ["1"], [1, [2, None]], [None, "a", True], {}, {"": 1}, {"a": None}, {"a": 1, "b": "x"}, {"b": "x", "a": 1},
    {"a.b": 1, "$c": 2, "d e": 3, 'f"\'?': 4, "g[0]": 5}, {"a": {"b": {"c": 1, "d": True}}}, {"x": {"y": [{"z": 1}, {"z": "no"}]}},
]
NESTED = {"type": "object", "properties": {"z": {"type": "integer"}}, "additionalProperties": False}
SCHEMAS = [
    {}, *({"type": k} for k in ("string", "number", "integer", "boolean", "null", "array", "object")), {"type": ["string", "null", "object"]},
    {"enum": [1, "a", None]}, {"enum": [True, "1", [1]]}, {"enum": [{"a": 1, "b": "x"}, [1, [2, None]]]}, {"enum": [{"b": None}, {}]}, {"const": False}, {"const": "true"}, {"const": 1},
    {"minimum": 1}, {"exclusiveMinimum": 1}, {"maximum": 1, "minimum": 0}, {"minLength": 2}, {"pattern": "^[0-9]{4}$"}, {"pattern": r"\s"}, {"pattern": r"^\S+$"}, {"pattern": "^a.b$"}, {"pattern": r"^[^\sx]+$"},
    {"additionalProperties": {"type": "integer"}}, {"additionalProperties": {}}, {"additionalProperties": True}, {"additionalProperties": False}, {"properties": {"a": {"type": "integer"}}, "additionalProperties": False},
    {"type": "object", "required": ["a", "a.b"], "properties": {"a": {"type": ["integer", "null"]}}, "additionalProperties": {"type": "string", "minLength": 2}},
    {"properties": {k: {"type": "string"} for k in ("", "a.b", "$c", "d e", 'f"\'?', "g[0]")}},
    {"additionalProperties": {"additionalProperties": {"items": NESTED, "additionalProperties": {"type": "boolean"}}}},
    {"items": {"type": ["number", "null"], "minimum": 2}}, {"items": {"items": {"type": "null"}}},
]


def test_every_schema_finds_what_the_plain_validator_finds(spark):
    for schema in SCHEMAS:
        got = problems(spark, map(json.dumps, VALUES), schema)
        assert {i: sorted(p) for i, p in got.items()} == {i: sorted(problems_by_hand(x, schema)) for i, x in enumerate(VALUES)}, schema


def test_numbers_without_end_are_of_no_type(spark):
    assert problems(spark, ["1e400"], {"type": ["number", "integer"]}) == {0: ["$: expected number or integer, got number"]}
    assert problems(spark, ["1"], {"minimum": 2.0, "const": [1.5, "é"]}) == {0: ['$: must equal [1.5,"é"]', "$: must be >= 2"]}
    assert problems(spark, ["1e400", "1e40"], {"maximum": 9}) == {0: ["$: must be <= 9"], 1: ["$: must be <= 9"]}


def test_patterns_are_those_of_javascript(spark):
    texts = ["[", "&", "a", "\u2028", "\u0085", "\ufeff", "\n"]
    for pattern, fit in (("^[[&]$", "[&"), ("^[]$", ""), ("^[^]$", "".join(texts)), ("^.$", "[&a\u0085\ufeff"), (r"^\s$", "\u2028\ufeff\n"), (r"^[\S]$", "[&a\u0085"), (r"^[^\S]$", "\u2028\ufeff\n"), (r"^[a\]$[]$", "[a"), (r"^\[$", "[")):
        got = problems(spark, map(json.dumps, texts), {"pattern": pattern})
        assert "".join(t for i, t in enumerate(texts) if not got[i]) == fit, pattern


def test_configuration_values_under_any_name_are_checked(spark, tmp_path):
    """A schema of additional properties goes to every key without one of its own, at any depth of a file."""
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "caps": {"type": "object", "additionalProperties": {"type": "integer", "minimum": 0}}}, "additionalProperties": {"type": "string"}}
    texts = ['{"id": 1, "caps": {"a": 1, "b": -1, "c.d": "x"}, "more": "x"}', '{"id": 1, "more": {"deep": 1}, "caps": {"id": 1}}', '{"id": "x", "caps": {}}']
    path = str(tmp_path)
    readers.write_files(spark.createDataFrame(list(enumerate(texts)), "file int, value string"), f"{path}/config")
    read = readers.read_config(spark, f"{path}/config", schema)
    got = {int(r.name): sorted(r.problems) for r in read.select(readers.file_name("file").alias("name"), "problems").collect()}
    assert got == {0: ["$.caps.b: must be >= 0", "$.caps.c.d: expected integer, got string"], 1: ["$.more: expected string, got object"], 2: ["$.id: expected integer, got string"]}
