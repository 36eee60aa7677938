"""Schemas and canonical JSON: hostile values, unsupported schemas, and a fuzz against a plain recursive version."""

from __future__ import annotations

import json
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.llm import tool_calls
from heliograph.llm.json_schema import Unsupported, canonical, load_schema, parse, violation
from test_text_operators import MESSAGES


def plain_text(v):
    if isinstance(v, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + plain_text(v[k]) for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain_text, v)) + "]"
    if isinstance(v, float) and v == int(v) and abs(v) < 1e21:
        v = int(v)
    return json.dumps(v, ensure_ascii=False)


def plain_holds(v, s):
    """Whether a value meets a schema, by the text of each keyword's rule."""
    if isinstance(s, bool):
        return s
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == math.floor(v)}
    same = lambda a, b: plain_text(a) == plain_text(b)
    rules = {
        "type": lambda x: any(kinds[k] for k in ([x] if isinstance(x, str) else x)), "enum": lambda x: any(same(v, e) for e in x), "const": lambda x: same(v, x),
        "minLength": lambda x: not kinds["string"] or len(v) >= x, "pattern": lambda x: not kinds["string"] or bool(re.search(x, v)), "minimum": lambda x: not number or v >= x, "exclusiveMaximum": lambda x: not number or v < x,
        "multipleOf": lambda x: not number or (v * 4) % (x * 4) == 0, "items": lambda x: not kinds["array"] or all(plain_holds(e, x) for e in v[len(s.get("prefixItems", [])):]), "prefixItems": lambda x: not kinds["array"] or all(plain_holds(e, y) for e, y in zip(v, x)),
        "maxItems": lambda x: not kinds["array"] or len(v) <= x, "uniqueItems": lambda x: not kinds["array"] or not x or len(set(map(plain_text, v))) == len(v), "contains": lambda x: not kinds["array"] or any(plain_holds(e, x) for e in v),
        "required": lambda x: not kinds["object"] or all(k in v for k in x), "properties": lambda x: not kinds["object"] or all(plain_holds(v[k], y) for k, y in x.items() if k in v),
        "additionalProperties": lambda x: not kinds["object"] or all(plain_holds(e, x) for k, e in v.items() if k not in s.get("properties", {})), "minProperties": lambda x: not kinds["object"] or len(v) >= x,
        "allOf": lambda x: all(plain_holds(v, y) for y in x), "anyOf": lambda x: any(plain_holds(v, y) for y in x), "oneOf": lambda x: [plain_holds(v, y) for y in x].count(True) == 1, "not": lambda x: not plain_holds(v, x),
    }
    return all(rules[k](x) for k, x in s.items())


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from([0.5, 1.0, -2.25]) | st.sampled_from(["", "a", "ab", "é"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=6)
KINDS = st.sampled_from(["object", "array", "string", "boolean", "null", "number", "integer"])


def some_keywords(inner):
    several, named = st.lists(inner, min_size=1, max_size=2), st.dictionaries(st.sampled_from("abc"), inner, max_size=2)
    return st.fixed_dictionaries({}, optional={
        "type": KINDS | st.lists(KINDS, min_size=1, max_size=2), "enum": st.lists(VALUES, max_size=2), "const": VALUES, "minLength": st.integers(0, 2), "pattern": st.sampled_from(["^a", "b$"]), "minimum": st.integers(-2, 2), "exclusiveMaximum": st.integers(-2, 2),
        "multipleOf": st.sampled_from([1, 2, 0.5]), "items": inner, "prefixItems": several, "maxItems": st.integers(0, 2), "uniqueItems": st.booleans(), "contains": inner, "required": st.lists(st.sampled_from("abc"), max_size=2), "properties": named,
        "additionalProperties": inner, "minProperties": st.integers(0, 2), "allOf": several, "anyOf": several, "oneOf": several, "not": inner,
    })


SCHEMAS = st.recursive(st.booleans() | st.builds(dict), some_keywords, max_leaves=5)


@settings(max_examples=600, deadline=None)
@given(VALUES, SCHEMAS)
def test_validation_equals_a_plain_version(value, schema):
    assert (violation(value, load_schema(json.dumps(schema))) is None) == plain_holds(value, schema)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_canonical_text_equals_a_plain_version(value):
    assert canonical(value) == plain_text(value) == canonical(parse(canonical(value)))


@pytest.mark.parametrize(("value", "schema", "found"), [
    ({"b": 1, "a": "x"}, {"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}, "$.a: not of type integer"), (3, {"exclusiveMinimum": 3}, "$: out of range"), (0.3, {"multipleOf": 0.1}, None), (0.35, {"multipleOf": 0.1}, "$: not a multiple"),
    ([1, 1.0], {"uniqueItems": True}, "$: repeated items"), ([[]], {"items": False}, "$[0]: not allowed"), ({"x1": "a"}, {"patternProperties": {"^x": {"type": "null"}}, "additionalProperties": False}, "$.x1: not of type null"), ({"y": 1}, {"patternProperties": {"^x": True}, "additionalProperties": False}, "$.y: not allowed"),
    ({"n": {"n": {"n": 1}}}, {"$ref": "#/$defs/t", "$defs": {"t": {"type": "object", "properties": {"n": {"$ref": "#/$defs/t"}}}}}, "$.n.n.n: not of type object"), ({"long": 1}, {"propertyNames": {"maxLength": 3}}, "$.long: bad length"), ({"a": 1}, {"dependentRequired": {"a": ["b"]}}, "$: b is missing"),
    (5, {"if": {"minimum": 3}, "then": {"maximum": 4}}, "$: out of range"), (2, {"if": {"minimum": 3}, "then": {"maximum": 1}, "else": True}, None), (10**400, {"type": "integer", "minimum": 0, "maximum": 1e308}, "$: out of range"), (10**400, {"type": "integer", "multipleOf": 10}, None),
    ("x", {"$ref": "#"}, None), ([{"a": 1}], {"contains": {"required": ["a"]}}, None),
])
def test_keywords(value, schema, found):
    assert violation(value, load_schema(json.dumps(schema))) == found


@pytest.mark.parametrize("text", ["not json", "[1]", "7", '"x"', "null", '{"type":"text"}', '{"type":[]}', '{"pattern":"("}', '{"pattern":7}', '{"properties":[1]}', '{"properties":{"a":[1]}}', '{"exclusiveMinimum":true}', '{"items":[{}]}', '{"unevaluatedItems":false}', '{"$ref":"http://x/y"}', '{"$ref":"#/$defs/gone"}', '{"minContains":2}', '{"anyOf":[]}', '{"minLength":-1}', '{"multipleOf":0}', '{"a":1,"a":1}', "[" * 100_000])
def test_unsupported_schemas_say_so(text):
    with pytest.raises(Unsupported):
        load_schema(text)


def test_hostile_calls_do_not_end_the_job(spark):
    """Huge numbers, deep values, and schemas that are none: a status for each, and canonical text where there is JSON."""
    deep, deeper = '{"a":' * 3_000 + "1" + "}" * 3_000, "[" * 200_000 + "]" * 200_000
    calls = {"huge": ("integer", '{"length":' + "9" * 400 + "}"), "longer": ("integer", '{"length":' + "9" * 6_000 + "}"), "deep": ("any", deep), "deepest": ("any", deeper), "tree": ("tree", deep), "none": ("text", "{}"), "list": ("list", "{}"), "no": ("never", "{}"), "part": ("part", '{"a":1}'), "re": ("pattern", '{"a":"x"}'), "circle": ("circle", "1"), "word": ("word", "[]"), "two": ("two", '{"a":3}')}
    schemas = {"integer": '{"properties":{"length":{"type":"integer","minimum":1}}}', "any": "{}", "tree": '{"properties":{"a":{"$ref":"#"}},"type":["object","integer"]}', "text": "not json", "list": "[]", "never": "false", "part": '{"properties":{"a":false}}', "pattern": '{"properties":{"a":{"pattern":"["}}}', "circle": '{"anyOf":[{"$ref":"#"}]}', "word": '{"unevaluatedItems":true}', "two": '{"properties":{"a":{"exclusiveMinimum":3}}}'}
    messages = spark.createDataFrame([(1, i, "", [(k, name, text, [])], None) for i, (k, (name, text)) in enumerate(calls.items())] + [(1, 99 + i, "r", [], k) for i, k in enumerate(calls)], MESSAGES)
    got = {r["call_id"]: r for r in tool_calls.link_calls(messages, spark.createDataFrame(list(schemas.items()), "name string, schema string")).collect()}
    assert {k: (r["status"], r["error"]) for k, r in got.items()} == {
        "huge": ("ok", None), "longer": ("ok", None), "deep": ("ok", None), "deepest": ("invalid", "nested too deep"), "tree": ("ok", None), "none": ("unsupported schema", "not JSON"), "list": ("unsupported schema", "neither an object nor a boolean"), "no": ("invalid", "$: not allowed"), "part": ("invalid", "$.a: not allowed"),
        "re": ("unsupported schema", "bad pattern ["), "circle": ("unsupported schema", "circle"), "word": ("unsupported schema", "keyword unevaluatedItems"), "two": ("invalid", "$.a: out of range"),
    }
    assert all(f'"arguments":{calls[k][1]}' in got[k]["json"] for k in calls if k != "deepest")
