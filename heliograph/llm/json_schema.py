"""JSON values: parsing with defined limits, canonical text, and validation against a schema.

Values are walked with stacks, so that no depth and no size of number ends a task. Supported are the keywords in
``_CHECKS`` and boolean schemas; ``_NOTES`` don't validate. A schema with any other keyword, a keyword of a wrong type, a
pattern that is none, a reference to elsewhere, or a circle of alternatives is unsupported and says why: it is never
passed over in silence.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from json.encoder import encode_basestring as _quoted

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Digits from which an integer is kept as a decimal: Python doesn't write longer ones.
LONG_DIGITS = 4_000


class Unsupported(ValueError):
    """A schema that can't be decided; its text says why."""


def _finite(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise ValueError(number)
    return value


def _integer(digits: str) -> int | Decimal:
    return int(digits) if len(digits) < LONG_DIGITS else Decimal(digits)


def _unrepeated(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def parse(text: str | None):
    """The value of a JSON text; ValueError if it is null, no JSON, repeats a key, or holds a number beyond any float."""
    return json.loads(text if text is not None else "", parse_constant=_finite, parse_float=_finite, parse_int=_integer, object_pairs_hook=_unrepeated)


def _number(value: int | float | Decimal) -> str:
    """One form for equal numbers: whole ones as integers up to 1e21, beyond that as floats where exact."""
    if isinstance(value, float) and value == int(value) and abs(value) < 1e21:
        value = int(value)
    elif isinstance(value, int) and 10**21 <= abs(value) < 10**300 and int(float(value)) == value:
        value = float(value)
    return repr(value) if isinstance(value, float) else str(value)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and no escapes beyond need."""
    out, waiting = [], [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, _Text):
            out.append(x)
        elif isinstance(x, dict):
            waiting.append(_Text("}"))
            for i, k in enumerate(sorted(x, reverse=True)):
                waiting += [x[k], _Text(("" if i == len(x) - 1 else ",") + _quoted(k) + ":")]
            out.append("{")
        elif isinstance(x, list):
            waiting.append(_Text("]"))
            for i in range(len(x) - 1, -1, -1):
                waiting += [x[i], _Text("," if i else "")]
            out.append("[")
        elif isinstance(x, str):
            out.append(_quoted(x))
        elif x is None or isinstance(x, bool):
            out.append({None: "null", True: "true", False: "false"}[x])
        elif isinstance(x, float) and not math.isfinite(x):
            raise ValueError("not a JSON number")
        else:
            out.append(_number(x))
    return "".join(out)


class _Text(str):
    """Text of :func:`canonical` that stands for itself."""


def _numeric(value) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return _numeric(value) and (kind == "number" or not isinstance(value, float) or value == int(value))
    return isinstance(value, _KINDS[kind])


def _fraction(value: int | float | Decimal) -> Fraction:
    return Fraction(repr(value)) if isinstance(value, float) else Fraction(value)


@functools.lru_cache(maxsize=1000)
def _pattern(text: str) -> re.Pattern:
    try:
        return re.compile(text)
    except (re.error, OverflowError, RecursionError) as e:
        raise Unsupported(f"bad pattern {text[:40]}") from e


def _is_schema(x) -> bool:
    return isinstance(x, (dict, bool))


def _count(x) -> bool:
    return _numeric(x) and x >= 0 and x == int(x)


def _names(x) -> bool:
    return isinstance(x, list) and all(isinstance(v, str) for v in x)


def _schemas(x) -> bool:
    return isinstance(x, list) and bool(x) and all(map(_is_schema, x))


def _by_name(x) -> bool:
    return isinstance(x, dict) and all(map(_is_schema, x.values()))


def _kinds(x) -> bool:
    return all(isinstance(k, str) and (k in _KINDS or k in ("number", "integer")) for k in (x if isinstance(x, list) and x else [x]))


#: Keywords that validate, each with what its value has to be, and keywords that only describe.
_CHECKS = {
    "type": _kinds, "enum": lambda x: isinstance(x, list), "const": lambda x: True, "minLength": _count, "maxLength": _count, "pattern": lambda x: isinstance(x, str), "minimum": _numeric, "maximum": _numeric,
    "exclusiveMinimum": _numeric, "exclusiveMaximum": _numeric, "multipleOf": lambda x: _numeric(x) and x > 0, "items": _is_schema, "prefixItems": _schemas, "contains": _is_schema, "minItems": _count, "maxItems": _count, "uniqueItems": lambda x: isinstance(x, bool),
    "required": _names, "properties": _by_name, "patternProperties": _by_name, "additionalProperties": _is_schema, "propertyNames": _is_schema, "minProperties": _count, "maxProperties": _count, "dependentRequired": lambda x: isinstance(x, dict) and all(map(_names, x.values())),
    "allOf": _schemas, "anyOf": _schemas, "oneOf": _schemas, "not": _is_schema, "if": _is_schema, "then": _is_schema, "else": _is_schema, "$ref": lambda x: isinstance(x, str) and (x == "#" or x.startswith("#/")), "$defs": _by_name, "definitions": _by_name,
}
_NOTES = {"title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}
_INNER_ONE, _INNER_LIST, _INNER_NAMED = ("items", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else"), ("prefixItems", "allOf", "anyOf", "oneOf"), ("properties", "patternProperties", "$defs", "definitions")


def _referred(root, pointer: str):
    at = root
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(name)] if isinstance(at, list) else at[name]
        except (KeyError, IndexError, ValueError, TypeError) as e:
            raise Unsupported(f"no {pointer[:80]}") from e
    if not _is_schema(at):
        raise Unsupported(f"no schema at {pointer[:80]}")
    return at


@functools.lru_cache(maxsize=1000)
def load_schema(text: str):
    """A schema from its text, every part looked at once; Unsupported if any part can't be decided."""
    try:
        root = parse(text)
    except (ValueError, RecursionError) as e:
        raise Unsupported("not JSON") from e
    waiting, seen = [root], set()
    while waiting:
        schema = waiting.pop()
        if isinstance(schema, bool) or id(schema) in seen:
            continue
        if not isinstance(schema, dict):
            raise Unsupported("neither an object nor a boolean")
        seen.add(id(schema))
        for word, x in schema.items():
            if word in _NOTES:
                continue
            if word not in _CHECKS:
                raise Unsupported(f"keyword {word[:40]}")
            if not _CHECKS[word](x):
                raise Unsupported(f"bad {word}")
            if word == "pattern":
                _pattern(x)
            elif word == "patternProperties":
                for p in x:
                    _pattern(p)
            elif word == "$ref":
                waiting.append(_referred(root, x))
            if word in _INNER_ONE:
                waiting.append(x)
            elif word in _INNER_LIST:
                waiting += x
            elif word in _INNER_NAMED:
                waiting += x.values()
    return root


def violation(value, schema, root=None, at: str = "$") -> str | None:
    """First violation of a loaded schema, or None: a value's own keywords first, then what must hold for its parts in order."""
    root = schema if root is None else root
    waiting, seen = [(value, schema, at)], set()
    while waiting:
        value, schema, at = waiting.pop()
        if schema is True or (id(value), id(schema)) in seen:
            continue  # all must hold, so once is enough
        if schema is False:
            return f"{at}: not allowed"
        seen.add((id(value), id(schema)))
        if found := _own_violation(value, schema, at) or _alternatives(value, schema, root, at):
            return found
        waiting += reversed(list(_parts(value, schema, root, at)))
    return None


def _own_violation(value, schema: dict, at: str) -> str | None:
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds if isinstance(kinds, str) else '/'.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not in enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not the constant"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            return f"{at}: bad length"
        if "pattern" in schema and not _pattern(schema["pattern"]).search(value):
            return f"{at}: no match of pattern"
    if _numeric(value):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            return f"{at}: out of range"
        if ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]) or ("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]):
            return f"{at}: out of range"
        if "multipleOf" in schema and (_fraction(value) / _fraction(schema["multipleOf"])).denominator != 1:
            return f"{at}: not a multiple"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            return f"{at}: bad number of items"
        if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value):
            return f"{at}: repeated items"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}: {name} is missing"
        for name, others in schema.get("dependentRequired", {}).items():
            if name in value and (gone := [o for o in others if o not in value]):
                return f"{at}: {gone[0]} is missing"
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf):
            return f"{at}: bad number of properties"
    return None


def _alternatives(value, schema: dict, root, at: str) -> str | None:
    """Keywords that ask whether a part of the schema holds, whatever the answer."""
    holds = lambda s: violation(value, s, root, at) is None
    if "anyOf" in schema and not any(map(holds, schema["anyOf"])):
        return f"{at}: none of anyOf"
    if "oneOf" in schema and sum(map(holds, schema["oneOf"])) != 1:
        return f"{at}: not one of oneOf"
    if "not" in schema and holds(schema["not"]):
        return f"{at}: not allowed by not"
    if "if" in schema and (branch := "then" if holds(schema["if"]) else "else") in schema and (found := violation(value, schema[branch], root, at)):
        return found
    if "contains" in schema and isinstance(value, list) and not any(violation(x, schema["contains"], root) is None for x in value):
        return f"{at}: no item as in contains"
    return None


def _parts(value, schema: dict, root, at: str) -> Iterator[tuple]:
    """(value, schema, place) of all that must hold besides."""
    if "$ref" in schema:
        yield value, _referred(root, schema["$ref"]), at
    for part in schema.get("allOf", ()):
        yield value, part, at
    if isinstance(value, list):
        first = schema.get("prefixItems", [])
        for i, x in enumerate(value):
            if i < len(first):
                yield x, first[i], f"{at}[{i}]"
            elif "items" in schema:
                yield x, schema["items"], f"{at}[{i}]"
    if isinstance(value, dict):
        own, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for name in sorted(value):
            if "propertyNames" in schema:
                yield name, schema["propertyNames"], f"{at}.{name}"
            fits = [s for p, s in patterns.items() if _pattern(p).search(name)]
            for s in ([own[name]] if name in own else []) + fits:
                yield value[name], s, f"{at}.{name}"
            if name not in own and not fits and "additionalProperties" in schema:
                yield value[name], schema["additionalProperties"], f"{at}.{name}"
