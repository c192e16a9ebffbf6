"""JSON values and JSON schemas: canonical text, and whether a value meets a schema.  Nothing that a text can hold makes them fail."""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import regex

from .patterns import Unable, occurs

#: Levels to which a JSON text may nest; deeper ones are no JSON here.
DEEPEST = 128
#: Seconds that one pattern may search one string by backtracking; one that takes longer is searched without (``patterns``).
PATIENCE = 2.0
_LONE = re.compile("[\ud800-\udfff]")


def loads(text: str):
    """(value, True), or (None, False) for what is no JSON, or nests deeper than DEEPEST."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None, False
    level, depth = [value], 0
    while level := [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
        if depth > DEEPEST:
            return None, False
    return value, True


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, integers for whole numbers, no escapes but those needed; NaN and infinities are null."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if not math.isfinite(x):
                return None
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    text = json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)  # half a surrogate pair cannot be written otherwise


def label(x: str | int) -> str:
    """An identifier or a name as a column's text."""
    x = str(x)
    return canonical(x) if _LONE.search(x) else x


class Malformed(Exception):
    """The schema has a keyword whose value is of no use."""


class Undecided(Exception):
    """It is not known whether a pattern occurs in a string."""


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


TYPES = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": _number,
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict),
}

_finite = lambda x: isinstance(x, int) or math.isfinite(x)
_is_schema = lambda x: isinstance(x, (dict, bool))
_is_list = lambda x: isinstance(x, list) and len(x) > 0 and all(map(_is_schema, x))
_is_table = lambda x: isinstance(x, dict) and all(map(_is_schema, x.values()))
_is_names = lambda x: isinstance(x, list) and all(isinstance(y, str) for y in x)
_is_size = lambda x: TYPES["integer"](x) and x >= 0
#: What the value of a keyword must be.
KEYWORDS = {
    "type": lambda x: isinstance(x, str) and x in TYPES or isinstance(x, list) and all(isinstance(y, str) and y in TYPES for y in x),
    "enum": lambda x: isinstance(x, list),
    "required": _is_names,
    "dependentRequired": lambda x: isinstance(x, dict) and all(map(_is_names, x.values())),
    **dict.fromkeys(("minItems", "maxItems", "minLength", "maxLength", "minProperties", "maxProperties", "minContains", "maxContains"), _is_size),
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), _number),
    "multipleOf": lambda x: _number(x) and _finite(x) and x > 0,
    "uniqueItems": lambda x: isinstance(x, bool),
    "pattern": lambda x: isinstance(x, str),
    "$ref": lambda x: isinstance(x, str),
    **dict.fromkeys(("allOf", "anyOf", "oneOf", "prefixItems"), _is_list),
    **dict.fromkeys(("not", "if", "then", "else", "items", "contains", "propertyNames", "additionalProperties"), _is_schema),
    **dict.fromkeys(("properties", "patternProperties", "dependentSchemas", "$defs", "definitions"), _is_table),
}


def _found(pattern: str, text: str) -> bool:
    try:
        return regex.search(pattern, text, timeout=PATIENCE) is not None
    except TimeoutError:
        pass
    except (regex.error, OverflowError, RecursionError) as e:
        raise Malformed(pattern) from e
    try:
        return occurs(pattern, text)
    except (Unable, RecursionError) as e:
        raise Undecided(pattern) from e


class Check:
    """One value against one schema.  Each pair of a value and a part of the schema is looked at once, so no schema takes more than their product.

    A part that hangs on others yields them as (value, schema) and is sent whether they are met, so no nesting is too deep."""

    def __init__(self, root):
        self.root, self.known = root, {}

    def pointed(self, ref: str):
        """The part of the schema that a reference inside it names."""
        if ref[:1] != "#" or ref[1:2] not in ("", "/"):
            raise Malformed(ref)
        at = self.root
        for step in ref[2:].split("/") if len(ref) > 1 else []:
            step = step.replace("~1", "/").replace("~0", "~")
            if isinstance(at, list) and step.isascii() and step.isdigit() and int(step) < len(at):
                at = at[int(step)]
            elif isinstance(at, dict) and step in at:
                at = at[step]
            else:
                raise Malformed(ref)
        return at

    def meets(self, value, schema) -> bool:
        todo, met = [self._looked_at(value, schema)], None
        while todo:
            try:
                part = todo[-1].send(met)
            except StopIteration as e:
                todo.pop()
                met = e.value
            else:
                todo.append(self._looked_at(*part))
                met = None
        return met

    def _looked_at(self, value, schema):
        if isinstance(schema, bool):
            return schema
        if not isinstance(schema, dict):
            raise Malformed("not a schema")
        key = (id(value), id(schema))
        if key not in self.known:
            for k in KEYWORDS.keys() & schema.keys():
                if not KEYWORDS[k](schema[k]):
                    raise Malformed(k)
            self.known[key] = None
            self.known[key] = yield from self._meets(value, schema)
        if self.known[key] is None:  # a reference that leads back to itself
            raise Malformed("endless reference")
        return self.known[key]

    def _meets(self, v, s: dict):
        if "$ref" in s and not (yield v, self.pointed(s["$ref"])):
            return False
        if "type" in s and not any(TYPES[t](v) for t in ([s["type"]] if isinstance(s["type"], str) else s["type"])):
            return False
        if "enum" in s and canonical(v) not in {canonical(x) for x in s["enum"]} or "const" in s and canonical(v) != canonical(s["const"]):
            return False
        if isinstance(v, dict) and not (yield from self.object(v, s)) or isinstance(v, list) and not (yield from self.array(v, s)):
            return False
        if isinstance(v, str) and not self.text(v, s) or _number(v) and not self.number(v, s):
            return False
        if not (yield from self.all((v, x) for x in s.get("allOf", []))):
            return False
        if "anyOf" in s:
            for x in s["anyOf"]:
                if (yield v, x):
                    break
            else:
                return False
        if "oneOf" in s and (yield from self.count((v, x) for x in s["oneOf"])) != 1 or "not" in s and (yield v, s["not"]):
            return False
        return "if" not in s or (yield v, s.get("then" if (yield v, s["if"]) else "else", True))

    def all(self, parts):
        for part in parts:
            if not (yield part):
                return False
        return True

    def count(self, parts):
        n = 0
        for part in parts:
            n += yield part
        return n

    def object(self, v: dict, s: dict):
        if any(k not in v for k in s.get("required", [])) or not s.get("minProperties", 0) <= len(v) <= s.get("maxProperties", math.inf):
            return False
        for k, need in s.get("dependentRequired", {}).items():
            if k in v and any(n not in v for n in need):
                return False
        if not (yield from self.all((v, x) for k, x in s.get("dependentSchemas", {}).items() if k in v)):
            return False
        props, patterns = s.get("properties", {}), s.get("patternProperties", {})
        for k, x in v.items():
            rules = [props[k]] if k in props else []
            rules += [r for p, r in patterns.items() if _found(p, k)]
            if not (yield from self.all((x, r) for r in rules or [s.get("additionalProperties", True)])) or "propertyNames" in s and not Check(self.root).meets(k, s["propertyNames"]):
                return False
        return True

    def array(self, v: list, s: dict):
        if not s.get("minItems", 0) <= len(v) <= s.get("maxItems", math.inf):
            return False
        first = s.get("prefixItems", [])
        if not (yield from self.all(zip(v, first))) or not (yield from self.all((x, s.get("items", True)) for x in v[len(first) :])):
            return False
        if s.get("uniqueItems") and len({canonical(x) for x in v}) < len(v):
            return False
        return "contains" not in s or s.get("minContains", 1) <= (yield from self.count((x, s["contains"]) for x in v)) <= s.get("maxContains", math.inf)

    def text(self, v: str, s: dict) -> bool:
        return s.get("minLength", 0) <= len(v) <= s.get("maxLength", math.inf) and ("pattern" not in s or _found(s["pattern"], v))

    def number(self, v: float, s: dict) -> bool:
        if "minimum" in s and not v >= s["minimum"] or "maximum" in s and not v <= s["maximum"]:
            return False
        if "exclusiveMinimum" in s and not v > s["exclusiveMinimum"] or "exclusiveMaximum" in s and not v < s["exclusiveMaximum"]:
            return False
        return "multipleOf" not in s or _finite(v) and Fraction(str(v)) % Fraction(str(s["multipleOf"])) == 0


def verdict(value, schema) -> bool | None:
    """Whether a value meets a JSON schema: the validating keywords of draft 2020-12 and references inside the schema; formats and annotations say nothing.

    None where that cannot be said: a keyword of a wrong kind, an unusable pattern, a reference out of the schema or round in a circle, or a pattern with
    back references (or others that ``patterns`` is unable to follow) that takes longer than PATIENCE; each where the value gets as far as that part.
    """
    try:
        return Check(schema).meets(value, schema)
    except (Malformed, Undecided, RecursionError):
        return None


def valid(value, schema) -> bool:
    """Whether a value is known to meet a JSON schema; a schema without a verdict is met by nothing."""
    return verdict(value, schema) is True
