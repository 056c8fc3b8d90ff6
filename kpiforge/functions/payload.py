"""JSON payloads of any shape: canonical text, removal of a path, conformance to a contract.

Objects are read as VARIANT or as maps of VARIANT, so no schema is fixed and values keep their types.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(payload: Column) -> Column:
    """The same JSON with the keys of every object in code-point order and no white space; null for what is no JSON."""
    return F.to_json(F.try_parse_json(payload))


def is_object(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def remove_path(payload: Column, path: Sequence[str]) -> Column:
    """The payload without the value at ``path`` (keys from the root down), in canonical form.

    What is not there is not removed: a missing key, or a value on the way that is no object, leaves the
    payload as it is.
    """
    head, *rest = path
    members = F.from_json(payload, "map<string,variant>")
    if rest:
        inner = lambda v: F.to_json(v)
        edited = F.transform_values(
            members, lambda k, v: F.when((k == head) & is_object(inner(v)), F.parse_json(remove_path(inner(v), rest))).otherwise(v)
        )
    else:
        edited = F.map_filter(members, lambda k, v: k != head)
    return F.when(is_object(payload), canonical(F.to_json(edited))).otherwise(canonical(payload))


@dataclass(frozen=True)
class Member:
    """What a contract says about the value at a path below an object.

    ``types``: JSON types that it may have; ``values``: the only texts allowed (null is allowed if 'null' is a type);
    ``pattern``: for texts; ``least``: characters of a text.
    """

    types: tuple[str, ...]
    required: bool = False
    values: tuple[str, ...] = ()
    pattern: str | None = None
    least: int = 0


@dataclass(frozen=True)
class Shape:
    """An object: its members, and whether others are allowed."""

    members: dict[str, Member]
    closed: bool = True


#: Names of VARIANT types (their first word) by JSON type.
_KINDS = {
    "string": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "INT", "SMALLINT", "TINYINT", "FLOAT"),
    "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",),
}


def _kind(value: Column) -> Column:
    """The first word of the type of a value, null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def violations(payload: Column, shape: Shape, path: str = "") -> Column:
    """Array of 'path: rule' for one object given as JSON text: missing, unknown, type, value, pattern, length."""
    prefix = f"{path}." if path else ""
    keys = F.coalesce(F.json_object_keys(payload), F.array())
    root = F.try_parse_json(payload)
    found = []
    if shape.closed:
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in shape.members]))
        found.append(F.transform(extra, lambda k: F.concat(F.lit(prefix), k, F.lit(": unknown"))))
    for key, m in shape.members.items():
        name, there = f"{prefix}{key}", F.array_contains(keys, key)
        value = F.try_variant_get(root, f"$.{key}", "variant")
        text = F.try_variant_get(root, f"$.{key}", "string")
        kinds = [k for t in m.types for k in _KINDS[t]]
        rules = [F.when(F.lit(m.required) & ~there, F.lit(f"{name}: missing"))]
        rules.append(F.when(there & ~_kind(value).isin(kinds), F.lit(f"{name}: type")))
        is_text = there & (_kind(value) == "STRING")
        if m.values:
            rules.append(F.when(is_text & ~text.isin(list(m.values)), F.lit(f"{name}: value")))
        if m.pattern:
            rules.append(F.when(is_text & ~text.rlike(m.pattern), F.lit(f"{name}: pattern")))
        if m.least:
            rules.append(F.when(is_text & (F.length(text) < m.least), F.lit(f"{name}: length")))
        found.append(F.array_compact(F.array(*rules)))
    return F.flatten(F.array(*found))
