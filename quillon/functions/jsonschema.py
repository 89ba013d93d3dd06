"""Strict JSON Schemas from Spark types, and schemas made strict: closed objects, everything required, no references."""

from __future__ import annotations

from typing import Any

from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, MapType, StructType

#: Keywords that strict generation doesn't support.
UNSUPPORTED = frozenset("minItems maxItems minLength maxLength pattern format minimum maximum exclusiveMinimum exclusiveMaximum multipleOf default examples uniqueItems".split())
MAX_DEPTH = 12


def of_type(kind: DataType, allowed: dict[str, tuple[str, ...]] | None = None, at: str = "") -> dict[str, Any]:
    """The JSON Schema of a Spark type. allowed: closed vocabularies by dotted path."""
    allowed = allowed or {}
    if isinstance(kind, StructType):
        own = {f.name: of_type(f.dataType, allowed, f"{at}.{f.name}".lstrip(".")) for f in kind.fields}
        return {"type": "object", "properties": own, "required": list(own), "additionalProperties": False}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": of_type(kind.elementType, allowed, at)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": of_type(kind.valueType, allowed, at)}
    if at in allowed:
        return {"type": "string", "enum": list(allowed[at])}
    name = "boolean" if isinstance(kind, BooleanType) else "integer" if isinstance(kind, IntegralType) else "number" if isinstance(kind, FractionalType) else "string"
    return {"type": name}


def strict(schema: dict[str, Any], exclude: frozenset[str] = frozenset()) -> dict[str, Any]:
    """A schema without references and unsupported keywords, its objects closed and complete; ``exclude``: top-level properties to leave out."""
    definitions = schema.get("$defs", {})

    def walk(node: Any, depth: int, names: bool = False) -> Any:
        if depth > MAX_DEPTH:
            raise ValueError("the schema's references nest too deep")
        if isinstance(node, list):
            return [walk(x, depth) for x in node]
        if not isinstance(node, dict):
            return node
        if names:  # property names are no keywords
            return {k: walk(v, depth) for k, v in node.items()}
        if ref := node.get("$ref"):
            if (name := ref.rpartition("/")[2]) not in definitions:
                raise ValueError(f"unknown reference {ref}")
            return walk(definitions[name] | {k: v for k, v in node.items() if k != "$ref"}, depth + 1)
        out = {k: walk(v, depth, k == "properties") for k, v in node.items() if k not in UNSUPPORTED and k != "$defs"}
        if out.get("type") == "object" or "properties" in out:
            out["additionalProperties"] = False
            out["required"] = list(out.get("properties", {}))
        return out

    top = dict(schema)
    if exclude and "properties" in top:
        top["properties"] = {k: v for k, v in top["properties"].items() if k not in exclude}
    return walk(top, 0)


def outline(schema: dict[str, Any], depth: int = 0) -> str:
    """A short field list of a strict schema, for prompts."""
    lines = []
    for name, node in schema.get("properties", {}).items():
        items = node.get("items", {})
        kind = " | ".join(map(str, node["enum"])) if "enum" in node else f"list of {items.get('title') or items.get('type', 'object')}" if node.get("type") == "array" else node.get("type", "object")
        note = f": {node['description']}" if node.get("description") else ""
        lines.append(f"{'  ' * depth}- {name} ({kind}){note}")
        inner = items if items.get("properties") else node
        if inner.get("properties") and depth < 3:
            lines.append(outline(inner, depth + 1))
    return "\n".join(lines)
