"""Structured records from pages by declarative selector schemas.

A schema names a base selector and fields. Field types may be a list of steps.
Nothing in a schema is ever evaluated as code; a computed field runs only a
Python function that the caller put there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from corpusloom.functions.dom import Document, Element
from corpusloom.functions.js import pattern, trim

TYPES = ("text", "attribute", "html", "regex", "nested", "list", "nested_list", "computed")


def transform(value: Any, how: str | None) -> Any:
    change: Callable | None = {"lowercase": str.lower, "uppercase": str.upper, "strip": trim}.get(how or "")
    return change(value) if change and isinstance(value, str) else value


def source(e: Element, where: str | None) -> Element | None:
    """The element a field reads: itself, or for '+ selector' the next sibling that matches."""
    if not where or not where.strip().startswith("+"):
        return e
    wanted = where.strip()[1:].strip()
    kids = e.parent.elements if e.parent is not None else []
    after = [k for k in kids[kids.index(e) + 1 :]] if e in kids else []
    return next((k for k in after if k.matches(wanted)), None)


def step(value: Any, kind: str, field: dict) -> Any:
    if kind == "text":
        return trim(value.text) if isinstance(value, Element) else trim(value)
    if kind == "attribute":
        return value.get(field["attribute"]) if isinstance(value, Element) else None
    if kind == "html":
        return value.inner_html if isinstance(value, Element) else value
    if kind == "regex":
        text = trim(value.text) if isinstance(value, Element) else value
        if not field.get("pattern"):
            return text
        m = pattern(field["pattern"]).search(text or "")
        group = field.get("group", 1)
        try:
            return m[group] if m else None
        except IndexError:
            return None
    return None


def scalar(e: Element, field: dict) -> Any:
    at: Any = e.first(field["selector"]) if field.get("selector") else e
    if at is None:
        return field.get("default")
    kinds = field["type"] if isinstance(field["type"], list) else [field["type"]]
    for kind in kinds:
        at = step(at, kind, field)
        if at is None:
            break
    at = transform(at, field.get("transform"))
    return at if at is not None else field.get("default")


def value(e: Element, field: dict, item: dict | None = None) -> Any:
    try:
        kind = field["type"]
        if kind == "computed":
            run = field.get("function")
            return run(dict(item or {})) if callable(run) else field.get("default")
        at = source(e, field.get("source"))
        if at is None:
            return field.get("default")
        if kind == "nested":
            found = at.first(field["selector"]) if field.get("selector") else at
            return record(found, field.get("fields", [])) if found is not None else {}
        if kind in ("list", "nested_list"):
            found = at.select(field["selector"]) if field.get("selector") else [at]
            if kind == "nested_list":
                return [record(x, field.get("fields", [])) for x in found]
            rows = [{f["name"]: scalar(x, f) for f in field.get("fields", [])} for x in found]
            return [{k: v for k, v in r.items() if v is not None} for r in rows]
        return scalar(at, field)
    except Exception:  # one bad field must not lose the record
        return field.get("default")


def record(e: Element, fields: list[dict]) -> dict:
    out: dict[str, Any] = {}
    for f in fields:
        v = value(e, f, out)
        if v is not None:
            out[f["name"]] = v
    return out


def extract(doc: Document | Element, schema: dict) -> list[dict]:
    if not schema or not schema.get("baseSelector") or not isinstance(schema.get("fields"), list):
        raise ValueError("a schema needs baseSelector and fields")
    out = []
    for base in doc.select(schema["baseSelector"]):
        item = {f["name"]: v for f in schema.get("baseFields", []) if (v := scalar(base, f)) is not None}
        item |= record(base, schema["fields"])
        if item:
            out.append(item)
    return out


def problems(schema: Any) -> list[str]:
    """What is wrong with a schema; empty if nothing is."""
    if not isinstance(schema, dict):
        return ["schema must be an object"]
    out = []
    if not schema.get("baseSelector"):
        out.append("baseSelector is required")
    if not isinstance(schema.get("fields"), list) or not schema["fields"]:
        out.append("fields must be a non-empty array")

    def check(fields: Any, at: str) -> None:
        for i, f in enumerate(fields if isinstance(fields, list) else []):
            here = f"{at}[{i}]"
            if not f.get("name"):
                out.append(f"{here}: name is required")
            kinds = f.get("type") if isinstance(f.get("type"), list) else [f.get("type")]
            if not f.get("type"):
                out.append(f"{here}: type is required")
            elif any(k not in TYPES for k in kinds):
                out.append(f"{here}: unknown type {f['type']}")
            if "attribute" in kinds and not f.get("attribute"):
                out.append(f"{here}: attribute is required")
            if any(k in ("nested", "list", "nested_list") for k in kinds):
                if not isinstance(f.get("fields"), list):
                    out.append(f"{here}: fields array is required")
                else:
                    check(f["fields"], f"{here}.fields")
            if "computed" in kinds and f.get("expression") is not None:
                out.append(f"{here}: computed expressions are not evaluated")

    check(schema.get("fields"), "fields")
    check(schema.get("baseFields"), "baseFields")
    return out


def schema_from_text(text: str | None) -> dict | None:
    """A schema from JSON text; None for blank text, ValueError with all that is wrong otherwise."""
    if not (text or "").strip():
        return None
    try:
        schema = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"the schema is not JSON: {e}") from e
    wrong = problems(schema)
    if wrong:
        raise ValueError("; ".join(wrong))
    return schema
