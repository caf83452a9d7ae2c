"""Parameters as text, as forms and command lines give them."""

from __future__ import annotations


def coerced(text: str) -> list[int] | int | float | str | None:
    """None for blank text, whole numbers between commas as a list, else a whole number, a number, or the text."""
    text = text.strip()
    if not text:
        return None
    if "," in text:
        try:
            return [int(x) for x in text.split(",") if x.strip()]
        except ValueError:
            return text
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def checked(values: dict, schema: dict) -> dict:
    """values with the defaults of a parameter schema; ValueError for names that it lacks and values of another type."""
    properties = schema["properties"]
    if unknown := sorted(set(values) - set(properties)):
        raise ValueError(f"Unknown parameter: {unknown[0]!r}")
    kinds = {"integer": int, "number": (int, float), "boolean": bool, "string": str, "array": list}
    out = {}
    for name, p in properties.items():
        out[name] = values.get(name, p.get("default"))
        kind = kinds.get(p["type"])
        if kind and out[name] is not None and (not isinstance(out[name], kind) or kind is not bool and isinstance(out[name], bool)):
            raise ValueError(f"{name} must be of type {p['type']}, not {out[name]!r}")
    return out
