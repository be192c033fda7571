"""Ontology files and display overlays, by their text."""

from __future__ import annotations

import json
from collections.abc import Iterable

# What display hints may say.
SHAPES = ("circle", "diamond", "square", "triangle", "hexagon")
BORDERS = ("solid", "dashed")
PULSES = ("lastUpdatedWithin:60s", "lastUpdatedWithin:5m", "recentlyMerged:1h")
_ALLOWED = {"color": None, "icon": None, "shape": SHAPES, "borderStyle": BORDERS, "pulseRule": PULSES}


def read_ontology(text: str) -> tuple[str, dict]:
    """(source name, classes) of an ontology file's text; meta, its name and classes are required."""
    data = json.loads(text)
    if not isinstance(data, dict) or not isinstance(data.get("meta"), dict) or not data["meta"].get("name") or "classes" not in data:
        raise ValueError("an ontology needs meta, meta.name and classes")
    return data["meta"]["name"], data["classes"]


def ontology_order(names: Iterable[str]) -> list[str]:
    """Load order of ontology files: upper.json, then by name; display overlays are no ontologies."""
    return sorted((n for n in names if n.endswith(".json") and not n.endswith(".display.json")), key=lambda n: (n != "upper.json", n))


def parse_hint(hint: object) -> dict[str, str]:
    """A display hint; ValueError for what is none. Unknown fields are left out, a null pulse rule is none."""
    if not isinstance(hint, dict):
        raise ValueError("a hint is an object")
    out = {}
    for name, allowed in _ALLOWED.items():
        value = hint.get(name)
        if name not in hint or name == "pulseRule" and value is None:
            continue
        if not isinstance(value, str) or allowed and value not in allowed:
            raise ValueError(f"{name} may not be {value!r}")
        out[name] = value
    return out


def display_hints(text: str | None, strict: bool = False) -> dict[str, dict[str, str]]:
    """Class -> hint of an overlay file. A missing or malformed one has none; a hint that says what it may not is
    left out, or refused."""
    try:
        data = json.loads(text or "{}")
    except ValueError:
        if strict:
            raise
        return {}
    out = {}
    for name, hint in data.items() if isinstance(data, dict) else ():
        try:
            out[name] = parse_hint(hint)
        except ValueError:
            if strict:
                raise
    return out
