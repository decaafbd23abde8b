"""s14: project files and typed options."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field


@dataclass
class Project:
    options: dict[str, object] = field(default_factory=dict)
    queries: dict[str, str] = field(default_factory=dict)


def typed(text: str) -> object:
    """Booleans, numbers, tuples of numbers, tolerances ("5 ppm"), or the text."""
    t = text.strip()
    low = t.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", ""):
        return None
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    if t.startswith("(") and t.endswith(")"):
        return tuple(typed(x) for x in t[1:-1].split(","))
    parts = t.split()
    if len(parts) == 2 and parts[1].lower() in ("ppm", "da", "res"):
        try:
            return (float(parts[0]), parts[1].lower())
        except ValueError:
            pass
    return t


def load(text: str) -> Project:
    """An INI file with a [project] and an [mfql] section; query bodies are paths or texts keyed by name."""
    c = configparser.RawConfigParser(strict=False, allow_no_value=True)
    c.optionxform = str
    c.read_string(text)
    p = Project()
    if c.has_section("project"):
        p.options = {k: typed(v or "") for k, v in c.items("project")}
    if c.has_section("mfql"):
        p.queries = {k: v or "" for k, v in c.items("mfql")}
    # An automatic resolution asks for the alignment that learns its window.
    if str(p.options.get("MSresolution", "")).lower() == "auto":
        for k in ("alignmentMethodMS", "alignmentMethodMSMS", "scanAveragingMethod"):
            p.options[k] = "calctol"
    return p
