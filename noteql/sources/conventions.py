"""Where metric logs are and how they are written: the plugin's settings, or else the workspace's, or else defaults.

The first of these that there is counts as a whole; what it leaves out is as the defaults have it.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

# The plugin's file, and the names that a setting may have in it, the first that has a fitting value.
PLUGIN = ("plugins", "metrics-lens", "data.json")
NAMES = {
    "root": ["metricsRoot", "metricsFolder", "metricsDir", "metrics.root", "storage.metricsRoot"],
    "extensions": ["extensions", "supportedExtensions", "metrics.extensions"],
    "write_file": ["defaultWriteFile", "defaultFile", "metrics.defaultWriteFile", "storage.defaultWriteFile"],
    "reference_prefix": ["recordReferencePrefix", "referencePrefix", "metrics.recordReferencePrefix"],
    "week_start": ["weekStartDay", "weekStart", "calendar.weekStartDay", "weekStartsOn", "calendar.weekStartsOn"],
    "day_start_hour": ["dayStartHour", "dayBoundaryHour", "calendar.dayStartHour"],
}
DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


@dataclass(frozen=True)
class Conventions:
    root: str
    extensions: tuple[str, ...]
    write_file: str
    reference_prefix: str = "metric:"
    week_start: str = "monday"
    day_start_hour: int = 0
    source: str = "default"


def _relative(value) -> str | None:
    """A path below the top; None for one that leads out of it, or to nothing."""
    if not isinstance(value, str):
        return None
    parts = [p for p in value.strip().replace("\\", "/").split("/") if p not in ("", ".")]
    return None if not parts or ".." in parts or value.strip().startswith("/") else "/".join(parts)


def _text(value) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else None


def _day(value) -> str | None:
    number = _whole(value)
    return _text(value) if number is None else DAYS[number] if number < len(DAYS) else None


def _suffixes(value) -> tuple[str, ...] | None:
    given = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    named = [x.strip().lower() for x in given if isinstance(x, str) and x.strip()]
    return tuple(dict.fromkeys(x if x.startswith(".") else f".{x}" for x in named)) or None


READ = {"root": _text, "extensions": _suffixes, "write_file": _text, "reference_prefix": _text, "week_start": _day, "day_start_hour": _whole}


def _at(data, path: str):
    for name in path.split("."):
        data = data.get(name) if isinstance(data, dict) else None
    return data


def _found(data: dict, names: dict[str, list[str]]) -> dict:
    out = {}
    for setting, paths in names.items():
        fitting = (v for p in paths if (v := READ[setting](_at(data, p))) is not None)
        out[setting] = next(fitting, None)
    return out


def made(values: dict, source: str, root: str, extension: str, write_name: str) -> Conventions:
    top = _relative(values.get("root")) or root
    hour = values.get("day_start_hour")
    return Conventions(
        top,
        values.get("extensions") or (extension,),
        _relative(values.get("write_file")) or f"{top}/{write_name}",
        values.get("reference_prefix") or Conventions.reference_prefix,
        (values.get("week_start") or Conventions.week_start).lower(),
        hour if hour is not None and hour <= 23 else Conventions.day_start_hour,
        source,
    )


def load(editor: str, own: dict, root: str, extension: str, write_name: str) -> Conventions:
    """From the editor's folder and the workspace's table of settings, by the names of Conventions. A plugin's file that
    is no JSON is as none; one without any of the settings is one that leaves all of them out."""
    path = os.path.join(editor, *PLUGIN)
    try:
        with open(path, encoding="utf-8") as f:
            return made(_found(json.load(f), NAMES), path, root, extension, write_name)
    except (OSError, ValueError):
        pass
    return made(_found(own, {n: [n] for n in NAMES}), "workspace" if own else "default", root, extension, write_name)
