"""Canonical field paths: segments joined by dots; `\\.` is a dot in a segment and `\\\\` a backslash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_path(path: str) -> list[str]:
    """The segments of a path. A backslash at the end stands for itself."""
    segments, current, i = [], [], 0
    while i < len(path):
        c = path[i]
        if c == "\\" and i + 1 < len(path) and path[i + 1] in ".\\":
            current.append(path[i + 1])
            i += 1
        elif c == ".":
            segments.append("".join(current))
            current = []
        else:
            current.append(c)
        i += 1
    return [*segments, "".join(current)]


def escape_segment(segment: str) -> str:
    return segment.replace("\\", "\\\\").replace(".", "\\.")


def join_path(segments: list[str]) -> str:
    return ".".join(map(escape_segment, segments))


def variant_at(payload: Column, segments: list[str]) -> Column:
    """The variant at a path; null if any step is missing. Quotes of one kind go into a JSON path, both kinds through a map."""
    found, steps = payload, ""

    def flush() -> None:
        nonlocal found, steps
        if steps:
            found, steps = F.try_variant_get(found, f"${steps}", "variant"), ""

    for s in segments:
        if '"' not in s:
            steps += f'["{s}"]'
        elif "'" not in s:
            steps += f"['{s}']"
        else:
            flush()
            as_object = F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), found)
            found = F.try_element_at(as_object.cast("map<string,variant>"), F.lit(s))
    flush()
    return found
