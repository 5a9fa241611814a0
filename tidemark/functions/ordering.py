"""Logical order and public form of records, as plain functions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from .validation import clone_payload


def compare_by_logical_order(a: Mapping[str, Any], b: Mapping[str, Any]) -> int:
    """-1, 0 or 1: by timestamp, then insertion order."""
    x, y = ((r["timestamp"], r["insertion_order"]) for r in (a, b))
    return (x > y) - (x < y)


def to_public_record(record: Mapping[str, Any]) -> dict[str, Any]:
    """{timestamp, payload}, the payload copied; internal columns are left out."""
    return {"timestamp": record["timestamp"], "payload": clone_payload(record["payload"])}
