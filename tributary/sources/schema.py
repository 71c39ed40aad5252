"""Schemas: DDL overrides, SQLite type affinity and the match between sources."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tributary.errors import FederationError


def affinity(declared: str) -> T.DataType:
    """The Spark type of a declared SQLite type."""
    name = declared.upper()
    if "INT" in name:
        return T.LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if not name.strip() or "BLOB" in name:
        return T.BinaryType()
    return T.DoubleType()


def _split(ddl: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "(<") - (c in ")>")
        if c == "," and depth == 0:
            parts.append(ddl[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, ddl[last:]] if p.strip()]


def parse_override(schema: str | T.StructType) -> T.StructType:
    """``'name TYPE, ...'`` as a schema; the first column counts as the key, all may be null.

    Types are Spark's if Spark knows them, else SQLite's by affinity.
    """
    if isinstance(schema, T.StructType):
        fields = list(schema.fields)
    else:
        fields = []
        for part in _split(schema):
            m = re.match(r'\s*(?:"([^"]+)"|`([^`]+)`|(\S+))\s*(.*)$', part, re.S)
            name, declared = next(g for g in m.groups()[:3] if g), m.group(4).strip()
            try:
                kind = T.DataType.fromDDL(declared) if declared else T.StringType()
            except Exception:
                kind = affinity(declared)
            fields.append(T.StructField(name, T.LongType() if declared.upper() in ("INTEGER", "INT") else kind, True, {"declared": declared}))
    if not fields:
        raise FederationError("the schema override has no columns")
    fields[0] = T.StructField(fields[0].name, fields[0].dataType, True, {**(fields[0].metadata or {}), "pk": True})
    return T.StructType(fields)


def check_match(first: T.StructType, other: T.StructType, path: str, alias: str) -> None:
    """Names, order and number of columns must agree, exactly; so must types, up to a cast."""
    if first.names != other.names:
        raise FederationError(f"schema mismatch in source {alias!r} ({path}): {other.names} instead of {first.names}")
    for a, b in zip(first, other, strict=True):
        nested = (T.ArrayType, T.MapType, T.StructType)
        if isinstance(a.dataType, nested) != isinstance(b.dataType, nested):
            raise FederationError(f"schema mismatch in source {alias!r} ({path}): column {a.name!r} can't be cast to {a.dataType.simpleString()}")
