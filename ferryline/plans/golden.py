"""Rows worked out by hand, as text for the engine that checks results."""

from __future__ import annotations


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]" if v else "CAST([] AS VARCHAR[])"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def rows(columns: str, *values: tuple) -> str:
    """SELECT of these rows; columns are ``name`` or ``name type``."""
    names = [c.strip().split(" ", 1) for c in columns.split(",")]
    names = [['"' + n[0].strip('"') + '"', *n[1:]] for n in names]
    picked = ", ".join(f"CAST({n[0]} AS {n[1]}) AS {n[0]}" if len(n) > 1 else n[0] for n in names)
    if not values:
        return "SELECT " + ", ".join(f"CAST(NULL AS {n[1] if len(n) > 1 else 'VARCHAR'}) AS {n[0]}" for n in names) + " WHERE FALSE"
    body = ", ".join("(" + ", ".join(map(literal, v)) + ")" for v in values)
    return f"SELECT {picked} FROM (VALUES {body}) AS t({', '.join(n[0] for n in names)})"
