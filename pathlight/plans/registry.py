"""Where query modules register a query and the SQL of its oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register the decorated (spark, sf_dir) -> DataFrame under ``name``."""

    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def uuid_sql(namespace: uuid.UUID, name: str) -> str:
    """The oracle's expression of a version 5 UUID of the text expression ``name``."""
    h = f"sha1(unhex('{namespace.hex}') || encode({name}))"
    variant = f"substr('89ab', ((instr('0123456789abcdef', substr({h}, 17, 1)) - 1) & 3) + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
