"""Deterministic identifiers in SQL expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of the name in the namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.substring(F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))), -1, 1)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def short_id(name: Column) -> Column:
    """The first sixteen digits of the SHA-1."""
    return F.substring(F.sha1(F.encode(name, "UTF-8")), 1, 16)
