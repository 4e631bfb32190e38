"""Deterministic ids: name-based UUIDs (version 5) in the OID namespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the OID namespace.
OID = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(OID)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128).cast("string"), 10, 16))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def keyed(kind: str, *parts: Column, prefix: str = "memory") -> Column:
    """The id of a thing of a kind by its parts; prefix sets stores apart."""
    return uuid5(F.concat_ws(":", F.lit(f"{prefix}-{kind}"), *parts))


def fact_id(memory: Column, fact: Column, prefix: str = "memory") -> Column:
    return keyed("fact", memory, fact, prefix=prefix)


def turn_id(harness: Column, session: Column, source: Column, prefix: str = "memory") -> Column:
    return keyed("turn", harness, session, source, prefix=prefix)


def import_id(scope: Column, agent: Column, role: Column, created_at: Column, text: Column, prefix: str = "memory") -> Column:
    return keyed("import", scope, agent, role, created_at, text, prefix=prefix)


def random_id() -> Column:
    """A new random UUID for each row (version 4)."""
    return F.expr("uuid()")


def positional_id(line: Column, text: Column) -> Column:
    """The line and its text's UUID, for records without an id."""
    return F.concat_ws(":", line.cast("string"), F.replace(uuid5(text), F.lit("-")))
