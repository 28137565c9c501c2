"""Identifiers of policies: folding, clipping, qualified names."""

from __future__ import annotations

#: Fixed value: identifiers are this many bytes long at most.
MAX_BYTES = 63
DEFAULT_SCHEMA = "public"


def clip(name: str) -> str:
    """At most 63 bytes of UTF-8, cut between characters."""
    return name.encode()[:MAX_BYTES].decode("utf-8", "ignore")


def fold(name: str, quoted: bool = False) -> str:
    """An unquoted name with A-Z lower-cased (other letters stay), clipped; a quoted one is only clipped."""
    return clip(name if quoted else "".join(c.lower() if "A" <= c <= "Z" else c for c in name))


def split_table(name: str) -> tuple[str, str]:
    """Schema and table; a bare table is in the default schema."""
    schema, dot, table = name.partition(".")
    return (schema, table) if dot else (DEFAULT_SCHEMA, name)


def qualified(table: str, column: str) -> str:
    return ".".join((*split_table(table), column))


def lookup_name(name: str) -> str:
    """A column's full name: with exactly one dot it is in the default schema."""
    return f"{DEFAULT_SCHEMA}.{name}" if name.count(".") == 1 else name
