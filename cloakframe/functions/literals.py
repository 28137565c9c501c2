"""Text of values as statements write them, and back: `\\x` and hex digits are bytes where the column stores bytes, else they are text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def literal_bytes(text: str, stored_type: str | None) -> bytes:
    """The plain value that a literal stands for."""
    if stored_type == "binary" and text.startswith("\\x"):
        try:
            return bytes.fromhex(text[2:])
        except ValueError:
            return text.encode()
    return text.encode()


def literal_column(text: Column, stored_type: str | None) -> Column:
    """The same for a column of literals."""
    if stored_type != "binary":
        return text.cast("binary")
    is_hex = text.rlike(r"^\\x([0-9A-Fa-f]{2})*$")
    return F.when(is_hex, F.unhex(F.substring(text, 3, 2**31 - 1))).otherwise(text.cast("binary"))


def hex_text(value: Column) -> Column:
    """Bytes as `\\x` and lower-case hex digits."""
    return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
