"""Canonical row keys: one text for each value of a key column, whatever it looked like."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from cloakframe.errors import RowKeyType

#: Bits of the integer types that can be row keys.
WIDTHS = {"short": 16, "integer": 32, "long": 64}
KINDS = (*WIDTHS, "text", "uuid")
UUID = r"^\s*\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?\s*$"


def kind_of(data_type: T.DataType, kind: str | None = None) -> str:
    """The kind of a key column: its type's, or uuid where a string column is declared as one. Other types are refused."""
    by_type = {T.ShortType: "short", T.IntegerType: "integer", T.LongType: "long", T.StringType: "text", T.VarcharType: "text"}
    found = by_type.get(type(data_type))
    if found is None or (kind is not None and kind != found and not (found == "text" and kind in KINDS)):
        raise RowKeyType(f"{data_type.simpleString()} can't be a row key" + (f" of kind {kind}" if kind else ""))
    return kind or found


def canonical(value: bytes, kind: str) -> bytes:
    """For a single value given as text."""
    if kind == "text":
        return value
    text = value.decode("utf-8", "strict").strip(" \t\n\v\f\r")
    if kind == "uuid":
        if not (m := re.match(UUID, text.lower())) or text.startswith("{") != text.endswith("}"):
            raise RowKeyType("not a uuid")
        return "-".join(m.groups()).encode()
    if not re.fullmatch(r"[+-]?[0-9]+", text) or not -(1 << WIDTHS[kind] - 1) <= int(text) < 1 << WIDTHS[kind] - 1:
        raise RowKeyType(f"not a {kind} in range")
    return str(int(text)).encode()


def row_key(column: Column, kind: str) -> Column:
    """Canonical bytes of a key column; null, and text that isn't of the kind, raise RowKeyType."""
    if kind == "text":
        out = column.cast("string")
    elif kind == "uuid":
        text = F.lower(column)
        good = text.rlike(UUID) & (F.trim(text).startswith("{") == F.trim(text).endswith("}"))
        out = F.when(good, F.regexp_replace(text, UUID, "$1-$2-$3-$4-$5")).otherwise(F.raise_error(F.lit("RowKeyType: not a uuid")).cast("string"))
    else:
        text = F.regexp_replace(column.cast("string"), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
        number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast({"short": "smallint", "integer": "int", "long": "bigint"}[kind]))
        out = F.coalesce(number.cast("string"), F.raise_error(F.lit(f"RowKeyType: not a {kind} in range")).cast("string"))
    return F.when(column.isNull(), F.raise_error(F.lit("RowKeyType: a row key is null")).cast("string")).otherwise(out).cast("binary")


