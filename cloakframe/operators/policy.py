"""Policies: which columns are protected, and how. A policy that looks protective and is not is refused."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from typing import Protocol

from pyspark.sql import Column

from cloakframe.errors import PolicyError
from cloakframe.functions.ident import MAX_BYTES, qualified, split_table
from cloakframe.functions.mask import Mask

TRANSFORMS = ("encrypt", "fpe", "token", "none")


class FieldTransform(Protocol):
    """A transform of one's own. inner and outer are the padded halves of the column's index key (functions.envelope.pads), as columns; the results are columns too."""

    stored_type: str
    readable: bool

    def seal(self, plain: Column, inner: Column, outer: Column) -> Column: ...

    def open(self, stored: Column, inner: Column, outer: Column) -> Column: ...


#: Transforms that register_transform() added, by name.
OWN: dict[str, FieldTransform] = {}


def register_transform(name: str, transform: FieldTransform) -> None:
    """Lets policies of this process name a transform of one's own; built-in names can't be taken."""
    if name in TRANSFORMS or not name:
        raise PolicyError(f"no transform can be called {name!r}")
    OWN[name] = transform


#: Stored type of each transform: bytes, text, or as it was.
STORED = {"encrypt": "binary", "fpe": "string", "token": "string", "none": None}
#: Stored values may have this many bytes unless a policy says otherwise.
MAX_VALUE_BYTES = 16 << 20


@dataclass(frozen=True)
class ColumnPolicy:
    table: str
    column: str
    transform: str = "encrypt"
    searchable: bool = False
    detokenize: bool = True
    mask: Mask | None = None
    key: str | None = None  #: the index key's name, if it isn't the column's: tokens of columns that share a key join

    @property
    def key_name(self) -> str:
        return self.key or self.name

    @property
    def name(self) -> str:
        return qualified(self.table, self.column)

    @property
    def readable(self) -> bool:
        """Whether stored values can be turned back: not tokens, and digits only if the policy lets them."""
        return OWN[self.transform].readable if self.transform in OWN else self.transform in ("encrypt", "none") or (self.transform == "fpe" and self.detokenize)

    @property
    def stored_type(self) -> str | None:
        return OWN[self.transform].stored_type if self.transform in OWN else STORED[self.transform]


@dataclass(frozen=True)
class TablePolicy:
    table: str
    row_key: str
    strict_row_binding: bool = False
    kind: str | None = None  #: uuid for a string column that holds uuids

    @property
    def name(self) -> str:
        return ".".join(split_table(self.table))


def _check_identifiers(name: str, *parts: str) -> None:
    for part in parts:
        if not part or len(part.encode()) > MAX_BYTES:
            raise PolicyError(f"{name}: an identifier is empty or over {MAX_BYTES} bytes")


@dataclass(frozen=True)
class Policy:
    columns: tuple[ColumnPolicy, ...] = ()
    tables: tuple[TablePolicy, ...] = ()
    on_unprotected: str = "warn"
    max_protected_value_bytes: int = MAX_VALUE_BYTES
    by_name: dict[str, ColumnPolicy] = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "tables", tuple(self.tables))
        if self.on_unprotected not in ("warn", "reject"):
            raise PolicyError("on_unprotected is warn or reject")
        for c in self.columns:
            self._check_column(c)
        seen: set[str] = set()
        for t in self.tables:
            self._check_table(t, seen)

    def _check_column(self, c: ColumnPolicy) -> None:
        if c.transform not in TRANSFORMS and c.transform not in OWN:
            raise PolicyError(f"{c.name}: no transform is called {c.transform}")
        if c.name in self.by_name:
            raise PolicyError(f"{c.name} is declared twice")
        self.by_name[c.name] = c
        if c.searchable and c.transform != "encrypt":
            raise PolicyError(f"{c.name}: only encrypted columns are searchable")
        if not c.detokenize and c.transform != "fpe":
            raise PolicyError(f"{c.name}: detokenize = false is for fpe only")
        if c.key is not None and (not c.key or c.transform == "none" or (c.transform == "encrypt" and not c.searchable)):
            raise PolicyError(f"{c.name}: a key's name is for columns with an index key")
        if c.transform == "none" and c.mask is None:
            raise PolicyError(f"{c.name}: without transform and mask nothing is protected")
        _check_identifiers(c.name, *split_table(c.table), c.column)

    def _check_table(self, t: TablePolicy, seen: set[str]) -> None:
        if t.name in seen:
            raise PolicyError(f"table {t.name} is declared twice")
        seen.add(t.name)
        _check_identifiers(t.name, *split_table(t.table), t.row_key)
        own = self.columns_of(t.table)
        if not own:
            raise PolicyError(f"table {t.name} has a row key and no protected columns")
        if all(c.transform != "encrypt" for c in own):
            raise PolicyError(f"table {t.name} has a row key and no encrypted column to bind")
        if any(c.column == t.row_key and c.transform != "none" for c in own):
            raise PolicyError(f"table {t.name}: its row key is sealed itself, so it can't be read to verify a row")

    def columns_of(self, table: str) -> list[ColumnPolicy]:
        return [c for c in self.columns if split_table(c.table) == split_table(table)]

    def table_of(self, table: str) -> TablePolicy | None:
        return next((t for t in self.tables if split_table(t.table) == split_table(table)), None)

    def row_keys(self) -> dict[str, TablePolicy]:
        return {t.name: t for t in self.tables}

    @classmethod
    def from_toml(cls, text: str) -> Policy:
        """From [[column]] and [[table]] entries and the two settings; unknown fields are refused."""
        try:
            spec = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise PolicyError(str(e)) from e

        def made(kind, entry: dict):
            known = {f.name for f in fields(kind)}
            if unknown := set(entry) - known:
                raise PolicyError(f"unknown fields: {', '.join(sorted(unknown))}")
            try:
                return kind(**entry)
            except TypeError as e:
                raise PolicyError(str(e)) from e

        columns = []
        for entry in spec.pop("column", []):
            mask = entry.pop("mask", None)
            columns.append(made(ColumnPolicy, entry | ({} if mask is None else {"mask": made(Mask, mask)})))
        tables = [made(TablePolicy, entry) for entry in spec.pop("table", [])]
        if unknown := set(spec) - {"on_unprotected", "max_protected_value_bytes"}:
            raise PolicyError(f"unknown fields: {', '.join(sorted(unknown))}")
        return cls(tuple(columns), tuple(tables), **spec)
