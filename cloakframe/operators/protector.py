"""Protector: seals, opens, masks and searches whole DataFrames under a policy.

Sealed columns carry metadata {"protect": column, "row_key": ...}; Catalyst keeps it through bare references, aliases, joins and set operations and drops it
under any function, so a result knows what in it can be opened. All is native except digits (fpe). Keys come in by
broadcast joins with key relations of as many rows as there are keys.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cloakframe import errors as E
from cloakframe.functions import envelope as env, fpe
from cloakframe.functions.ident import lookup_name
from cloakframe.functions.mask import mask_binary, mask_text
from cloakframe.functions.rowkey import kind_of, row_key
from cloakframe.operators.policy import OWN, ColumnPolicy, Policy
from cloakframe.sources.keys import Budget, Key, KeySource, data_key_table, padded, secret_row

INDEX_PREFIX = "__bidx_"


def index_column(column: str) -> str:
    """The companion column with a searchable column's blind index: filters on it reach the Parquet scan."""
    return INDEX_PREFIX + column


def _slot(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:12]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def origins(df: DataFrame) -> list[tuple[int, int] | None]:
    """Of each column of a result the leaf of its plan (an instance of a table) and the attribute there that it is, through projections and aliases; None if it is computed."""
    plan, renamed, leaves = df._jdf.queryExecution().analyzed(), {}, {}

    def walk(node) -> None:
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if not kids:
            for i in range(node.output().size()):
                leaves[node.output().apply(i).exprId().id()] = len(leaves)
            number[0] += 1
            instance.update({k: number[0] for k in leaves if k not in instance})
        for i in range(node.expressions().size()):
            e = node.expressions().apply(i)
            if e.getClass().getSimpleName() == "Alias" and e.child().getClass().getSimpleName() == "AttributeReference":
                renamed[e.exprId().id()] = e.child().exprId().id()
        for k in kids:
            walk(k)

    number, instance = [0], {}
    walk(plan)
    out: list[tuple[int, int] | None] = []
    for i in range(plan.output().size()):
        at = plan.output().apply(i).exprId().id()
        while at in renamed:
            at = renamed[at]
        out.append((instance[at], at) if at in instance else None)
    return out


class Protector:
    def __init__(self, spark: SparkSession, policy: Policy, keys: KeySource, budget: Budget | None = None):
        self.spark, self.policy, self.keys, self.budget = spark, policy, keys, budget or Budget()

    # -- introspection

    def columns(self) -> list[str]:
        return list(self.policy.by_name)

    def column(self, name: str) -> ColumnPolicy:
        found = self.policy.by_name.get(lookup_name(name))
        if found is None:
            raise E.UnknownColumn(name)
        return found

    def stored_type(self, name: str) -> str | None:
        return self.column(name).stored_type

    def binds_row(self, name: str) -> bool:
        c = self.column(name)
        return c.transform == "encrypt" and self.policy.table_of(c.table) is not None

    def check_row(self, name: str, has_row: bool) -> None:
        if self.binds_row(name) and not has_row:
            raise E.RowKeyRequired(name)
        if has_row and not self.binds_row(name):
            raise E.RowKeyNotDeclared(name)

    def search_term(self, name: str, plain: bytes | str) -> bytes | None:
        """The blind index of a value; None for columns that aren't searchable."""
        c = self.column(name)
        if not c.searchable:
            return None
        return env.hmac_bytes(self.keys.index_key(c.key_name), plain.encode() if isinstance(plain, str) else plain)

    # -- writing

    def _with_secrets(self, df: DataFrame, columns: list[ColumnPolicy], sealing: bytes | None) -> DataFrame:
        """df with the columns' padded index keys and, for sealing, the data key, from a broadcast row."""
        values: dict[str, bytes] = {}
        for c in columns:
            if c.searchable or c.transform == "token" or c.transform in OWN:
                values |= padded(_slot(c.name), self.keys.index_key(c.key_name))
        if sealing is not None:
            values |= {"__seal_id": sealing, "__seal_key": self.keys.key(sealing), "__seal_nonce": secrets.token_bytes(32)}
        return df.join(F.broadcast(secret_row(self.spark, values))) if values else df

    def _book(self, df: DataFrame, columns: int, count: int | None) -> bytes:
        """The key to seal `columns` values of each row with, after its budget was booked: of all rows, or for a stream of all that the key has left."""
        if count is None and df.isStreaming:
            return self.budget.take_rest(self.keys)
        return self.budget.take(self.keys, (df.count() if count is None else count) * columns)

    def seal_df(self, df: DataFrame, table: str, with_index: bool = True, count: int | None = None, nonces: dict[str, Column] | None = None, only: set[str] | None = None) -> DataFrame:
        """df with the table's protected columns in stored form, tagged, and companions of searchable ones.

        count: an upper bound of the rows, for the key's budget; if it is not given they are counted, without the columns that are sealed. Sealed
        data must be written, or checkpointed, before it is used twice: each evaluation has new nonces. nonces: for tests only. only: the columns to seal; others are taken to be stored already."""
        own = [c for c in self.policy.columns_of(table) if c.column in df.columns and (only is None or c.column in only)]
        df = df.drop(*[index_column(c.column) for c in own])
        bound = self.policy.table_of(table)
        self._check_types(df, own)
        secret = [c for c in own if c.transform == "encrypt"]
        key_id = None
        if secret:
            key_id = self._book(df, len(secret), count)
        row = None
        if bound and secret:
            if bound.row_key not in df.columns:
                raise E.RowKeyRequired(f"{bound.name}.{bound.row_key}")
            row = row_key(_quoted(bound.row_key), kind_of(df.schema[bound.row_key].dataType, bound.kind))
        out = self._with_secrets(df, own, key_id)
        by_column = {c.column: c for c in own}
        made: list[Column] = []
        for name in df.columns:
            c = by_column.get(name)
            if c is None:
                tag = {"protect_key": bound.name} if bound and name == bound.row_key else None
                made.append(_quoted(name).alias(name, metadata=tag) if tag else _quoted(name))
                continue
            tag = {"protect": c.name}
            plain = _quoted(name).cast("binary")
            if c.transform == "encrypt":
                at = (nonces or {}).get(name, env.derived_nonce(F.col("__seal_nonce"), plain, row))
                sealed = env.seal(plain, F.col("__seal_id"), F.col("__seal_key"), c.name, row, at)
                if c.searchable:
                    index = env.blind_index(plain, F.col(f"__in_{_slot(c.name)}"), F.col(f"__out_{_slot(c.name)}"))
                    made.append(env.with_index(index, sealed).alias(name, metadata=tag))
                    if with_index:
                        made.append(index.alias(index_column(name), metadata={"index_of": c.name}))
                else:
                    made.append(sealed.alias(name, metadata=tag))
            elif c.transform == "token":
                made.append(env.hmac_hex(plain, F.col(f"__in_{_slot(c.name)}"), F.col(f"__out_{_slot(c.name)}")).alias(name, metadata=tag))
            elif c.transform == "fpe":
                made.append(fpe.seal_digits(self.spark, _quoted(name), self.keys.index_key(c.key_name)).alias(name, metadata=tag))
            elif c.transform in OWN:
                made.append(OWN[c.transform].seal(plain, *self._halves(c)).alias(name, metadata=tag))
            else:
                made.append(_quoted(name).alias(name, metadata=tag))
        return out.select(*made)

    @staticmethod
    def _halves(c: ColumnPolicy) -> tuple[Column, Column]:
        return F.col(f"__in_{_slot(c.name)}"), F.col(f"__out_{_slot(c.name)}")

    # -- single columns

    def keyed(self, df: DataFrame, *names: str, rows: int | None = None) -> DataFrame:
        """df with the secrets that seal_col() and open_col() of these columns need, in columns that begin with __; unkeyed() drops them. The budget is booked for one value a row of each."""
        own = [self.column(n) for n in names]
        secret = sum(c.transform == "encrypt" for c in own)
        out = self._with_secrets(df, own, self._book(df, secret, rows) if secret else None)
        if not secret:
            return out
        every = F.map_from_entries(F.collect_list(F.struct("__key_id", "__key"))).alias("__data_keys")
        return out.join(F.broadcast(data_key_table(self.spark, self.keys.keys()).agg(every)))

    @staticmethod
    def unkeyed(df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c in ("__seal_id", "__seal_key", "__seal_nonce", "__data_keys") or c.startswith(("__in_", "__out_"))])

    def _row(self, name: str, row: Column | None, kind: T.DataType | None) -> Column | None:
        self.check_row(name, row is not None)
        return None if row is None else row_key(row, kind_of(kind, self.policy.table_of(self.column(name).table).kind))

    def seal_col(self, name: str, plain: Column, row: Column | None = None, row_type: T.DataType | None = None) -> Column:
        """The stored form of one column, over rows of keyed(). row: the row key and its type, for columns that bind their row."""
        c, at = self.column(name), self._row(name, row, row_type)
        plain = plain.cast("binary")
        if c.transform == "encrypt":
            sealed = env.seal(plain, F.col("__seal_id"), F.col("__seal_key"), c.name, at, env.derived_nonce(F.col("__seal_nonce"), plain, at))
            return env.with_index(env.blind_index(plain, *self._halves(c)), sealed) if c.searchable else sealed
        if c.transform == "token":
            return env.hmac_hex(plain, *self._halves(c))
        if c.transform == "fpe":
            return fpe.seal_digits(self.spark, plain.cast("string"), self.keys.index_key(c.key_name))
        return OWN[c.transform].seal(plain, *self._halves(c)) if c.transform in OWN else plain

    def open_col(self, name: str, stored: Column, row: Column | None = None, row_type: T.DataType | None = None) -> Column:
        """The plain value of one column, over rows of keyed(); tokens are not readable."""
        c, at = self.column(name), self._row(name, row, row_type)
        if not c.readable:
            raise E.NotReadable(c.name)
        if c.transform == "encrypt":
            bound = self.policy.table_of(c.table)
            return env.open_(stored, F.col("__data_keys")[env.key_id_of(stored)], c.name, at, bool(bound and bound.strict_row_binding))
        if c.transform == "fpe":
            return fpe.open_digits(self.spark, stored, self.keys.index_key(c.key_name))
        return OWN[c.transform].open(stored, *self._halves(c)) if c.transform in OWN else stored

    def mask_col(self, name: str, plain: Column, binary: bool = False) -> Column:
        """The masked form of a column's plain text (or bytes); as it is if the policy has no mask."""
        c = self.column(name)
        return plain if c.mask is None else (mask_binary if binary else mask_text)(plain, c.mask)

    @staticmethod
    def _check_types(df: DataFrame, own: list[ColumnPolicy]) -> None:
        for c in own:
            kind = df.schema[c.column].dataType
            if not isinstance(kind, T.StringType | T.BinaryType | T.VarcharType) and c.transform != "none":
                raise E.PolicyError(f"{c.name}: {kind.simpleString()} values must be cast to string or binary before they are sealed")

    def tag(self, df: DataFrame, table: str) -> DataFrame:
        """df, read back from storage, with its protected columns tagged again; stored types must be the policy's."""
        bound, tags = self.policy.table_of(table), {}
        for c in self.policy.columns_of(table):
            if c.column in df.columns:
                kind = df.schema[c.column].dataType.simpleString()
                if c.stored_type and kind != c.stored_type:
                    raise E.PolicyError(f"{c.name} is stored as {kind}, and {c.transform} makes {c.stored_type}")
                tags[c.column] = {"protect": c.name}
                if index_column(c.column) in df.columns:
                    tags[index_column(c.column)] = {"index_of": c.name}
        if bound and bound.row_key in df.columns:
            tags[bound.row_key] = {"protect_key": bound.name} | tags.get(bound.row_key, {})
        return df.select(*[_quoted(c).alias(c, metadata=tags[c]) if c in tags else _quoted(c) for c in df.columns])

    # -- reading

    def _protected(self, df: DataFrame) -> dict[int, ColumnPolicy]:
        return {i: self.policy.by_name[f.metadata["protect"]] for i, f in enumerate(df.schema) if f.metadata.get("protect") in self.policy.by_name}

    def _row_position(self, df: DataFrame, i: int, c: ColumnPolicy) -> int | None:
        """The place of the row key that column i of the result was sealed with: where the result has the table's key more than once, that of the same instance of the table."""
        bound = self.policy.table_of(c.table)
        if bound is None:
            return None
        at = [k for k, f in enumerate(df.schema) if f.metadata.get("protect_key") == bound.name]
        instances = origins(df) if len(at) > 1 or (at and self._instances(df, bound.name) > 1) else []
        if instances:
            if instances[i] is None or any(instances[k] is None for k in at):
                if len(at) > 1:
                    raise E.AmbiguousRowKey(f"{bound.name}.{bound.row_key} is in the result {len(at)} times")
                raise E.AmbiguousRowInstance(f"{c.name} and {bound.row_key} may be of different instances of {bound.name}")
            at = [k for k in at if instances[k][0] == instances[i][0]]
            if len(at) > 1:
                raise E.AmbiguousRowKey(f"{bound.name}.{bound.row_key} is in the result {len(at)} times")
        return at[0] if at else None

    def _instances(self, df: DataFrame, table: str) -> int:
        """How many protected columns of a table the result has of the most frequent one: over 1 if it joins the table with itself."""
        names = [f.metadata["protect"] for f in df.schema if f.metadata.get("protect") in self.policy.by_name]
        return max([0, *(names.count(n) for n in names if self.policy.table_of(self.policy.by_name[n].table) and self.policy.table_of(self.policy.by_name[n].table).name == table)])

    def _keys_of(self, df: DataFrame, columns: list[str]) -> dict[bytes, Key]:
        """The data keys that open stored columns: all of a source that has them all, else those that the values name (as many as there are keys)."""
        if getattr(self.keys, "complete", True) or df.isStreaming or not columns:
            return self.keys.keys()
        named = df.select(F.explode(F.array(*[env.key_id_of(F.col(c)) for c in columns])).alias("id")).where("id IS NOT NULL").distinct()
        return {i: self.keys.key(i) for i in (bytes(r["id"]) for r in named.collect())}

    def open_df(self, df: DataFrame, masked: bool = True, lenient: bool = True, quiet: bool = False, keys: list[bytes] | None = None) -> DataFrame:
        """df with its tagged columns opened and then masked; companions are dropped. Failed authentication, unknown keys and
        missing row keys raise when Spark evaluates the value. Encrypted text columns come back as binary unless their values were declared text.

        lenient: columns that can't be read (tokens) keep their stored form, else NotReadable; values that aren't sealed pass, else Unprotected. quiet: null for values that fail, for reports only."""
        names = [f"__c{i}" for i in range(len(df.columns))]
        found = self._protected(df)
        if len(set(df.columns)) != len(df.columns):
            flat = df.toDF(*names)
        else:
            flat = df.select(*[_quoted(c).alias(n) for c, n in zip(df.columns, names, strict=True)])
        secret = [names[i] for i, c in found.items() if c.transform == "encrypt"]
        all_keys = {i: self.keys.key(i) for i in keys} if keys is not None else self._keys_of(flat, secret)
        table = data_key_table(self.spark, all_keys)
        out, made = self._with_secrets(flat, [c for c in found.values() if c.transform in OWN], None), {}
        for i, c in found.items():
            at = self._row_position(df, i, c) if c.transform == "encrypt" else None
            if c.transform == "encrypt":
                out = out.withColumn(f"__id{i}", env.key_id_of(F.col(names[i])))
                named = table.select(F.col("__key_id").alias(f"__k{i}"), F.col("__key").alias(f"__v{i}"))
                out = out.join(F.broadcast(named), F.col(f"__id{i}") == F.col(f"__k{i}"), "left")
                bound = self.policy.table_of(c.table)
                row = None if at is None else row_key(F.col(names[at]), kind_of(df.schema[at].dataType, bound.kind))
                value = env.open_(F.col(names[i]), F.col(f"__v{i}"), c.name, row, bool(bound and bound.strict_row_binding), quiet)
                if not lenient:
                    value = F.when(F.col(names[i]).isNotNull() & F.col(f"__id{i}").isNull(), F.raise_error(F.lit(f"Unprotected: a value of {c.name} is not sealed")).cast("binary")).otherwise(value)
                large = F.octet_length(names[i]) > self.policy.max_protected_value_bytes
                value = F.when(large, F.raise_error(F.lit("ProtectedValueTooLarge: a stored value exceeds the ceiling")).cast("binary")).otherwise(value)
            elif c.transform == "fpe" and c.readable:
                value = fpe.open_digits(self.spark, F.col(names[i]), self.keys.index_key(c.key_name))
                if not lenient:
                    short = fpe.digits_in(F.col(names[i])) < fpe.LEAST_DIGITS
                    value = F.when(short, F.raise_error(F.lit(f"Unprotected: a value of {c.name} is not sealed")).cast("string")).otherwise(value)
            elif not c.readable and not lenient:
                raise E.NotReadable(c.name)
            elif c.transform in OWN and c.readable:
                value = OWN[c.transform].open(F.col(names[i]), *self._halves(c))
            else:
                value = F.col(names[i])
            if masked and c.mask is not None:
                value = mask_binary(value, c.mask) if c.transform == "encrypt" or isinstance(df.schema[i].dataType, T.BinaryType) else mask_text(value.cast("string"), c.mask)
            made[i] = value
        keep = [i for i, f in enumerate(df.schema) if "index_of" not in f.metadata]
        return out.select(*[made.get(i, F.col(names[i])).alias(df.columns[i]) for i in keep])

    def kinds_df(self, df: DataFrame) -> DataFrame:
        """df with a column <name>__kind for each tagged column: `value` if open_df turns a value back, `unprotected` if it passes as it is, null for nulls."""

        def kind(name: str, c: ColumnPolicy) -> Column:
            sealed = env.envelope_of(_quoted(name)).isNotNull() if c.transform == "encrypt" else fpe.digits_in(_quoted(name)) >= fpe.LEAST_DIGITS if c.transform == "fpe" and c.readable else F.lit(False)
            return F.when(_quoted(name).isNotNull(), F.when(sealed, "value").otherwise("unprotected")).alias(f"{name}__kind")

        return df.select("*", *[kind(df.columns[i], c) for i, c in self._protected(df).items()])

    def open_text_df(self, df: DataFrame, **how) -> DataFrame:
        """open_df with encrypted columns as text; values that aren't UTF-8 raise."""
        opened = self.open_df(df, **how)
        secret = {df.columns[i] for i, c in self._protected(df).items() if c.transform == "encrypt"}
        return opened.select(*[F.validate_utf8(_quoted(c).cast("string")).alias(c) if c in secret else _quoted(c) for c in opened.columns])

    def masked_df(self, df: DataFrame, table: str) -> DataFrame:
        """Plain rows of a table with only its masked columns changed."""
        masks = {c.column: c.mask for c in self.policy.columns_of(table) if c.mask is not None}
        mask = lambda c: (mask_binary if isinstance(df.schema[c].dataType, T.BinaryType) else mask_text)(_quoted(c), masks[c])
        return df.select(*[mask(c).alias(c) if c in masks else _quoted(c) for c in df.columns])

    def verify_df(self, df: DataFrame) -> int:
        """Opens every protected value and returns the number of rows; unlike count(), it can't skip a value."""
        opened = self.open_df(df, masked=False)
        seen = F.xxhash64(*[_quoted(c) for c in opened.columns])
        return opened.select(F.count(F.when(seen.isNotNull(), 1)).alias("n"), F.bit_xor(seen).alias("x")).first()["n"]

    # -- searching

    def matches(self, df: DataFrame, column: str, values, stored: str | None = None) -> Column:
        """The condition that a sealed column has one of some values. It compares blind indexes: the companion where df has it,
        else the index in front of the envelope. Nulls among the values match nothing, as in SQL."""
        c = self.column(column)
        if not c.searchable:
            raise E.Unprotected([f"{c.name} is not searchable (UnindexedPredicate)"])
        at = stored or c.column
        values = [values] if isinstance(values, bytes | str) or values is None else list(values)
        terms = [F.lit(bytearray(self.search_term(column, v))) for v in values if v is not None]
        index = _quoted(index_column(at)) if index_column(at) in df.columns else F.substring(_quoted(at), 1, env.INDEX)
        if not terms:
            return F.lit(None).cast("boolean")
        found = index.isin(*terms) if len(terms) > 1 else index == terms[0]
        return found | F.lit(None).cast("boolean") if len(terms) < len(values) else found

    # -- jobs

    def reseal(self, df: DataFrame, table: str) -> DataFrame:
        """Stored rows of a table opened and sealed again with the active key: migration of plain values, old formats and rotated keys."""
        opened = self.open_df(self.tag(df, table), masked=False)
        back = {c.column: c for c in self.policy.columns_of(table) if c.column in df.columns}
        if any(c.transform == "token" for c in back.values()):
            raise E.NotReadable(f"{table}: tokens can't be sealed again")
        return self.seal_df(opened, table)
