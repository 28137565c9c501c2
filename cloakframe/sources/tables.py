"""Reading and writing stored tables; any Spark format. Raw copies of a protected table's files are what the checks call Copy."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from cloakframe.operators.protector import Protector


def write_sealed(protector: Protector, df: DataFrame, table: str, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Seals plain rows and appends them."""
    protector.seal_df(df, table).write.mode(mode).format(fmt).save(path)


def read_sealed(protector: Protector, table: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored rows, tagged."""
    return protector.tag(protector.spark.read.format(fmt).load(path), table)


def update_by_key(protector: Protector, stored: DataFrame, changes: DataFrame, table: str) -> DataFrame:
    """Stored rows of a table after an update: rows of `changes` (the row key and new plain values) replace those columns, sealed for their rows.
    The row key itself can't change; companions of columns that change are made anew."""
    bound = protector.policy.table_of(table)
    if bound is None:
        raise ValueError(f"{table} has no row key to update by")
    key = bound.row_key
    new = protector.seal_df(changes, table)
    names = [c for c in new.columns if c != key]
    both = stored.join(new.select(F.col(f"`{key}`").alias("__key"), F.lit(True).alias("__new"), *[F.col(f"`{c}`").alias(f"__n_{c}") for c in names]), F.col(f"`{key}`") == F.col("__key"), "left")
    pick = lambda c: F.when(F.col("__new"), F.col(f"`__n_{c}`")).otherwise(F.col(f"`{c}`")).alias(c)
    return protector.tag(both.select(*[pick(c) if c in names else F.col(f"`{c}`") for c in stored.columns]), table)


def upsert_by_key(protector: Protector, stored: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """Stored rows with whole plain rows inserted, or put in place of those that have their row key."""
    key = protector.policy.table_of(table).row_key
    new = protector.seal_df(rows, table)
    return protector.tag(stored.join(rows.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns)), table)


class StoredTable:
    """Stored rows of one table as versions of a folder, v0, v1 and so on, in any format of files. Appends go to the newest version; updates and deletes write the next one, which counts once
    Spark has committed it (_SUCCESS), so a job that fails leaves the table as it was. Earlier versions stay for queries that read them until vacuum().
    There is one writer at a time; formats with transactions of their own need no StoredTable."""

    def __init__(self, protector: Protector, table: str, path: str, fmt: str = "parquet"):
        self.protector, self.table, self.path, self.fmt = protector, table, path.rstrip("/"), fmt

    def _versions(self) -> list[int]:
        spark = self.protector.spark
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path(self.path)):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v[0-9]+", n) and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """Stored rows of the newest version, tagged."""
        found = self._versions()
        if not found:
            raise FileNotFoundError(f"{self.path} has no version")
        return read_sealed(self.protector, self.table, f"{self.path}/v{found[-1]}", self.fmt)

    def append(self, plain: DataFrame) -> None:
        """Plain rows, sealed and added. Columns that the stored rows lack are refused, those that they have and plain rows lack are null."""
        at = f"{self.path}/v{(self._versions() or [0])[-1]}"
        sealed = self.protector.seal_df(plain, self.table)
        if self._versions():
            stored = self.read()
            if extra := set(sealed.columns) - set(stored.columns):
                raise ValueError(f"{self.table} has no columns {', '.join(sorted(extra))}")
            sealed = sealed.select(*[(F.col(f"`{f.name}`") if f.name in sealed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema])
        sealed.write.mode("append").format(self.fmt).save(at)

    def replace(self, stored: DataFrame) -> None:
        """Stored rows as the next version."""
        found = self._versions()
        stored.write.mode("overwrite").format(self.fmt).save(f"{self.path}/v{found[-1] + 1 if found else 0}")

    def vacuum(self) -> None:
        """Deletes all versions but the newest."""
        spark = self.protector.spark
        for v in self._versions()[:-1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
