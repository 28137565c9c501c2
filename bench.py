"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Values of `lineitem` (600,000 at sf0.1) are sealed and opened one column of each kind, into the
noop sink; `rates` are values a second, Parquet scan included. The other queries are the registered ones of protected tables.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakframe import queries as Q
from cloakframe.operators.policy import ColumnPolicy, Policy, TablePolicy
from cloakframe.operators.protector import Protector
from cloakframe.sources.keys import Key, MemoryKeys
from cloakframe.sources.scratch import materialized

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("search_eq", "search_in", "search_join_subquery", "search_cte", "open_then_agg", "open_then_window", "open_then_join", "seal_open_roundtrip_cell", "token_group_count", "join_on_index")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(action, times: int = 2) -> float:
    """Seconds of the fastest of some runs, after one to warm up."""
    out = []
    for _ in range(times + 1):
        began = time.time()
        action()
        out.append(time.time() - began)
    return min(out[1:])


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    source = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.monotonically_increasing_id().alias("id"), F.concat_ws("", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("@example.co")).alias("email"), F.format_string("%04d-%04d-%04d-%04d", F.pmod("l_orderkey", F.lit(10000)), F.pmod("l_partkey", F.lit(10000)), F.pmod("l_suppkey", F.lit(10000)), F.col("l_linenumber")).alias("pan"))
    plain = materialized(source.repartition(int(CPUS)), "bench")
    n = plain.count()
    index = {"public.t.email": Key(b"\3" * 32), "public.t.pan": Key(b"\4" * 32)}
    keys = MemoryKeys(b"\1" * 16, {b"\1" * 16: Key(b"\7" * 32)}, index)
    seconds, rates = {}, {}

    def kind(name: str, policy: Policy, column: str = "email") -> None:
        p = Protector(spark, policy, keys)
        rows = plain.select("id", column)
        seconds[f"{name}_seal"] = best(lambda: run(p.seal_df(rows, "t", count=n)))
        if policy.columns[0].readable:
            stored = materialized(p.seal_df(rows, "t", count=n), "stored")
            seconds[f"{name}_open"] = best(lambda: run(p.open_df(stored, masked=False)))

    kind("encrypt", Policy([ColumnPolicy("t", "email")]))
    kind("encrypt_row", Policy([ColumnPolicy("t", "email")], [TablePolicy("t", "id")]))
    kind("searchable", Policy([ColumnPolicy("t", "email", searchable=True)]))
    kind("fpe", Policy([ColumnPolicy("t", "pan", transform="fpe")]), "pan")
    kind("token", Policy([ColumnPolicy("t", "email", transform="token")]))
    rates = {k: round(n / v) for k, v in seconds.items()}
    for name in QUERIES:
        seconds[name] = best(lambda q=name: run(Q.QUERIES[q](spark, SF)), 1)
    total = sum(seconds.values())
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(total, 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in seconds.items()}, "rates": rates, "values": n, "sf": SF.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
