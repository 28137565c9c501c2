"""The registered queries of protected tables, with SQL over the plain tables that gives the same rows.

Ciphertext is random and is never a result; results are what it opens to, its shape, or how many values were refused. The keys are public test constants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cloakframe import errors as E
from cloakframe.functions import envelope as env, fpe
from cloakframe.functions.mask import Mask, mask_text
from cloakframe.functions.rowkey import row_key
from cloakframe.operators.policy import ColumnPolicy, Policy, TablePolicy
from cloakframe.operators.protector import Protector, index_column
from cloakframe.plans.front import ProtectedSql
from cloakframe.sources.keys import Budget, Key, MemoryKeys, StoreKeys
from cloakframe.sources.scratch import materialized, scratch_path
from cloakframe.sources.tables import StoredTable, update_by_key, upsert_by_key
from cloakframe.streaming.sealed import open_stream, seal_stream, write_available

# Public test constants.
KEY_ID, OLD_ID = b"\x01" * 16, b"\x02" * 16
INDEX_KEY, FPE_KEY, TOKEN_KEY = b"\x03" * 32, b"\x04" * 32, b"\x05" * 32

POLICY = Policy(
    columns=(
        ColumnPolicy("customer", "c_mktsegment", searchable=True),
        ColumnPolicy("customer", "c_name", transform="fpe", mask=Mask(keep_last=4)),
        ColumnPolicy("supplier", "s_name", transform="token"),
        ColumnPolicy("orders", "o_orderpriority", searchable=True),
        ColumnPolicy("orders", "o_orderstatus", transform="token"),
        ColumnPolicy("lineitem", "l_returnflag"),
        ColumnPolicy("lineitem", "l_linestatus", searchable=True),
        ColumnPolicy("part", "p_brand", searchable=True),
        ColumnPolicy("part", "p_name", transform="none", mask=Mask(keep_first=2)),
        ColumnPolicy("events", "event_type", searchable=True),
        ColumnPolicy("events", "props"),
        ColumnPolicy("pages", "url", transform="token"),
        ColumnPolicy("pages", "html"),
        ColumnPolicy("conversations", "text"),
        ColumnPolicy("documents", "text", transform="none", mask=Mask(keep_first=3, keep_last=3)),
    ),
    tables=(TablePolicy("customer", "c_custkey"), TablePolicy("orders", "o_orderkey", strict_row_binding=True), TablePolicy("events", "event_id"), TablePolicy("part", "p_partkey")),
)


def keys() -> MemoryKeys:
    index = {"public.customer.c_name": Key(FPE_KEY), "public.supplier.s_name": Key(TOKEN_KEY), "public.orders.o_orderstatus": Key(TOKEN_KEY), "public.pages.url": Key(TOKEN_KEY)}
    return MemoryKeys(KEY_ID, {KEY_ID: Key(b"\x07" * 32), OLD_ID: Key(b"\x08" * 32)}, index | {c.name: Key(INDEX_KEY) for c in POLICY.columns if c.searchable})


def protector(spark: SparkSession, policy: Policy = POLICY) -> Protector:
    return Protector(spark, policy, keys())


def plain(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a file with fewer row groups than cores is read by as many tasks, and sealing is worth a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def sealed(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A table (or some of its columns) sealed and written."""
    df = plain(spark, sf, name)
    rows = df.count()
    return materialized(protector(spark).seal_df(spread(df.select(*columns) if columns else df), name, count=rows), name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _mask_sql(column: str, first: int, last: int) -> str:
    hidden = f"length({column}) - {first + last}"
    return f"CASE WHEN length({column}) <= {first + last} THEN repeat('*', length({column})) ELSE left({column}, {first}) || repeat('*', {hidden}) || CASE WHEN {last} > 0 THEN right({column}, {last}) ELSE '' END END"


def _hmac_sql(key: bytes, value: str) -> str:
    inner, outer = (p.hex() for p in env.pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


# -- minimum slice: seal, write, search by index, open, mask


@query(f"SELECT c_custkey, {_mask_sql('c_name', 0, 4)} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'FURNITURE'")
def search_eq(spark, sf):
    p, t = protector(spark), sealed(spark, sf, "customer")
    return p.open_text_df(t.where(p.matches(t, "customer.c_mktsegment", "FURNITURE")))


# -- masks


@query(f"SELECT c_custkey, {_mask_sql('c_name', 0, 4)} AS masked FROM customer")
def mask_keep_last(spark, sf):
    return plain(spark, sf, "customer").select("c_custkey", mask_text(F.col("c_name"), Mask(keep_last=4)).alias("masked"))


@query(f"SELECT p_partkey, {_mask_sql('p_name', 2, 0)} AS masked FROM part")
def mask_keep_first(spark, sf):
    return plain(spark, sf, "part").select("p_partkey", mask_text(F.col("p_name"), Mask(keep_first=2)).alias("masked"))


@query(f"SELECT n_nationkey, {_mask_sql('n_name', 3, 3)} AS masked FROM nation")
def mask_short(spark, sf):
    return plain(spark, sf, "nation").select("n_nationkey", mask_text(F.col("n_name"), Mask(3, 3)).alias("masked"))


@query("SELECT s_suppkey, repeat('#', length(s_name)) AS masked FROM supplier")
def mask_all(spark, sf):
    return plain(spark, sf, "supplier").select("s_suppkey", mask_text(F.col("s_name"), Mask(mask_with="#")).alias("masked"))


@query(f"SELECT doc_id, {_mask_sql('text', 3, 3)} AS text FROM documents")
def mask_multilingual(spark, sf):
    return protector(spark).masked_df(plain(spark, sf, "documents"), "documents").select("doc_id", "text")


@query(f"SELECT p_partkey, {_mask_sql('p_name', 2, 0)} AS p_name, p_brand FROM part")
def masked_df_part(spark, sf):
    return protector(spark).masked_df(plain(spark, sf, "part"), "part").select("p_partkey", "p_name", "p_brand")


# -- tokens, indexes, shapes


@query(f"SELECT s_suppkey, {_hmac_sql(TOKEN_KEY, 's_name')} AS s_name FROM supplier")
def token_seal(spark, sf):
    return protector(spark).seal_df(plain(spark, sf, "supplier"), "supplier").select("s_suppkey", "s_name")


@query(f"SELECT {_hmac_sql(TOKEN_KEY, 'o_orderstatus')} AS token, count(*) AS n FROM orders GROUP BY o_orderstatus")
def token_group_count(spark, sf):
    return protector(spark).seal_df(plain(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "orders").groupBy(F.col("o_orderstatus").alias("token")).agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, {_hmac_sql(INDEX_KEY, 'c_mktsegment')} AS bidx, true AS same FROM customer")
def blind_index_hex(spark, sf):
    t = protector(spark).seal_df(plain(spark, sf, "customer"), "customer")
    return t.select("c_custkey", F.lower(F.hex(index_column("c_mktsegment"))).alias("bidx"), (F.col(index_column("c_mktsegment")) == env.index_of(F.col("c_mktsegment"))).alias("same"))


@query("SELECT count(DISTINCT p_brand) AS n FROM part")
def distinct_by_index(spark, sf):
    return sealed(spark, sf, "part").agg(F.countDistinct(index_column("p_brand")).alias("n"))


@query("SELECT o_orderkey, 'DBS3' AS magic, 32 + 48 + octet_length(encode(o_orderpriority)) AS n, true AS nonce_fresh FROM orders")
def envelope_shape(spark, sf):
    t = sealed(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    e = env.envelope_of(F.col("o_orderpriority"))
    nonces = Window.partitionBy(F.substring(e, env.MAGIC + env.KEY_ID + 1, env.NONCE))
    return t.select("o_orderkey", F.substring(e, 1, 4).cast("string").alias("magic"), F.octet_length("o_orderpriority").cast("long").alias("n"), (F.count("*").over(nonces) == 1).alias("nonce_fresh"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2")
def seal_open_roundtrip_cell(spark, sf):
    t = sealed(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return protector(spark).open_text_df(t).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT event_id, event_type, props FROM events")
def seal_open_roundtrip_row(spark, sf):
    return protector(spark).open_text_df(sealed(spark, sf, "events", "event_id", "event_type", "props"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def seal_open_conversations(spark, sf):
    return protector(spark).open_text_df(sealed(spark, sf, "conversations"))


@query("SELECT count(*) AS n FROM pages")
def verify_pages(spark, sf):
    n = protector(spark).verify_df(sealed(spark, sf, "pages", "page_id", "html"))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


# -- predicates over sealed columns, by DataFrame and by SQL


def _sql(spark, sf, text, *tables, policy=POLICY, args=None):
    front = ProtectedSql(protector(spark, policy))
    for t in tables:
        front.register(sealed(spark, sf, t) if POLICY.columns_of(t) else plain(spark, sf, t), t)
    return front.sql(text, args)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def search_in(spark, sf):
    return _sql(spark, sf, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "customer")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def search_not_in(spark, sf):
    return _sql(spark, sf, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "customer")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def search_any_array(spark, sf):
    p, t = protector(spark), sealed(spark, sf, "orders")
    return p.open_text_df(t.where(p.matches(t, "orders.o_orderpriority", ["1-URGENT", "2-HIGH", None])).select("o_orderkey", "o_orderpriority"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR (NOT c_mktsegment = 'FURNITURE' AND c_nationkey = 3)")
def search_or_and(spark, sf):
    return _sql(spark, sf, "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR (NOT c_mktsegment = 'FURNITURE' AND c_nationkey = 3)", "customer")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL")
def search_null(spark, sf):
    return _sql(spark, sf, "SELECT count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL", "customer")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '3-MEDIUM'")
def search_argument(spark, sf):
    return _sql(spark, sf, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = :p", "orders", args={"p": "3-MEDIUM"})


@query("SELECT o.o_orderkey, o.o_orderpriority, o.o_totalprice FROM orders o WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o.o_orderpriority = '1-URGENT'")
def search_join_subquery(spark, sf):
    text = "SELECT o.o_orderkey, o.o_orderpriority, o.o_totalprice FROM orders o WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o.o_orderpriority = '1-URGENT'"
    return _sql(spark, sf, text, "orders", "customer")


@query("SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = 'MACHINERY' GROUP BY n.n_name")
def search_join_on(spark, sf):
    return _sql(spark, sf, "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = 'MACHINERY' GROUP BY n.n_name", "customer", "nation")


@query("SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_mktsegment = 'BUILDING'")
def search_cte(spark, sf):
    return _sql(spark, sf, "WITH x AS (SELECT c_custkey, c_mktsegment AS seg FROM customer) SELECT c_custkey, seg FROM x WHERE seg = 'BUILDING'", "customer")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def search_union(spark, sf):
    text = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'FURNITURE'"
    return _sql(spark, sf, text, "customer")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) / 50 FROM customer WHERE c_mktsegment = 'BUILDING')")
def search_having(spark, sf):
    text = "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) / 50 FROM customer WHERE c_mktsegment = 'BUILDING')"
    return _sql(spark, sf, text, "customer")


# -- refusals, counted


def _refused(opened: DataFrame, column: str) -> DataFrame:
    return opened.agg(F.count(F.when(F.col(column).isNull(), 1)).alias("refused"), F.count("*").alias("n"))


@query("SELECT count(*) AS refused, count(*) AS n FROM customer")
def relocated_row_detected(spark, sf):
    t = sealed(spark, sf, "customer")
    moved = protector(spark).tag(t.withColumn("c_custkey", F.col("c_custkey") + 1), "customer")
    return _refused(protector(spark).open_df(moved, quiet=True), "c_mktsegment")


@query("SELECT count(*) AS refused, count(*) AS n FROM lineitem")
def relocated_column_detected(spark, sf):
    t = sealed(spark, sf, "lineitem", "l_returnflag")
    moved = t.select(F.col("l_returnflag").alias("l_linestatus"))
    return _refused(protector(spark).open_df(protector(spark).tag(moved, "lineitem"), quiet=True), "l_linestatus")


@query("SELECT count(*) AS downgraded, 0::BIGINT AS opened FROM orders")
def strict_downgrade_count(spark, sf):
    lax = Policy(columns=[c for c in POLICY.columns if c.table == "orders"])
    t = materialized(protector(spark, lax).seal_df(plain(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "orders"), "orders")
    cell = F.substring(env.envelope_of(F.col("o_orderpriority")), 1, 4) == env.bytes_lit(env.CELL)
    try:
        protector(spark).open_df(protector(spark).tag(t, "orders")).write.format("noop").mode("overwrite").save()
        opened = F.count("*")
    except Exception as e:
        if not isinstance(E.translated(e), E.RowBindingDowngraded):
            raise
        opened = F.lit(0).cast("long")
    return t.agg(F.count(F.when(cell, 1)).alias("downgraded"), opened.alias("opened"))


def _legacy(p: Protector, df: DataFrame, column: str) -> DataFrame:
    """Values in the old format, as a test makes them: bound to their key only."""
    from cloakframe.sources.keys import secret_row

    t = df.join(F.broadcast(secret_row(p.spark, {"__i": OLD_ID, "__k": p.keys.key(OLD_ID)})))
    body = F.aes_encrypt(F.col(column).cast("binary"), F.col("__k"), F.lit("GCM"), F.lit("DEFAULT"), env.nonce(), F.col("__i"))
    return t.withColumn(column, F.concat(env.bytes_lit(env.LEGACY), F.col("__i"), body)).drop("__i", "__k")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def legacy_v1_opens(spark, sf):
    p = protector(spark)
    old = materialized(_legacy(p, plain(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"), "legacy")
    return p.open_text_df(p.tag(old, "customer"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def passthrough_plaintext(spark, sf):
    """Plain, null, old, and new values in one column."""
    p = protector(spark)
    some = plain(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    new = p.seal_df(some.where("c_custkey % 3 = 0"), "customer").select("c_custkey", "c_mktsegment")
    old = _legacy(p, some.where("c_custkey % 3 = 1"), "c_mktsegment")
    bare = some.where("c_custkey % 3 = 2").withColumn("c_mktsegment", F.col("c_mktsegment").cast("binary"))
    return p.open_text_df(p.tag(materialized(new.unionAll(old).unionAll(bare), "mixed"), "customer"))


@query("SELECT c_custkey, c_mktsegment, 'DBS3' AS magic FROM customer")
def reseal_rotates(spark, sf):
    p = protector(spark)
    old = materialized(_legacy(p, plain(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"), "legacy")
    new = materialized(p.reseal(old, "customer"), "customer")
    opened = p.open_text_df(p.tag(new, "customer"))
    return opened.join(new.select("c_custkey", F.substring(env.envelope_of(F.col("c_mktsegment")), 1, 4).cast("string").alias("magic")), "c_custkey")


@query("SELECT c_custkey, c_custkey::VARCHAR AS k, (-c_custkey)::VARCHAR AS negative, '42' AS padded FROM customer")
def row_key_canonical(spark, sf):
    one = lambda c, kind: row_key(c, kind).cast("string")
    return plain(spark, sf, "customer").select("c_custkey", one(F.col("c_custkey"), "long").alias("k"), one(-F.col("c_custkey"), "long").alias("negative"), one(F.concat(F.lit(" +00"), F.lit("42 "), F.when(F.col("c_custkey") < 0, "x").otherwise("")), "integer").alias("padded"))


# -- digits


@query("SELECT c_custkey, c_name FROM customer")
def fpe_roundtrip(spark, sf):
    t = materialized(protector(spark).seal_df(plain(spark, sf, "customer").select("c_custkey", "c_name"), "customer"), "fpe")
    return protector(spark).open_text_df(t, masked=False)


@query("SELECT c_custkey, length(c_name) AS n, regexp_replace(c_name, '[0-9]', '#', 'g') AS shape, true AS changed FROM customer")
def fpe_shape(spark, sf):
    t = plain(spark, sf, "customer").select("c_custkey", "c_name")
    held = t.withColumn("sealed", fpe.seal_digits(spark, F.col("c_name"), FPE_KEY))
    return held.select("c_custkey", F.char_length("sealed").cast("long").alias("n"), F.regexp_replace("sealed", "[0-9]", "#").alias("shape"), (F.col("sealed") != F.col("c_name")).alias("changed"))


# -- checks


CASES = (
    ("equal", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", ""),
    ("null_test", "SELECT c_custkey FROM customer WHERE c_mktsegment IS NULL", ""),
    ("mask_only", "SELECT p_partkey FROM part WHERE p_name LIKE 'a%'", ""),
    ("greater", "SELECT c_custkey FROM customer WHERE c_mktsegment > 'B'", "Predicate"),
    ("unequal", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'B'", "Predicate"),
    ("like", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%'", "Predicate"),
    ("between", "SELECT c_custkey FROM customer WHERE c_mktsegment BETWEEN 'A' AND 'B'", "Predicate"),
    ("distinct_from", "SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT DISTINCT FROM 'B'", "Predicate"),
    ("in_query", "SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT n_name FROM nation)", "Predicate"),
    ("in_mixed", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('A', upper('b'))", "Predicate"),
    ("in_rows", "SELECT c_custkey FROM customer WHERE (c_mktsegment, c_custkey) IN (('A', 1))", "Predicate"),
    ("any_array", "SELECT c_custkey FROM customer WHERE c_mktsegment = ANY(ARRAY['A', 'B'])", ""),
    ("any_array_function", "SELECT c_custkey FROM customer WHERE c_mktsegment = ANY(ARRAY['A', lower('B')])", "Predicate"),
    ("in_function", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('A', CAST(c_nationkey AS STRING))", "Predicate"),
    ("equal_function", "SELECT c_custkey FROM customer WHERE c_mktsegment = lower(CAST(c_nationkey AS STRING))", "Predicate"),
    ("not_searchable", "SELECT l_quantity FROM lineitem WHERE l_returnflag = 'R'", "UnindexedPredicate"),
    ("digits", "SELECT c_custkey FROM customer WHERE c_name = 'x'", "UnindexedPredicate"),
    ("token", "SELECT s_suppkey FROM supplier WHERE s_name = 'x'", "UnindexedPredicate"),
    ("computed", "SELECT lower(CAST(c_mktsegment AS STRING)) AS x FROM customer", "ComputedColumn"),
    ("computed_mask_only", "SELECT upper(p_name) AS x FROM part", "ComputedColumn"),
    ("counted", "SELECT count(c_mktsegment) AS n FROM customer", "ComputedColumn"),
    ("renamed", "SELECT c_mktsegment AS e FROM customer", ""),
    ("derived", "SELECT e FROM (SELECT c_mktsegment AS e FROM customer) WHERE e LIKE 'B%'", "Predicate"),
    ("join_on_sealed", "SELECT a.c_custkey FROM customer a JOIN part b ON a.c_mktsegment = b.p_brand", "Predicate"),
    ("ambiguous", "SELECT a.c_custkey FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey WHERE c_mktsegment = 'B'", "AmbiguousColumn"),
    ("having", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING c_mktsegment > 'B'", "Predicate"),
    ("no_columns", "INSERT INTO customer VALUES (1, 'a', 2, 3.0, 'b')", "NoColumnList"),
    ("from_select", "INSERT INTO customer (c_custkey, c_mktsegment) SELECT c_custkey, c_mktsegment FROM customer", "InsertFromSelect"),
    ("no_row_key", "INSERT INTO customer (c_mktsegment) VALUES ('b')", "RowKeyMissing"),
    ("merge", "MERGE INTO customer USING nation ON c_nationkey = n_nationkey WHEN MATCHED THEN DELETE", "Unsupported"),
    ("row_key_set", "UPDATE customer SET c_custkey = 3 WHERE c_custkey = 2", "RowKeyReassigned"),
    ("broken", "SELEC 1", "Unparseable"),
    ("insert_values", "INSERT INTO customer (c_custkey, c_mktsegment) VALUES (1, 'b')", ""),
    ("insert_function", "INSERT INTO customer (c_custkey, c_mktsegment) VALUES (1, upper('x'))", "UnsupportedValue"),
    ("insert_folded", "INSERT INTO Customer (C_CUSTKEY, C_MktSegment) VALUES (1, 'b')", ""),
    ("update_literal", "UPDATE customer SET c_mktsegment = 'b' WHERE c_custkey = 2", ""),
    ("update_many", "UPDATE customer SET c_mktsegment = 'b' WHERE c_nationkey = 2", "RowKeyMissing"),
    ("update_function", "UPDATE customer SET c_mktsegment = lower('b') WHERE c_custkey = 2", "UnsupportedValue"),
    ("update_range", "UPDATE customer SET c_acctbal = 1 WHERE c_mktsegment > 'b'", "Predicate"),
    ("delete_equal", "DELETE FROM customer WHERE c_mktsegment = 'b'", ""),
    ("delete_range", "DELETE FROM customer WHERE c_mktsegment > 'b'", "Predicate"),
    ("create_as", "CREATE TABLE made AS SELECT lower(CAST(c_mktsegment AS STRING)) AS x FROM customer", "ComputedColumn,CopyQuery"),
    ("view", "CREATE TEMP VIEW made AS SELECT * FROM customer WHERE c_mktsegment > 'b'", "Predicate"),
    ("truncate", "TRUNCATE TABLE customer", "Unsupported"),
    ("drop_other", "DROP TABLE made", ""),
    ("export", "INSERT OVERWRITE DIRECTORY '/tmp/made' USING parquet SELECT c_custkey, c_mktsegment FROM customer", "CopyQuery"),
    ("load", "LOAD DATA INPATH '/tmp/made' INTO TABLE customer", "Copy"),
    ("escapes", "SET spark.sql.parser.escapedStringLiterals = true", "EscapeStringsChanged"),
    ("moved", "USE other", "SearchPathChanged"),
)


def site_rows(spark, sf) -> list[tuple[str, str]]:
    front = ProtectedSql(protector(spark))
    for t in ("customer", "part", "lineitem", "supplier"):
        front.register(protector(spark).seal_df(plain(spark, sf, t), t), t)
    plain(spark, sf, "nation").createOrReplaceTempView("nation")
    out = []
    for name, text, _ in CASES:
        out.append((name, ",".join(sorted({s.kind for s in front.check(text).sites}))))
    return out


@query(f"SELECT * FROM (VALUES {', '.join(f"('{n}', '{s}')" for n, _, s in CASES)}) AS t(name, sites)")
def site_report(spark, sf):
    return spark.createDataFrame(site_rows(spark, sf), "name string, sites string")


REFUSALS = {
    "duplicate_column": lambda: Policy([ColumnPolicy("users", "a"), ColumnPolicy("public.users", "a")]),
    "searchable_token": lambda: Policy([ColumnPolicy("users", "a", transform="token", searchable=True)]),
    "detokenize_encrypt": lambda: Policy([ColumnPolicy("users", "a", detokenize=False)]),
    "none_without_mask": lambda: Policy([ColumnPolicy("users", "a", transform="none")]),
    "long_identifier": lambda: Policy([ColumnPolicy("users", "a" * 64)]),
    "duplicate_table": lambda: Policy([ColumnPolicy("users", "a")], [TablePolicy("users", "id"), TablePolicy("public.users", "id")]),
    "row_key_nothing": lambda: Policy([], [TablePolicy("users", "id")]),
    "row_key_no_encrypt": lambda: Policy([ColumnPolicy("users", "a", transform="token")], [TablePolicy("users", "id")]),
    "row_key_sealed": lambda: Policy([ColumnPolicy("users", "a")], [TablePolicy("users", "a")]),
    "row_key_masked": lambda: Policy([ColumnPolicy("users", "a"), ColumnPolicy("users", "id", transform="none", mask=Mask(1))], [TablePolicy("users", "id")]),
    "unknown_field": lambda: Policy.from_toml('[[column]]\ntable = "users"\ncolumn = "a"\ncolour = "red"\n'),
    "good": lambda: Policy.from_toml('[[column]]\ntable = "users"\ncolumn = "a"\nsearchable = true\nmask = { keep_last = 4 }\n[[table]]\ntable = "users"\nrow_key = "id"\n'),
}


@query(f"SELECT * FROM (VALUES {', '.join(f"('{n}', {'false' if n in ('row_key_masked', 'good') else 'true'})" for n in REFUSALS)}) AS t(name, refused)")
def policy_refusals(spark, sf):
    rows = []
    for name, make in REFUSALS.items():
        try:
            make()
            rows.append((name, False))
        except E.PolicyError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


# -- writes


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rows(spark, sf):
    p, t = protector(spark), sealed(spark, sf, "customer", "c_custkey", "c_mktsegment")
    changes = plain(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"))
    return p.open_text_df(materialized(update_by_key(p, t, changes, "customer"), "updated"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'NEW'")
def upsert_rows(spark, sf):
    p, t = protector(spark), sealed(spark, sf, "customer", "c_custkey", "c_mktsegment")
    rows = plain(spark, sf, "customer").where("c_custkey % 5 = 0").select("c_custkey").unionAll(spark.range(1).select(F.lit(-1).cast("long"))).withColumn("c_mktsegment", F.lit("NEW"))
    return p.open_text_df(materialized(upsert_by_key(p, t, rows, "customer"), "upserted"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_seal_count(spark, sf):
    """A stream of events sealed to files, and those files opened as a stream's batch."""
    p, path = protector(spark), scratch_path(spark, "stream")
    source = f"{path}/in"
    plain(spark, sf, "events").select("event_id", "event_type", "props").write.parquet(source)
    stream = spark.readStream.schema("event_id long, event_type string, props string").parquet(source)
    write_available(seal_stream(p, stream, "events"), f"{path}/out", f"{path}/state").awaitTermination()
    opened = open_stream(p, spark.read.parquet(f"{path}/out"), "events")
    return opened.groupBy(F.col("event_type").cast("string").alias("event_type")).agg(F.count("*").alias("n"))


# -- statements that write


def _written(spark, sf, *statements, parity=False, args=None, on="reject"):
    """customer as a stored table, after some statements."""
    policy = Policy(POLICY.columns, POLICY.tables, on_unprotected=on)
    p = protector(spark, policy)
    table = StoredTable(p, "customer", scratch_path(spark, "customer"))
    table.append(plain(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    front = ProtectedSql(p, parity)
    front.register_table(table)
    for text in statements:
        front.sql(text, args)
    return p, table, front


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer UNION ALL SELECT * FROM (VALUES (-1, 'SECRET ONE', 7), (-2, 'it''s two', NULL), (-3, NULL, 9)) AS t(a, b, c)")
def sql_insert_values(spark, sf):
    text = "INSERT INTO customer (c_custkey, C_MktSegment, c_nationkey) VALUES (-1, 'SECRET ONE', 7), (-2, :two, NULL), (-3, NULL, 9)"
    _, _, front = _written(spark, sf, text, parity=True, args={"two": "it's two"})
    return front.sql("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")


@query("SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def sql_insert_select(spark, sf):
    _, _, front = _written(spark, sf, "INSERT INTO customer (c_custkey, c_mktsegment) SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey < 0")
    opened = front.sql("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_mktsegment")
    front.tables["customer"].append(opened)
    front.register_table(front.tables["customer"])
    return front.sql("SELECT c_custkey, c_mktsegment FROM customer")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (1, 5) THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer")
def sql_update_by_key(spark, sf):
    _, _, front = _written(spark, sf, "UPDATE customer SET c_mktsegment = 'CHANGED' WHERE c_custkey = 1", "UPDATE customer SET c_mktsegment = :v WHERE c_custkey = 5", parity=True, args={"v": "CHANGED"})
    return front.sql("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')")
def sql_update_delete_by_index(spark, sf):
    _, _, front = _written(spark, sf, "UPDATE customer SET c_mktsegment = 'BUILT', c_nationkey = c_nationkey + 1 WHERE c_mktsegment = 'BUILDING'", "DELETE FROM customer AS c WHERE c.c_mktsegment IN ('MACHINERY', 'FURNITURE')")
    return front.sql("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")


WRITES = (
    ("computed", "INSERT INTO customer (c_custkey, c_mktsegment) VALUES (-1, upper('leak'))", "UnsupportedValue"),
    ("no_columns", "INSERT INTO customer VALUES (-1, 'leak', 1, 'leak', 'leak')", "NoColumnList"),
    ("no_key", "INSERT INTO customer (c_mktsegment) VALUES ('leak')", "RowKeyMissing"),
    ("update_key", "UPDATE customer SET c_custkey = -1 WHERE c_custkey = 1", "RowKeyReassigned"),
    ("merge", "MERGE INTO customer USING nation ON c_nationkey = n_nationkey WHEN MATCHED THEN DELETE", "Unsupported"),
    ("truncate", "TRUNCATE TABLE customer", "Unsupported"),
    ("range", "DELETE FROM customer WHERE c_mktsegment > 'B'", "Predicate"),
    ("stored", "INSERT INTO customer (c_custkey, c_mktsegment) VALUES (-1, 'kept')", "sealed"),
)


@query(f"SELECT * FROM (VALUES {', '.join(f"('{n}', '{s}')" for n, _, s in WRITES)}) AS t(name, outcome)")
def write_sites(spark, sf):
    """What becomes of statements that write: refused with a site, or stored sealed; no plain value is in any stored column after all of them."""
    plain(spark, sf, "nation").createOrReplaceTempView("nation")
    _, table, front = _written(spark, sf)
    n, rows = table.read().count(), []
    for name, text, _ in WRITES:
        try:
            front.sql(text)
            bare = table.read().where(env.envelope_of(F.col("c_mktsegment")).isNull() & F.col("c_mktsegment").isNotNull()).count()
            rows.append((name, "sealed" if bare == 0 and table.read().count() == n + 1 else "plain"))
        except E.Unprotected as e:
            rows.append((name, ",".join(sorted({s.kind for s in e.sites})) if table.read().count() == n else "written"))
    return spark.createDataFrame(rows, "name string, outcome string")


@query("SELECT a.c_custkey, a.c_mktsegment, b.c_custkey AS other_key, b.c_mktsegment AS other FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey - 1")
def search_self_join(spark, sf):
    """Both sides of a self-join are opened, each with the row key of its own side."""
    return _sql(spark, sf, "SELECT a.c_custkey, a.c_mktsegment, b.c_custkey AS other_key, b.c_mktsegment AS other FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey - 1", "customer")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')")
def search_any_sql(spark, sf):
    text = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = ANY(ARRAY['1-URGENT', '2-HIGH']) OR o_orderpriority = ANY(:more) OR array_contains(array('2-HIGH'), o_orderpriority)"
    return _sql(spark, sf, text, "orders", args={"more": ["5-LOW", None]})


class DictStore:
    """A key store in memory, for tests."""

    def __init__(self):
        self.data, self.index = {}, {}

    def read_data_key(self, key_id):
        return self.data.get(key_id)

    def create_data_key(self):
        key_id = bytes([len(self.data) + 1]) * 16
        self.data[key_id] = bytes([len(self.data) + 7]) * 32
        return key_id, self.data[key_id]

    def read_index_key(self, name):
        return self.index.get(name)

    def create_index_key(self, name, record):
        return self.index.setdefault(name, record) is record

    def read_legacy_index_keys(self):
        return None


@query("SELECT c_custkey, c_mktsegment FROM customer")
def store_reopen(spark, sf):
    """Rows sealed by two sessions of a key store, with a key each, opened by a third one that has no key yet."""
    store, rows = DictStore(), plain(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    parts = [Protector(spark, POLICY, StoreKeys(store)).seal_df(rows.where(f"c_custkey % 2 = {i}"), "customer") for i in (0, 1)]
    stored = materialized(parts[0].unionByName(parts[1]), "store")
    p = Protector(spark, POLICY, StoreKeys(store))
    return p.open_text_df(p.tag(stored, "customer"))


@query("SELECT 'values' AS what, 2 * count(*) AS n FROM lineitem UNION ALL SELECT 'refused', 1 UNION ALL SELECT 'keys', 2")
def budget_counts(spark, sf):
    """What seal_df books without being told how many rows there are; the key that is refused or rolled before it would go over."""
    rows = plain(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    p = protector(spark)
    p.seal_df(rows, "lineitem")
    booked, refused = sum(p.budget.used.values()), 0
    try:
        Protector(spark, POLICY, keys(), Budget(limit=10)).seal_df(rows, "lineitem")
    except E.KeyExhausted:
        refused = 1
    rolled = StoreKeys(DictStore())
    twice = Protector(spark, POLICY, rolled, Budget(limit=booked + 1))
    twice.seal_df(rows, "lineitem"), twice.seal_df(rows, "lineitem")
    return spark.createDataFrame([("values", booked), ("refused", refused), ("keys", len(rolled.data))], "what string, n long")


@query("SELECT a.s_suppkey, count(*) AS n FROM supplier a JOIN supplier b ON a.s_name = b.s_name GROUP BY a.s_suppkey")
def join_on_shared_token(spark, sf):
    """Tokens of two columns whose policies name one key."""
    policy = Policy([ColumnPolicy("supplier", "s_name", transform="token", key="names"), ColumnPolicy("copy", "name", transform="token", key="names")])
    p = Protector(spark, policy, MemoryKeys(KEY_ID, {KEY_ID: Key(b"\x07" * 32)}, {"names": Key(TOKEN_KEY)}))
    a = p.seal_df(plain(spark, sf, "supplier").select("s_suppkey", "s_name"), "supplier")
    b = p.seal_df(plain(spark, sf, "supplier").select(F.col("s_name").alias("name")), "copy").groupBy("name").agg(F.count("*").alias("n"))
    return a.join(b, a.s_name == b.name).groupBy("s_suppkey").agg(F.sum("n").alias("n"))


# -- relational operators over opened columns


def _opened(spark, sf, name, *columns):
    return protector(spark).open_text_df(sealed(spark, sf, name, *columns), masked=False)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, round(max(c_acctbal), 2) AS most FROM customer GROUP BY c_mktsegment")
def open_then_agg(spark, sf):
    t = _opened(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return t.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.round(F.max("c_acctbal"), 2).alias("most"))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer")
def open_then_window(spark, sf):
    t = _opened(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return t.select("c_custkey", "c_mktsegment", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("k"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def open_then_topk(spark, sf):
    p = protector(spark)
    return p.open_text_df(sealed(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25))


@query("SELECT c_mktsegment AS v FROM customer WHERE c_acctbal > 0 INTERSECT SELECT c_mktsegment FROM customer WHERE c_acctbal < 0 UNION SELECT p_brand FROM part")
def open_then_setop(spark, sf):
    c, p = _opened(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), _opened(spark, sf, "part", "p_partkey", "p_brand")
    both = c.where("c_acctbal > 0").select(F.col("c_mktsegment").alias("v")).intersect(c.where("c_acctbal < 0").select("c_mktsegment"))
    return both.union(p.select("p_brand")).distinct()


@query("SELECT c_mktsegment, c_nationkey::VARCHAR AS nation, count(*) AS n, grouping(c_mktsegment)::BIGINT AS g FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())")
def open_then_grouping_sets(spark, sf):
    _opened(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey").createOrReplaceTempView("opened_customer")
    return spark.sql("SELECT c_mktsegment, cast(c_nationkey AS string) AS nation, count(*) AS n, cast(grouping(c_mktsegment) AS bigint) AS g FROM opened_customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())")


@query("SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1, 2")
def open_then_join(spark, sf):
    c, o = sealed(spark, sf, "customer", "c_custkey", "c_mktsegment"), sealed(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    # grouped by blind indexes, so that one value of each group is opened and not one of each order
    by_index = c.join(o, c.c_custkey == o.o_custkey).groupBy(index_column("c_mktsegment"), index_column("o_orderpriority"))
    first = by_index.agg(F.count("*").alias("n"), F.min_by(F.struct("c_custkey", "c_mktsegment"), "c_custkey").alias("a"), F.min_by(F.struct("o_orderkey", "o_orderpriority"), "o_orderkey").alias("b"))
    left, right = protector(spark).tag(first.select("n", "a.*", "b.*"), "customer"), protector(spark)
    return right.open_text_df(right.tag(left, "orders")).groupBy("c_mktsegment", "o_orderpriority").agg(F.sum("n").alias("n"))


@query("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def open_then_anti_join(spark, sf):
    p, c, o = protector(spark), sealed(spark, sf, "customer", "c_custkey", "c_mktsegment"), sealed(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return c.join(o.where(p.matches(o, "orders.o_orderpriority", "1-URGENT")), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT a.p_brand, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand GROUP BY a.p_brand")
def join_on_index(spark, sf):
    """An equi-join on blind indexes: both sides share the column's key, so nothing is opened before the join."""
    t = sealed(spark, sf, "part", "p_partkey", "p_brand")
    left = t.groupBy(index_column("p_brand")).agg(F.count("*").alias("a"), F.min_by("p_brand", "p_partkey").alias("p_brand"), F.min("p_partkey").alias("p_partkey"))
    right = t.groupBy(F.col(index_column("p_brand")).alias("__other")).agg(F.count("*").alias("b"))
    both = left.join(right, F.col(index_column("p_brand")) == F.col("__other")).select("p_partkey", "p_brand", (F.col("a") * F.col("b")).alias("n"))
    return protector(spark).open_text_df(protector(spark).tag(both, "part")).select("p_brand", "n")


@query("SELECT e.event_id, e.event_type, max(o.o_orderdate)::TIMESTAMP AS last_order FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id, e.event_type")
def open_then_as_of_join(spark, sf):
    """Both tables in one, and of each event the last order on the way to it: one window over users, in blocks of time so that a hot user is many groups. What a block
    begins with is the last order of the blocks before it, of which there is one row a block."""
    e = sealed(spark, sf, "events", "event_id", "ts", "user_id", "event_type").select("event_id", "event_type", F.col("user_id").alias("who"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("timestamp").alias("ordered"))
    o = plain(spark, sf, "orders").select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("binary").alias("event_type"), F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderdate").cast("timestamp").alias("ordered"))
    both = e.unionByName(o).withColumn("block", F.date_trunc("month", "at"))
    before = Window.partitionBy("who").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = materialized(both.groupBy("who", "block").agg(F.max("ordered").alias("last")).select("who", "block", F.max("last").over(before).alias("start")), "starts")
    inside = Window.partitionBy("who", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.join(start, ["who", "block"]).withColumn("last_order", F.coalesce(F.max("ordered").over(inside), "start")).where("event_id IS NOT NULL AND last_order IS NOT NULL")
    tagged = protector(spark).tag(found.select("event_id", "event_type", "last_order"), "events")
    return protector(spark).open_text_df(tagged).select("event_id", "event_type", "last_order")


@query("SELECT c_mktsegment, c_nationkey::VARCHAR AS nation, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def open_then_cube(spark, sf):
    t = _opened(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return t.cube("c_mktsegment", F.col("c_nationkey").cast("string").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_custkey::VARCHAR AS customer, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_custkey)")
def open_then_rollup(spark, sf):
    t = _opened(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return t.rollup("o_orderpriority", F.col("o_custkey").cast("string").alias("customer")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, c_mktsegment, sum(c_nationkey) OVER w AS near, lag(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS before FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def open_then_frames(spark, sf):
    t = _opened(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    w = Window.partitionBy("c_mktsegment").orderBy("c_custkey")
    return t.select("c_custkey", "c_mktsegment", F.sum("c_nationkey").over(w.rowsBetween(-2, 0)).alias("near"), F.lag("c_custkey").over(w).alias("before"))


@query("SELECT c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_orderpriority FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'")
def open_then_outer_join(spark, sf):
    """The condition on the sealed column is answered by its index inside the join; rows without a partner have null row keys and null values."""
    p, c, o = protector(spark), sealed(spark, sf, "customer", "c_custkey", "c_mktsegment"), sealed(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    both = c.join(o, (c.c_custkey == o.o_custkey) & p.matches(c, "customer.c_mktsegment", "BUILDING"), "full")
    return p.open_text_df(both.select("c_custkey", "c_mktsegment", "o_orderkey", "o_orderpriority"))


@query("SELECT a.p_partkey, a.p_brand, count(b.p_partkey) AS cheaper FROM part a LEFT JOIN part b ON b.p_size BETWEEN a.p_size - 2 AND a.p_size - 1 GROUP BY 1, 2")
def open_then_range_join(spark, sf):
    """A band join over opened rows: sizes are counted once and each part looks up the sizes in its band, so no pair of parts is made."""
    t = _opened(spark, sf, "part", "p_partkey", "p_brand", "p_size")
    sizes = t.groupBy("p_size").agg(F.count("*").alias("n"))
    band = sizes.select(F.explode(F.array(F.col("p_size") + 1, F.col("p_size") + 2)).alias("of"), "n").groupBy("of").agg(F.sum("n").alias("n"))
    return t.join(band, F.col("p_size") == F.col("of"), "left").select("p_partkey", "p_brand", F.coalesce("n", F.lit(0)).alias("cheaper"))


@query("SELECT c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o")
def open_then_lateral_join(spark, sf):
    """The two dearest orders of each customer: what LATERAL asks for, as a ranking window over orders."""
    c, o = sealed(spark, sf, "customer", "c_custkey", "c_mktsegment"), plain(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    first = o.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("k <= 2")
    return protector(spark).open_text_df(c.join(first, c.c_custkey == first.o_custkey).select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice"))
