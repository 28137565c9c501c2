"""Statements that write, checks that run nothing, keys of stores, budgets, self-joins, single columns, transforms of one's own."""

import pathlib

import pytest
from pyspark.sql import functions as F

from cloakframe import errors as E, queries as Q
from cloakframe.functions import envelope as env
from cloakframe.functions.mask import Mask
from cloakframe.operators import policy as policies
from cloakframe.operators.policy import ColumnPolicy, Policy, TablePolicy
from cloakframe.operators.protector import Protector
from cloakframe.plans.front import ProtectedSql, with_lists
from cloakframe.plans.text import operand_before, tokens
from cloakframe.sources import scratch
from cloakframe.sources.keys import Budget, Key, MemoryKeys, StoreKeys
from cloakframe.sources.scratch import materialized
from cloakframe.sources.tables import StoredTable
from cloakframe.streaming.sealed import seal_stream

COLUMNS = [ColumnPolicy("users", "email", searchable=True, mask=Mask(keep_last=2)), ColumnPolicy("users", "phone", transform="fpe"), ColumnPolicy("users", "tag", transform="token")]
ROWS = [(1, "a@x", "555-123-4567", "t1", 5), (2, "b@x", "555-999-4567", "t2", 6), (3, None, None, None, None)]
SCHEMA = "id long, email string, phone string, tag string, age int"


def keys():
    return MemoryKeys(b"1" * 16, {b"1" * 16: Key(b"k" * 32)}, {f"public.users.{c}": Key(c.encode().ljust(32, b"x")) for c in ("email", "phone", "tag")})


@pytest.fixture
def made(spark, tmp_path):
    """A stored table, its SQL front under `reject`, and the folder of its files."""

    def make(parity=False, on="reject"):
        p = Protector(spark, Policy(COLUMNS, [TablePolicy("users", "id")], on_unprotected=on), keys())
        table = StoredTable(p, "users", str(tmp_path / "users"))
        table.append(spark.createDataFrame(ROWS, SCHEMA))
        front = ProtectedSql(p, parity)
        front.register_table(table)
        return front, table

    return make


def rows(front, columns="id, email, age"):
    opened = front.protector.open_text_df(front.stored(f"SELECT {columns} FROM users ORDER BY id"), masked=False)
    return sorted((tuple(r) for r in opened.collect()), key=lambda r: r[0])


def test_insert_seals(made, tmp_path):
    front, table = made(parity=True)
    front.sql("INSERT INTO users (id, Email, phone) VALUES (4, 'very secret', '555-000-1111'), (5, :e, NULL), (6, r'\\x6162', NULL)", {"e": "it's; DROP"})
    assert rows(front)[3:] == [(4, "very secret", None), (5, "it's; DROP", None), (6, "ab", None)]
    files = b"".join(f.read_bytes() for f in pathlib.Path(tmp_path).rglob("*.parquet"))
    assert b"very secret" not in files and b"it's; DROP" not in files and b"555-000-1111" not in files
    assert table.read().where(env.envelope_of(F.col("email")).isNull() & F.col("email").isNotNull()).count() == 0
    assert [r["email"] for r in front.sql("SELECT id, email FROM users WHERE email = 'very secret'").collect()] == ["*********et"]


def test_update_and_delete(made):
    front, table = made()
    front.sql("UPDATE users SET email = 'new', age = age + 1 WHERE email IN ('a@x', 'none') OR id = 3")
    assert rows(front) == [(1, "new", 6), (2, "b@x", 6), (3, "new", None)]
    front.sql("UPDATE users AS u SET u.email = NULL, phone = '555-111-2222' WHERE u.id = :id", {"id": 2})
    assert rows(front, "id, email, phone")[1] == (2, None, "555-111-2222")
    front.sql("DELETE FROM users WHERE email = 'new' AND id < 2")
    assert [r[0] for r in rows(front)] == [2, 3]
    assert front.sql("SELECT id, email FROM users WHERE email = 'a@x'").count() == 0
    front.sql("UPDATE users SET email = 'all'")
    assert {r[1] for r in rows(front)} == {"all"}
    assert len(table._versions()) == 5
    table.vacuum()
    assert len(table._versions()) == 1 and table.read().count() == 2
    front.sql("DELETE FROM users")
    assert rows(front) == []


def test_conditions_that_are_no_index_are_refused_before_anything_changes(made):
    front, table = made(on="warn")
    before = sorted(map(str, table.read().collect()))
    for text in ("UPDATE users SET email = upper('x') WHERE id = 1", "INSERT INTO users (id, email) VALUES (9, concat('a', 'b'))", "INSERT INTO users VALUES (9, 'a', 'b', 'c', 1)", "INSERT INTO users (email) VALUES ('a')", "UPDATE users SET id = 9 WHERE id = 1", "TRUNCATE TABLE users", "INSERT OVERWRITE users (id, email) VALUES (9, 'a')", "WITH a AS (SELECT 9 AS x) INSERT INTO users (id) SELECT x FROM a", "EXECUTE IMMEDIATE 'DELETE FROM users'"):
        with pytest.raises(E.Unprotected):
            front.sql(text)
    assert sorted(map(str, table.read().collect())) == before


def test_read_only_views_refuse_writes(spark, made):
    front, table = made()
    other = ProtectedSql(front.protector, parity=False)
    other.register(table.read(), "users")
    with pytest.raises(E.Unprotected):
        other.sql("DELETE FROM users WHERE id = 1")


def test_check_runs_nothing(spark, made, tmp_path):
    front, table = made()
    spark.sql("CREATE TABLE kept USING parquet AS SELECT 1 AS x")
    try:
        n = table.read().count()
        for text in ("DROP TABLE kept", "CREATE TABLE made_up AS SELECT 1 AS x", "CREATE TEMP VIEW made_up AS SELECT * FROM users", "DELETE FROM users", "INSERT INTO users (id, email) VALUES (9, 'x')", "INSERT INTO kept VALUES (2)", "SET a.b = 1", f"INSERT OVERWRITE DIRECTORY '{tmp_path}/out' USING parquet SELECT id FROM users"):
            front.check(text)
        assert spark.catalog.tableExists("kept") and not spark.catalog.tableExists("made_up") and spark.table("kept").count() == 1
        assert table.read().count() == n and not (tmp_path / "out").exists() and spark.conf.get("a.b", None) is None
        assert {s.kind for s in front.check("CREATE TABLE x AS SELECT lower(CAST(email AS STRING)) AS e FROM users").sites} == {"ComputedColumn", "CopyQuery"}
        front.sql("DROP TABLE kept")
        assert not spark.catalog.tableExists("kept")
    finally:
        spark.sql("DROP TABLE IF EXISTS kept")


def test_order_outlives_opening(made):
    front, _ = made()
    front.sql("INSERT INTO users (id, email) VALUES (9, 'z'), (8, 'y'), (7, 'x'), (-1, 'w')")
    assert [r["id"] for r in front.sql("SELECT id, email FROM users ORDER BY id DESC").collect()] == [9, 8, 7, 3, 2, 1, -1]
    assert [r["id"] for r in front.sql("SELECT id, email FROM users ORDER BY id LIMIT 2").collect()] == [-1, 1]


def test_lists(made):
    front, _ = made(parity=True)
    got = lambda text, args=None: sorted(r["id"] for r in front.sql(f"SELECT id, email FROM users WHERE {text}", args).collect())
    assert got("email = ANY(ARRAY['a@x', 'b@x'])") == got("email = any (:v)", {"v": ["a@x", None, "b@x"]}) == got("array_contains(array('b@x', 'a@x'), email)") == [1, 2]
    assert got("email = ANY(:v)", {"v": []}) == [] and got("email = ANY(:v) OR id = :id", {"v": ["x') OR true --"], "id": 3}) == [3]
    with pytest.raises(E.ArrayTooLong):
        front.check("SELECT id FROM users WHERE email = ANY(:v)", {"v": ["x"] * 65537})
    assert {s.kind for s in front.check("SELECT id FROM users WHERE email = ANY(ARRAY['a', lower('B')])").sites} == {"Predicate"}
    assert {s.kind for s in front.check("SELECT id FROM users WHERE (email, id) IN (('a@x', 1))").sites} == {"Predicate"}


def test_one_parameter_in_two_roles(made):
    """The text is rewritten at each place, so a parameter may be a search term here and a plain value there."""
    front, _ = made()
    assert [r["id"] for r in front.sql("SELECT id, email, :p AS p FROM users WHERE email = :p AND :p <> 'b'", {"p": "a@x"}).collect()] == [1]


def test_tokens():
    text = "a.`b c` NOT IN ('x)', \"y\") -- (\n AND f(a.b) IN (1) /* ) */"
    assert [t.text for t in tokens("x = 'it''s' -- z")] == ["x", "=", "'it''s'"]
    assert operand_before(text, text.index("NOT")) == 0
    assert text[operand_before(text, text.index("IN (1)")) :].startswith("f(a.b)")
    assert with_lists("SELECT '= ANY(ARRAY[1])'", None) == ("SELECT '= ANY(ARRAY[1])'", {})


def test_self_join(spark, made):
    front, _ = made()
    got = front.sql("SELECT a.id, a.email, b.id AS other, b.email AS theirs FROM users a JOIN users b ON a.age = b.age - 1")
    assert [tuple(r) for r in got.collect()] == [(1, "*@x", 2, "*@x")]
    with pytest.raises(E.AmbiguousRowKey):
        front.sql("SELECT a.id, a.id AS again, a.email FROM users a")
    with pytest.raises(Exception) as e:
        front.sql("SELECT a.id, a.email, b.email AS theirs FROM users a JOIN users b ON a.age = b.age - 1").collect()
    assert isinstance(E.translated(e.value), E.RowKeyMissing)


def test_store_opens_in_a_new_session(spark):
    store = Q.DictStore()
    policy = Policy(COLUMNS[:1], [TablePolicy("users", "id")])
    first = Protector(spark, policy, StoreKeys(store))
    stored = materialized(first.seal_df(spark.createDataFrame(ROWS, SCHEMA).select("id", "email"), "users"), "store")
    second = Protector(spark, policy, StoreKeys(store))
    assert {r["email"] for r in second.open_text_df(stored, masked=False).collect()} == {"a@x", "b@x", None}
    store.data.clear()
    with pytest.raises(E.UnknownKey):
        Protector(spark, policy, StoreKeys(store)).open_df(stored)


def test_budget_is_always_booked(spark, tmp_path):
    policy = Policy([ColumnPolicy("t", "a"), ColumnPolicy("t", "b")])
    df = spark.range(100).selectExpr("cast(id as string) a", "cast(id as string) b")
    p = Protector(spark, policy, keys())
    p.seal_df(df, "t")
    assert p.budget.used == {b"1" * 16: 200}
    with pytest.raises(E.KeyExhausted):
        Protector(spark, policy, keys(), Budget(limit=199)).seal_df(df, "t")
    rolled = Protector(spark, policy, StoreKeys(Q.DictStore()), Budget(limit=300))
    used = {rolled.seal_df(df, "t").select(env.key_id_of(F.col("a")).alias("k")).first()["k"] and rolled.keys.active for _ in range(2)}
    assert len(used) == 2
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in"))
    seal_stream(p, stream, "t")
    with pytest.raises(E.KeyExhausted):
        p.seal_df(df, "t")


def test_single_columns(spark):
    policy = Policy(COLUMNS, [TablePolicy("users", "id")])
    p = Protector(spark, policy, keys())
    df = p.keyed(spark.createDataFrame(ROWS, SCHEMA), "users.email", "users.phone", "users.tag", rows=3)
    kind = df.schema["id"].dataType
    sealed = p.unkeyed(df.select("*", p.seal_col("users.email", F.col("email"), F.col("id"), kind).alias("e"), p.seal_col("users.phone", F.col("phone")).alias("f"), p.seal_col("users.tag", F.col("tag")).alias("t")))
    again = p.keyed(materialized(sealed, "columns"), "users.email", rows=0)
    out = p.unkeyed(again.select("*", p.open_col("users.email", F.col("e"), F.col("id"), kind).cast("string").alias("e2"), p.open_col("users.phone", F.col("f")).alias("f2"), p.mask_col("users.email", F.col("email")).alias("m")))
    for r in out.collect():
        assert (r["e2"], r["f2"]) == (r["email"], r["phone"]) and (r["m"] is None) == (r["email"] is None) and r["t"] != r["tag"] or r["tag"] is None
    assert not [c for c in out.columns if c.startswith("__")]
    for call, error in ((lambda: p.seal_col("users.email", F.col("email")), E.RowKeyRequired), (lambda: p.open_col("users.tag", F.col("t")), E.NotReadable)):
        with pytest.raises(error):
            call()


class Shifted:
    """A transform of one's own: not a safe one."""

    stored_type, readable = "string", True

    def seal(self, plain, inner, outer):
        return F.concat(F.lower(F.hex(plain)), F.substring(F.hex(inner), 1, 4))

    def open(self, stored, inner, outer):
        return F.unhex(F.expr("1").cast("string")) if stored is None else F.unhex(F.substring(stored, F.lit(1), F.length(stored) - 4)).cast("string")


def test_own_transform(spark):
    policies.register_transform("shifted", Shifted())
    try:
        p = Protector(spark, Policy([ColumnPolicy("users", "tag", transform="shifted")]), keys())
        stored = materialized(p.seal_df(spark.createDataFrame(ROWS, SCHEMA).select("id", "tag"), "users"), "own")
        assert {r["tag"] for r in stored.collect()}.isdisjoint({"t1", "t2"})
        assert {r["tag"] for r in p.open_df(stored).collect()} == {"t1", "t2", None}
    finally:
        del policies.OWN["shifted"]
    with pytest.raises(E.PolicyError):
        policies.register_transform("token", Shifted())
    with pytest.raises(E.PolicyError):
        Policy([ColumnPolicy("users", "a", key="shared")])


def test_no_local_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())
