"""Whole DataFrames: forms, bindings, refusals, search, SQL, plans without keys."""

import hmac

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cloakframe import errors as E, queries as Q
from cloakframe.functions import envelope as env, literals
from cloakframe.functions.mask import Mask, mask_binary
from cloakframe.functions.rowkey import row_key
from cloakframe.operators.policy import ColumnPolicy, Policy, TablePolicy
from cloakframe.operators.protector import Protector
from cloakframe.plans.front import ProtectedSql
from cloakframe.plans.sites import KINDS
from cloakframe.sources import tables
from cloakframe.sources.scratch import materialized
from tests.conftest import SF

POLICY = Policy([ColumnPolicy("users", "email", searchable=True), ColumnPolicy("users", "note", transform="none", mask=Mask(2)), ColumnPolicy("users", "ssn", transform="token"), ColumnPolicy("users", "phone", transform="fpe", mask=Mask(keep_last=2))], [TablePolicy("users", "id")])


@pytest.fixture(scope="module")
def keys():
    k = Q.keys()
    k.index.update({n: Q.Key(bytes([i]) * 32) for i, n in enumerate(("public.users.email", "public.users.ssn", "public.users.phone"), 3)})
    return k


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "a@x", "topsecret", "123", "+1 555-123-4567"), (2, None, None, None, None), (3, "", "ab", "", "555123"), (-4, "éè", "éèà", "9", "12-34-56-78")], "id long, email string, note string, ssn string, phone string")


@pytest.fixture(scope="module")
def stored(spark, users, keys):
    return materialized(Protector(spark, POLICY, keys).seal_df(users, "users"), "users")


def test_round_trip_and_masks(spark, users, stored, keys):
    p = Protector(spark, POLICY, keys)
    plain = {r["id"]: r for r in users.collect()}
    for r in p.open_text_df(stored, masked=False).collect():
        assert (r["email"], r["note"], r["phone"]) == tuple(plain[r["id"]][c] for c in ("email", "note", "phone"))
        want = plain[r["id"]]["ssn"]
        assert r["ssn"] == (None if want is None else hmac.new(keys.index_key("public.users.ssn"), want.encode(), "sha256").hexdigest())
    masked = {r["id"]: (r["note"], r["phone"]) for r in p.open_text_df(stored).collect()}
    assert masked[1] == ("to*******", "*************67") and masked[2] == (None, None) and masked[3][0] == "**"


def test_stored_forms(stored):
    for r in stored.where("email IS NOT NULL").collect():
        b = bytes(r["email"])
        assert b[:32] == bytes(r["__bidx_email"]) and b[32:36] == env.ROW and b[36:52] == Q.KEY_ID
    nonces = [bytes(r["email"])[52:64] for r in stored.where("email IS NOT NULL").collect()]
    assert len(set(nonces)) == 3


def test_literal_plaintext_gets_fresh_nonces(spark, keys):
    p = Protector(spark, Policy([ColumnPolicy("t", "v")]), keys)
    rows = p.seal_df(spark.range(50).select("id", F.lit("same").alias("v")), "t").collect()
    assert len({bytes(r["v"]) for r in rows}) == 50


def test_relocation_is_refused(spark, stored, keys):
    p = Protector(spark, POLICY, keys)
    moved = p.tag(stored.withColumn("id", F.col("id") + 1), "users")
    with pytest.raises(Exception) as e:
        p.open_df(moved).collect()
    assert isinstance(E.translated(e.value), E.Decrypt)


def test_row_key_must_be_in_the_result(spark, stored, keys):
    with pytest.raises(Exception) as e:
        Protector(spark, POLICY, keys).open_df(stored.select("email")).collect()
    assert isinstance(E.translated(e.value), E.RowKeyMissing)


def test_two_row_keys_are_ambiguous(spark, stored, keys):
    with pytest.raises(E.AmbiguousRowKey):
        Protector(spark, POLICY, keys).open_df(stored.select("id", F.col("id").alias("again"), "email"))


def test_unknown_key_and_ceiling(spark, stored, keys):
    p = Protector(spark, POLICY, keys)
    with pytest.raises(Exception) as e:
        p.open_df(stored, keys=[Q.OLD_ID]).collect()
    assert isinstance(E.translated(e.value), E.UnknownKey)
    small = Policy(POLICY.columns, POLICY.tables, max_protected_value_bytes=40)
    with pytest.raises(Exception) as e:
        Protector(spark, small, keys).open_df(stored).collect()
    assert isinstance(E.translated(e.value), E.ProtectedValueTooLarge)


def test_null_row_key(spark, keys):
    df = spark.createDataFrame([(None, "x")], "id long, email string")
    with pytest.raises(Exception) as e:
        Protector(spark, POLICY, keys).seal_df(df, "users").collect()
    assert isinstance(E.translated(e.value), E.RowKeyType)


def test_short_digits_are_refused_on_writing_and_pass_on_reading(spark, keys):
    p = Protector(spark, POLICY, keys)
    with pytest.raises(Exception) as e:
        p.seal_df(spark.createDataFrame([(1, "12345")], "id long, phone string"), "users").collect()
    assert isinstance(E.translated(e.value), E.FpeDomain)
    bare = p.tag(spark.createDataFrame([(1, "12345")], "id long, phone string"), "users")
    assert p.open_df(bare, masked=False).first()["phone"] == "12345"


def test_facade(spark, keys):
    p = Protector(spark, POLICY, keys)
    assert p.binds_row("users.email") and not p.binds_row("users.ssn")
    assert p.search_term("users.email", "a@x") == hmac.new(keys.index_key("public.users.email"), b"a@x", "sha256").digest()
    assert p.search_term("users.ssn", "1") is None
    for call, error in ((lambda: p.column("users.none"), E.UnknownColumn), (lambda: p.check_row("users.email", False), E.RowKeyRequired), (lambda: p.check_row("users.ssn", True), E.RowKeyNotDeclared)):
        with pytest.raises(error):
            call()


def test_strict_open_refuses_tokens(spark, stored, keys):
    with pytest.raises(E.NotReadable):
        Protector(spark, POLICY, keys).open_df(stored, lenient=False)


def test_types_are_checked(spark, keys):
    with pytest.raises(E.PolicyError):
        Protector(spark, POLICY, keys).seal_df(spark.createDataFrame([(1, 2.0)], "id long, email double"), "users")
    with pytest.raises(E.PolicyError):
        Protector(spark, POLICY, keys).tag(spark.createDataFrame([(1, "x")], "id long, email string"), "users")
    with pytest.raises(E.RowKeyType):
        Protector(spark, POLICY, keys).seal_df(spark.createDataFrame([(1.5, "x")], "id double, email string"), "users")


def test_no_key_in_plans(spark, users, stored, keys, capsys):
    p = Protector(spark, POLICY, keys)
    for df in (p.seal_df(users, "users"), p.open_df(stored)):
        df.explain(True)
        shown = capsys.readouterr().out + str(df.columns) + df._jdf.queryExecution().toString()
        for secret in (*keys.data.values(), *keys.index.values()):
            assert secret.hex() not in shown.lower() and str(list(secret)[:8])[1:-1] not in shown
            assert all(x.hex() not in shown.lower() for x in env.pads(secret))


def test_index_reaches_the_scan(spark, stored, keys, capsys):
    p = Protector(spark, POLICY, keys)
    stored.where(p.matches(stored, "users.email", "a@x")).explain("formatted")
    out = capsys.readouterr().out
    assert "EqualTo(__bidx_email" in out
    front = ProtectedSql(p)
    front.register(stored, "users")
    front.stored("SELECT id, email FROM users u WHERE u.email IN ('a@x', 'b')").explain("formatted")
    assert "In(__bidx_email" in capsys.readouterr().out


def test_index_without_companion(spark, stored, keys):
    p = Protector(spark, POLICY, keys)
    bare = p.tag(stored.drop("__bidx_email"), "users")
    assert [r["id"] for r in bare.where(p.matches(bare, "users.email", ["a@x", None])).collect()] == [1]


def test_masks_of_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfeA"),), (bytearray("héllo".encode()),), (None,)], "v binary")
    got = [r[0] for r in df.select(mask_binary(F.col("v"), Mask(keep_last=1))).collect()]
    assert [None if x is None else bytes(x) for x in got] == [b"***", b"****o", None]


def test_uuid_row_keys(spark):
    df = spark.createDataFrame([("{550E8400-E29B-41D4-A716-446655440000}",), (" 550e8400e29b41d4a716446655440000",)], "k string")
    assert {bytes(r[0]) for r in df.select(row_key(F.col("k"), "uuid")).collect()} == {b"550e8400-e29b-41d4-a716-446655440000"}
    with pytest.raises(Exception, match="RowKeyType"):
        spark.createDataFrame([("x",)], "k string").select(row_key(F.col("k"), "uuid")).collect()


def test_reject_refuses_the_statement(spark, stored, keys):
    strict = Policy(POLICY.columns, POLICY.tables, on_unprotected="reject")
    front = ProtectedSql(Protector(spark, strict, keys))
    front.register(stored, "users")
    with pytest.raises(E.Unprotected) as e:
        front.sql("SELECT id FROM users WHERE email LIKE 'secret%'")
    assert "secret" not in str(e.value) and {s.kind for s in e.value.sites} == {"Predicate"}
    assert [r["email"] for r in front.sql("SELECT id, email FROM users WHERE email = 'a@x'").collect()] == ["a@x"]


def test_sites(spark):
    got = dict(Q.site_rows(spark, SF))
    for name, _, want in Q.CASES:
        assert got[name] == ("Predicate" if name == "unequal" else want), name
    assert {k for v in got.values() for k in v.split(",")} - {"", "error"} <= set(KINDS)


def test_improved_sites(spark, stored, keys):
    front = ProtectedSql(Protector(spark, POLICY, keys), parity=False)
    front.register(stored, "users")
    assert {s.kind for s in front.check("SELECT email, count(*) AS n FROM users GROUP BY email ORDER BY email").sites} == {"SealedGrouping", "SealedOrdering"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_strict_reads_refuse_what_is_not_sealed(spark, stored, keys):
    p = Protector(spark, Policy([ColumnPolicy("users", "email", searchable=True)], [TablePolicy("users", "id")]), keys)
    mixed = p.tag(stored.select("id", "email").unionAll(spark.createDataFrame([(9, bytearray(b"plain")), (10, None)], "id long, email binary")), "users")
    assert p.open_df(mixed).count() == 6
    assert {r["email__kind"] for r in p.kinds_df(mixed).collect()} == {"value", "unprotected", None}
    with pytest.raises(Exception) as e:
        p.open_df(mixed, lenient=False).collect()
    assert isinstance(E.translated(e.value), E.Unprotected)
    p.open_df(mixed.where("id < 9 OR id = 10"), lenient=False).collect()


def test_literals(spark):
    assert literals.literal_bytes("\\x00ff", "binary") == b"\x00\xff" and literals.literal_bytes("\\x00ff", "string") == b"\\x00ff" and literals.literal_bytes("\\xzz", "binary") == b"\\xzz"
    df = spark.createDataFrame([("\\x00ff",), ("\\xz",), (None,)], "t string")
    rows = df.select(literals.literal_column(F.col("t"), "binary").alias("b"), literals.hex_text(literals.literal_column(F.col("t"), "binary")).alias("h")).collect()
    assert [None if r["b"] is None else bytes(r["b"]) for r in rows] == [b"\x00\xff", b"\\xz", None] and rows[0]["h"] == "\\x00ff"


def test_updates_of_the_sealed_table(spark, users, stored, keys, tmp_path):
    p = Protector(spark, POLICY, keys)
    tables.write_sealed(p, users, "users", str(tmp_path / "u"))
    back = tables.read_sealed(p, "users", str(tmp_path / "u"))
    changes = spark.createDataFrame([(1, "new@x")], "id long, email string")
    opened = {r["id"]: r["email"] for r in p.open_text_df(materialized(tables.update_by_key(p, back, changes, "users"), "u"), masked=False).collect()}
    assert opened == {1: "new@x", 2: None, 3: "", -4: "éè"}
    assert p.verify_df(back) == 4
