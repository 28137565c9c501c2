"""Single values: masks, identifiers, row keys, digits, policies, keys."""

import os

import pytest
from hypothesis import given, settings, strategies as st

from cloakframe import errors as E
from cloakframe.functions import fpe, ident, rowkey
from cloakframe.functions.envelope import hmac_bytes, pads, row_aad_bytes
from cloakframe.functions.mask import Mask
from cloakframe.operators.policy import ColumnPolicy, Policy, TablePolicy
from cloakframe.queries import REFUSALS
from cloakframe.sources.keys import Budget, Key, MemoryKeys, StoreKeys, generate_key_file, load_keys

NIST_KEY = bytes.fromhex("2B7E151628AED2A6ABF7158809CF4F3CEF4359D8D580AA4F7F036D6F04FC6A94")


def test_mask_vectors():
    assert Mask(keep_last=4).apply(b"4111111111111111") == b"************1111"
    assert Mask(2, 2).apply(b"secretive") == b"se*****ve"
    assert Mask(keep_last=4).apply(b"1234") == b"****" and Mask(3, 3).apply(b"abcde") == b"*****" and Mask().apply(b"") == b""
    assert Mask(keep_last=1).apply("héllo".encode()) == b"****o" and Mask().apply(b"\xff\xfeA") == b"***"


def test_identifiers():
    assert ident.fold("UsErS") == "users" and ident.fold("UsErS", quoted=True) == "UsErS" and ident.fold("ÉA") == "Éa"
    assert len(ident.fold("é" * 40).encode()) == 62
    assert ident.lookup_name("users.email") == "public.users.email" and ident.lookup_name("a.b.c") == "a.b.c"


@pytest.mark.parametrize(("text", "out"), [("42", "42"), ("0042", "42"), ("+42", "42"), (" 42 ", "42"), ("\t42\n", "42"), ("-0007", "-7")])
def test_row_key_integers(text, out):
    assert rowkey.canonical(text.encode(), "integer") == out.encode()


@pytest.mark.parametrize("text", ["4 2", "", "1_000", "0x2a", "2147483648"])
def test_row_key_refusals(text):
    with pytest.raises(E.RowKeyType):
        rowkey.canonical(text.encode(), "integer")


def test_row_key_uuid_and_text():
    want = b"550e8400-e29b-41d4-a716-446655440000"
    for text in ("550E8400-E29B-41D4-A716-446655440000", "{550e8400-e29b-41d4-a716-446655440000}", "550e8400e29b41d4a716446655440000", "  550e8400-e29b-41d4-a716-446655440000 "):
        assert rowkey.canonical(text.encode(), "uuid") == want
    assert rowkey.canonical(b" padded ", "text") == b" padded "


def test_row_aad_vector():
    assert row_aad_bytes(b"\xaa" * 16, "a.b.c", b"42").hex() == "aa" * 16 + "00000005" + b"a.b.c".hex() + "00000002" + b"42".hex()
    assert row_aad_bytes(b"\xaa" * 16, "a.b.c", b"42") != row_aad_bytes(b"\xaa" * 16, "a.b.c4", b"2")


def test_ff1_published_sample():
    assert fpe.transform(["0123456789"], NIST_KEY, False) == ["6657667009"]
    assert fpe.transform(["6657667009"], NIST_KEY, True) == ["0123456789"]


def test_aes_published_sample():
    schedule = fpe.expand_key(bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4"))
    block = fpe.aes_blocks(fpe._block(bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"))[None], schedule)
    assert block.astype(">u4").tobytes().hex() == "f3eed1bdb5d2a03c064b5a7e3db181f8"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789- aé", max_size=70))
def test_digits_round_trip(value):
    sealed = fpe.transform([value], NIST_KEY, False)[0]
    assert fpe.transform([sealed], NIST_KEY, True) == [value]
    assert [c for c in sealed if not "0" <= c <= "9"] == [c for c in value if not "0" <= c <= "9"] and len(sealed) == len(value)


def test_digits_domain():
    assert fpe.transform(["12345", "no digits here", None], NIST_KEY, False) == ["12345", "no digits here", None]
    with pytest.raises(E.FpeDomain):
        fpe.check_domain("12345")


@given(st.binary(min_size=1, max_size=100), st.binary(max_size=200))
@settings(max_examples=50, deadline=None)
def test_hmac_pads(key, value):
    import hashlib

    inner, outer = pads(key)
    assert hashlib.sha256(outer + hashlib.sha256(inner + value).digest()).digest() == hmac_bytes(key, value)


@pytest.mark.parametrize("name", sorted(REFUSALS))
def test_policies(name):
    if name in ("good", "row_key_masked"):
        REFUSALS[name]()
    else:
        with pytest.raises(E.PolicyError):
            REFUSALS[name]()


def test_policy_defaults():
    p = Policy.from_toml('on_unprotected = "reject"\n[[column]]\ntable = "users"\ncolumn = "email"\n[[column]]\ntable = "billing.cards"\ncolumn = "pin"\ntransform = "fpe"\ndetokenize = false\n')
    c = p.by_name["public.users.email"]
    assert (c.transform, c.searchable, c.detokenize, c.mask, c.stored_type) == ("encrypt", False, True, None, "binary")
    assert not p.by_name["billing.cards.pin"].readable and p.on_unprotected == "reject"
    assert Policy([ColumnPolicy("users", "email")], [TablePolicy("users", "id")]).row_keys().keys() == {"public.users"}


def test_key_files(tmp_path):
    path = str(tmp_path / "keys.toml")
    generate_key_file(path)
    assert os.stat(path).st_mode & 0o777 == 0o600
    key_id, key = load_keys(path).active_key()
    assert len(key_id) == 16 and len(key) == 32 and key.hex() not in repr(key)
    with pytest.raises(E.KeyFileWrite):
        generate_key_file(path)
    os.chmod(path, 0o644)
    with pytest.raises(E.SecretFileMode):
        load_keys(path)
    with pytest.raises(E.KeyFileRead):
        load_keys(str(tmp_path / "none"))


def test_active_key_must_exist():
    with pytest.raises(E.KeySourceError):
        MemoryKeys(b"\1" * 16, {})


class Store:
    def __init__(self):
        self.index, self.data, self.reads, self.lost_race, self.down = {}, {}, 0, None, False

    def read_data_key(self, key_id):
        if self.down:
            raise E.KeyBackend("down")
        self.reads += 1
        return self.data.get(key_id)

    def create_data_key(self):
        key_id = bytes([len(self.data) + 1]) * 16
        self.data[key_id] = b"k" * 32
        return key_id, self.data[key_id]

    def read_index_key(self, name):
        if self.down:
            raise E.KeyBackend("down")
        return self.index.get(name)

    def create_index_key(self, name, record):
        if self.lost_race:
            self.index[name] = self.lost_race
            return False
        self.index[name] = record
        return True

    def read_legacy_index_keys(self):
        return {"old": "ab" * 32}


def test_store_keys():
    store, now = Store(), [0.0]
    keys = StoreKeys(store, clock=lambda: now[0])
    first = keys.index_key("a")
    assert keys.index_key("a") == first == StoreKeys(store).index_key("a")
    assert keys.index_key("old").hex() == "ab" * 32
    store.lost_race = {"current": 1, "versions": {1: "cd" * 32}}
    assert keys.index_key("raced").hex() == "cd" * 32
    for _ in range(3):
        with pytest.raises(E.UnknownKey):
            keys.key(b"x" * 16)
    assert store.reads == 1
    now[0] = 61.0
    with pytest.raises(E.UnknownKey):
        keys.key(b"x" * 16)
    assert store.reads == 2
    store.down = True
    with pytest.raises(E.KeyBackend):
        keys.key(b"y" * 16)


def test_budget_rolls_and_refuses():
    store = StoreKeys(Store())
    budget = Budget(limit=10)
    first = budget.take(store, 6)
    assert budget.take(store, 4) == first and budget.take(store, 1) != first
    with pytest.raises(E.KeyExhausted):
        budget.take(store, 11)
    memory = MemoryKeys(b"\1" * 16, {b"\1" * 16: Key(b"k" * 32)})
    with pytest.raises(E.KeyExhausted):
        Budget(limit=1).take(memory, 2)
