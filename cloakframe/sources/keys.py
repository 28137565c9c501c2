"""Keys: sources of them, and the one-row or few-row relations by which Spark gets them.

Everything here runs on the driver. Keys reach executors only as rows of a broadcast relation or in a broadcast variable; no plan,
explanation or column name shows one, and no repr does.
"""

from __future__ import annotations

import os
import secrets
import stat
import time
import tomllib
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from cloakframe import errors as E
from cloakframe.functions.envelope import BUDGET, KEY_ID, pads


class Key(bytes):
    """32 secret bytes that don't show."""

    def __new__(cls, value: bytes):
        if len(value) != 32:
            raise E.KeyFileParse("a key has 32 bytes")
        return super().__new__(cls, value)

    def __repr__(self) -> str:
        return "Key(..)"

    __str__ = __repr__


class KeySource(Protocol):
    def active_key(self) -> tuple[bytes, Key]: ...

    def key(self, key_id: bytes) -> Key: ...

    def keys(self) -> dict[bytes, Key]: ...

    def index_key(self, name: str) -> Key: ...


def _hex(text: str, size: int, what: str) -> bytes:
    try:
        out = bytes.fromhex(text)
    except (ValueError, TypeError) as e:
        raise E.KeyFileParse(f"{what} is not hex") from e
    if len(out) != size:
        raise E.KeyFileParse(f"{what} has not {size} bytes")
    return out


@dataclass
class MemoryKeys:
    """Keys in memory."""

    complete = True  #: keys() has every key that a stored value can name

    active: bytes
    data: dict[bytes, Key] = field(repr=False)
    index: dict[str, Key] = field(repr=False, default_factory=dict)

    def __post_init__(self):
        if self.active not in self.data:
            raise E.KeySourceError("the active key is not among the keys")

    def active_key(self) -> tuple[bytes, Key]:
        return self.active, self.data[self.active]

    def key(self, key_id: bytes) -> Key:
        if key_id not in self.data:
            raise E.UnknownKey(key_id.hex())
        return self.data[key_id]

    def keys(self) -> dict[bytes, Key]:
        return dict(self.data)

    def index_key(self, name: str) -> Key:
        if name not in self.index:
            raise E.KeySourceError(f"no index key is called {name}")
        return self.index[name]


def check_secret_file_mode(path: str) -> None:
    if os.name == "posix" and stat.S_IMODE(os.stat(path).st_mode) & 0o077:
        raise E.SecretFileMode(f"{path} can be read by others than its owner; its mode must be 0600")


def load_keys(path: str) -> MemoryKeys:
    """From a TOML file: active, [keys] (id = key) and [index_keys] (name = key), all in hex, readable by its owner only."""
    try:
        check_secret_file_mode(path)
        with open(path, "rb") as f:
            spec = tomllib.load(f)
    except OSError as e:
        raise E.KeyFileRead(str(e)) from e
    except tomllib.TOMLDecodeError as e:
        raise E.KeyFileParse(str(e)) from e
    if unknown := set(spec) - {"active", "keys", "index_keys"}:
        raise E.KeyFileParse(f"unknown fields: {', '.join(sorted(unknown))}")
    data = {_hex(i, KEY_ID, "a key id"): Key(_hex(k, 32, "a key")) for i, k in spec.get("keys", {}).items()}
    return MemoryKeys(_hex(spec.get("active", ""), KEY_ID, "the active key id"), data, {n: Key(_hex(k, 32, "a key")) for n, k in spec.get("index_keys", {}).items()})


def generate_key_file(path: str) -> None:
    """A new file with one data key; an existing file is never overwritten."""
    key_id = secrets.token_hex(KEY_ID)
    text = f'active = "{key_id}"\n\n[keys]\n{key_id} = "{secrets.token_hex(32)}"\n'
    try:
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(text)
    except OSError as e:
        raise E.KeyFileWrite(str(e)) from e


class KeyStore(Protocol):
    """A shared store of keys. A failed read raises KeyBackend; None means that there is no such key."""

    def read_data_key(self, key_id: bytes) -> bytes | None: ...

    def create_data_key(self) -> tuple[bytes, bytes]: ...

    def read_index_key(self, name: str) -> dict | None: ...

    def create_index_key(self, name: str, record: dict) -> bool: ...

    def read_legacy_index_keys(self) -> dict[str, str] | None: ...


class StoreKeys:
    """Keys from a shared store: index keys are minted on first use, by compare-and-set, and the winner of a race is adopted;
    misses are remembered for a while, found keys for the session. keys() has those found so far; the others are looked up by the ids that stored values name."""

    complete = False
    MISS_SECONDS, MISSES = 60.0, 4096

    def __init__(self, store: KeyStore, clock=time.monotonic):
        self.store, self.clock = store, clock
        self.data: dict[bytes, Key] = {}
        self.index: dict[str, Key] = {}
        self.missing: dict[bytes, float] = {}
        self.active: bytes | None = None

    def active_key(self) -> tuple[bytes, Key]:
        if self.active is None:
            self.roll()
        return self.active, self.data[self.active]

    def roll(self) -> bytes:
        key_id, key = self.store.create_data_key()
        self.data[key_id] = Key(key)
        self.active = key_id
        return key_id

    def key(self, key_id: bytes) -> Key:
        if key_id in self.data:
            return self.data[key_id]
        now = self.clock()
        if now - self.missing.get(key_id, -self.MISS_SECONDS) < self.MISS_SECONDS:
            raise E.UnknownKey(key_id.hex())
        found = self.store.read_data_key(key_id)
        if found is None:
            self.missing = {k: t for k, t in self.missing.items() if now - t < self.MISS_SECONDS}
            if len(self.missing) >= self.MISSES:
                self.missing.clear()
            self.missing[key_id] = now
            raise E.UnknownKey(key_id.hex())
        self.data[key_id] = Key(found)
        return self.data[key_id]

    def keys(self) -> dict[bytes, Key]:
        return dict(self.data)

    def index_key(self, name: str) -> Key:
        if name not in self.index:
            self.index[name] = self._resolve(name)
        return self.index[name]

    @staticmethod
    def current(record: dict) -> Key:
        """The current version of an index key's record: {"current": n, "versions": {n: hex}}."""
        versions = record.get("versions", {})
        if record.get("current") not in versions:
            raise E.KeySourceError("an index key's record has no current version")
        return Key(_hex(versions[record["current"]], 32, "an index key"))

    def _resolve(self, name: str) -> Key:
        first = lambda key: {"current": 1, "versions": {1: key.hex()}}
        if (record := self.store.read_index_key(name)) is not None:
            return self.current(record)
        legacy = self.store.read_legacy_index_keys() or {}
        if name in legacy:
            key = Key(_hex(legacy[name], 32, "an index key"))
            self.store.create_index_key(name, first(key))
            return key
        fresh = Key(secrets.token_bytes(32))
        if self.store.create_index_key(name, first(fresh)):
            return fresh
        if (record := self.store.read_index_key(name)) is None:
            raise E.KeySourceError(f"index key {name} vanished after another writer made it")
        return self.current(record)


@dataclass
class Budget:
    """How many values each data key has sealed in this application; a key is rolled, or refused, before it would go over."""

    limit: int = BUDGET
    used: dict[bytes, int] = field(default_factory=dict)

    def take(self, source: KeySource, values: int) -> bytes:
        """Books `values` seals and returns the id of the key to seal them with."""
        key_id, _ = source.active_key()
        if self.used.get(key_id, 0) + values > self.limit:
            if values > self.limit or not hasattr(source, "roll"):
                raise E.KeyExhausted(f"key {key_id.hex()} may seal {self.limit} values")
            key_id = source.roll()
        self.used[key_id] = self.used.get(key_id, 0) + values
        return key_id

    def take_rest(self, source: KeySource) -> bytes:
        """Books all that the active key (or, if it has nothing left, a new one) may still seal."""
        key_id = self.take(source, 1)
        self.used[key_id] = self.limit
        return key_id


def data_key_table(spark: SparkSession, keys: dict[bytes, Key]) -> DataFrame:
    """__key_id and __key, one row per data key."""
    return spark.createDataFrame([(bytearray(i), bytearray(k)) for i, k in keys.items()], "__key_id binary, __key binary")


def secret_row(spark: SparkSession, values: dict[str, bytes]) -> DataFrame:
    """One row whose columns are secrets: padded index keys, the active data key."""
    return spark.createDataFrame([tuple(bytearray(v) for v in values.values())], ", ".join(f"`{k}` binary" for k in values))


def padded(name: str, key: Key) -> dict[str, bytes]:
    inner, outer = pads(key)
    return {f"__in_{name}": inner, f"__out_{name}": outer}
