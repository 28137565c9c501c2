"""Stored forms as Spark expressions: envelopes, blind indexes, tokens.

Keys are columns (of a broadcast key relation), never literals, so that no plan shows one. Spark's own default initialisation
vector is never used, because an optimizer may compute it once.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, functions as F

# Fixed values of the stored format: the magics, and the sizes in bytes of key id, nonce, tag and index.
LEGACY, CELL, ROW = b"DBS1", b"DBS2", b"DBS3"
MAGIC, KEY_ID, NONCE, TAG, INDEX = 4, 16, 12, 16, 32
HEADER = MAGIC + KEY_ID + NONCE
#: Values that one data key may seal.
BUDGET = 1 << 32


def u32(n: Column) -> Column:
    """A length as four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def bytes_lit(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def cell_aad(key_id: Column, context: str) -> Column:
    return F.concat(key_id, bytes_lit(context.encode()))


def row_aad(key_id: Column, context: str, row: Column) -> Column:
    name = context.encode()
    return F.concat(key_id, bytes_lit(len(name).to_bytes(4, "big") + name), u32(F.octet_length(row)), row)


def row_aad_bytes(key_id: bytes, context: str, row: bytes) -> bytes:
    name = context.encode()
    return key_id + len(name).to_bytes(4, "big") + name + len(row).to_bytes(4, "big") + row


def nonce() -> Column:
    """96 bits from two secure random UUIDs, without the digits that tell version and variant; all threads of a JVM wait for one generator."""
    part = "replace(substring(reflect('java.util.UUID', 'randomUUID'), 1, 13), '-', '')"
    return F.expr(f"unhex(concat({part}, {part}))")


def derived_nonce(secret: Column, plain: Column, row: Column | None = None) -> Column:
    """96 bits of SHA-256 over a secret of the job, a fresh UUID, the row key and the plain value.

    The secret (32 random bytes that leave the driver as a key does) makes it unpredictable and the UUID fresh. Should a task that runs
    again repeat its UUIDs, two values get one nonce only if they are equal and of one row, so no nonce ever serves two messages."""
    parts = [secret, F.expr("uuid()").cast("binary"), *([] if row is None else [u32(F.octet_length(row)), row]), plain]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, NONCE)


def is_enveloped(value: Column) -> Column:
    return (F.octet_length(value) > HEADER) & F.substring(value, 1, MAGIC).isin(*[bytearray(m) for m in (LEGACY, CELL, ROW)])


def envelope_of(stored: Column) -> Column:
    """The envelope in a stored value: behind an index, bare, or null if there is none."""
    behind = F.substring(stored, INDEX + 1, 2**31 - 1)
    return F.when(is_enveloped(behind), behind).when(is_enveloped(stored), stored)


def index_of(stored: Column) -> Column:
    """The blind index in front of an envelope, or null."""
    return F.when(is_enveloped(F.substring(stored, INDEX + 1, 2**31 - 1)), F.substring(stored, 1, INDEX))


def key_id_of(stored: Column) -> Column:
    return F.substring(envelope_of(stored), MAGIC + 1, KEY_ID)


def hmac_hex(plain: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 as 64 hex digits, from a key's two padded forms."""
    return F.sha2(F.concat(opad, F.unhex(F.sha2(F.concat(ipad, plain), 256))), 256)


def blind_index(plain: Column, ipad: Column, opad: Column) -> Column:
    return F.unhex(hmac_hex(plain, ipad, opad))


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer padded key of HMAC-SHA256 (blocks of 64 bytes)."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_bytes(key: bytes, plain: bytes) -> bytes:
    return hmac.new(key, plain, hashlib.sha256).digest()


def seal(plain: Column, key_id: Column, key: Column, context: str, row: Column | None = None, at: Column | None = None) -> Column:
    """An envelope: bound to the column, or to column and row. Null stays null. at: a nonce, for tests only."""
    aad = cell_aad(key_id, context) if row is None else row_aad(key_id, context, row)
    body = F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce() if at is None else at, aad)
    return F.concat(bytes_lit(CELL if row is None else ROW), key_id, body)


def with_index(index: Column, envelope: Column) -> Column:
    return F.concat(index, envelope)


def open_(stored: Column, key: Column, context: str, row: Column | None = None, strict: bool = False, quiet: bool = False) -> Column:
    """The plain value of a stored one: every form is opened, other values pass as they are, null stays null.

    key: the data key that the envelope names, null if there is none. quiet: null instead of failed authentication; only for reports that count failures."""
    env = envelope_of(stored)
    key_id, magic, body = F.substring(env, MAGIC + 1, KEY_ID), F.substring(env, 1, MAGIC), F.substring(env, MAGIC + KEY_ID + 1, 2**31 - 1)
    is_a = lambda m: magic == bytes_lit(m)
    refuse = lambda text: F.raise_error(F.lit(text)).cast("binary")
    decrypt = F.try_aes_decrypt if quiet else F.aes_decrypt
    opened = lambda aad: decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), aad)
    down = refuse("RowBindingDowngraded: the value is not bound to its row")
    return (
        F.when(env.isNull(), stored)
        .when(key.isNull(), refuse("UnknownKey: no key has the id that a value names"))
        .when(is_a(ROW), opened(row_aad(key_id, context, row)) if row is not None else refuse("RowKeyMissing: the value is bound to a row"))
        .when(is_a(CELL), down if strict and row is not None else opened(cell_aad(key_id, context)))
        .otherwise(down if strict and row is not None else opened(key_id))
    )
