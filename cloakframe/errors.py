"""Errors of protected columns. Those found while Spark runs are raised by raise_error with the class name first."""

from __future__ import annotations


class ProtectionError(Exception):
    """Any refusal of this library."""


class Malformed(ProtectionError):
    """A stored value isn't an envelope."""


class Decrypt(ProtectionError):
    """A stored value doesn't authenticate: wrong key, column, row, or changed bytes."""


class RowKeyMissing(ProtectionError):
    """A row-bound value was opened, or written, without its row key."""


class RowBindingDowngraded(ProtectionError):
    """A value that isn't row-bound was found where strict row binding is on."""


class RowBindingFieldTooLong(ProtectionError):
    """A context or row key exceeds what its length prefix can hold."""


class Encrypt(ProtectionError):
    """Sealing failed."""


class RowKeyType(ProtectionError):
    """A row key is null, out of range, or of a type that has no canonical text."""


class KeyExhausted(ProtectionError):
    """A data key has sealed as many values as its budget allows."""


class UnknownKey(ProtectionError):
    """No key has the id that a stored value names."""


class SecretFileMode(ProtectionError):
    """A file that holds secrets can be read by others."""


class PolicyError(ProtectionError):
    """A policy that contradicts itself, or looks protective and is not."""


class UnknownColumn(ProtectionError):
    """No protected column has this name."""


class RowKeyRequired(ProtectionError):
    """The column's table declares a row key and none was given."""


class RowKeyNotDeclared(ProtectionError):
    """A row key was given for a column whose table declares none."""


class NotReadable(ProtectionError):
    """The column can't be opened: tokens, and digits sealed without detokenization."""


class Unprotected(ProtectionError):
    """A statement uses protected columns in a way that protection can't cover, or a strict read found a value that isn't sealed."""

    def __init__(self, sites):
        self.sites = [] if isinstance(sites, str) else list(sites)
        super().__init__(sites if isinstance(sites, str) else "; ".join(map(str, self.sites)))


class ArrayTooLong(ProtectionError):
    """An array to search for has too many elements."""


class FpeDomain(ProtectionError):
    """Too few digits for format-preserving encryption."""


class KeyFileRead(ProtectionError):
    """A key file can't be read."""


class KeyFileWrite(ProtectionError):
    """A key file can't be written, or exists already."""


class KeyFileParse(ProtectionError):
    """A key file doesn't hold what it should."""


class KeySourceError(ProtectionError):
    """A key source has no such key."""


class KeyBackend(ProtectionError):
    """A key store failed; that is not the same as a missing key."""


class Entropy(ProtectionError):
    """No random bytes."""


class ReadRefusal(ProtectionError):
    """A result can't be opened safely, so none of it is returned."""


class RowKeyAbsent(ReadRefusal):
    """A row-bound column is in the result without its row key."""


class AmbiguousRowKey(ReadRefusal):
    """A row-bound column's row key is in the result more than once."""


class AmbiguousRowInstance(ReadRefusal):
    """Two instances of a table are in the result and one row key."""


class ProtectedValueTooLarge(ReadRefusal):
    """A stored value exceeds the ceiling."""


#: Classes that raise_error texts begin with.
BY_NAME = {c.__name__: c for c in list(globals().values()) if isinstance(c, type) and issubclass(c, ProtectionError)}


def translated(error: Exception) -> Exception:
    """The library's error for what Spark raised, if it is one: raise_error texts, and failed authentication."""
    text = str(error)
    for name, kind in BY_NAME.items():
        if f"{name}: " in text:
            return kind(text.split(f"{name}: ", 1)[1].split("\n")[0])
    if "AES_CRYPTO_ERROR" in text or "Tag mismatch" in text:
        return Decrypt("a stored value does not authenticate")
    return error
