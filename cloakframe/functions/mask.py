"""Read-time masks: some characters stay at the ends, all others become one mask character."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from cloakframe.errors import PolicyError


@dataclass(frozen=True)
class Mask:
    keep_first: int = 0
    keep_last: int = 0
    mask_with: str = "*"

    def __post_init__(self):
        if self.keep_first < 0 or self.keep_last < 0 or len(self.mask_with) != 1:
            raise PolicyError("a mask keeps 0 or more characters and has one mask character")

    def apply(self, value: bytes) -> bytes:
        """For a single value; characters are code points, and bytes that aren't UTF-8 are masked one by one."""
        try:
            text = value.decode()
        except UnicodeDecodeError:
            return (self.mask_with * len(value)).encode()
        hidden = len(text) - self.keep_first - self.keep_last
        if hidden <= 0:
            return (self.mask_with * len(text)).encode()
        return (text[: self.keep_first] + self.mask_with * hidden + text[len(text) - self.keep_last :]).encode()


def mask_text(column: Column, mask: Mask) -> Column:
    """The masked text of a string column; null stays null. A value with no hidden middle is masked whole."""
    n, kept = F.char_length(column), mask.keep_first + mask.keep_last
    ends = [F.substring(column, 1, mask.keep_first)] if mask.keep_first else []
    tail = [F.right(column, F.lit(mask.keep_last))] if mask.keep_last else []
    return F.when(n <= kept, F.repeat(F.lit(mask.mask_with), n)).otherwise(F.concat(*ends, F.repeat(F.lit(mask.mask_with), n - kept), *tail))


def mask_binary(column: Column, mask: Mask) -> Column:
    """The masked bytes of a binary column; bytes that aren't UTF-8 give one mask character each."""
    text = mask_text(F.decode(column, "UTF-8"), mask).cast("binary")
    hidden = F.repeat(F.lit(mask.mask_with), F.octet_length(column)).cast("binary")
    return F.when(F.is_valid_utf8(column.cast("string")), text).otherwise(hidden)
