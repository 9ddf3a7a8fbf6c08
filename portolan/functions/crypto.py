"""Column encryption and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt(c: Column | str, key: Column) -> Column:
    """AES-GCM with a fresh nonce per value, as base64 text; null stays null."""
    return F.base64(F.aes_encrypt(F.col(c) if isinstance(c, str) else c, key, F.lit("GCM")))


def decrypt(c: Column | str, key: Column) -> Column:
    """The text behind ``encrypt``; the value itself where it cannot be decrypted."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string"), value)


def digest(c: Column | str, bits: int | None = None) -> Column:
    """MD5, or SHA-2 of the given width."""
    value = F.col(c) if isinstance(c, str) else c
    return F.sha2(value, bits) if bits else F.md5(value)
