"""Identities and hashes as columns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(grammar: Column, rule: Column, path: Column) -> Column:
    """The id of a grammar node, as grammarlens.sources.abnf makes it."""
    return F.concat(grammar, F.lit(":"), rule, F.lit("#"), F.substring(F.sha2(F.concat(grammar, F.lit("|"), path), 256), 1, 8))


def fraction(value: Column, seed: Column | int) -> Column:
    """A number in [0, 1) that depends on value and seed only: blake2b of "seed:value" over 64 bits.

    Spark has no blake2b; this goes through Arrow. Null values give null.
    """

    @F.pandas_udf("double")
    def of(values: pd.Series, seeds: pd.Series) -> pd.Series:
        hashed = lambda v, s: int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") / 2**64
        return pd.Series([None if v is None else hashed(v, s) for v, s in zip(values, seeds, strict=True)], dtype="float64")

    return of(value, seed if isinstance(seed, Column) else F.lit(seed))


def rank_number(value: Column, seed: Column | int) -> Column:
    """A number below 2^60 that depends on value and seed only, inside the JVM: the first digits of SHA-256."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.conv(F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(":"), value), 256), 1, 15), 16, 10).cast("bigint")


def _number(binary: Column, at: int, size: int) -> Column:
    """A big-endian number of size bytes, at counted from 0; null beyond the end."""
    return F.when(F.octet_length(binary) >= at + size, F.conv(F.hex(F.substring(binary, at + 1, size)), 16, 10).cast("bigint"))


def _opaque(binary: Column, at: int) -> Column:
    """Bytes that follow their length in three bytes; null if short or empty."""
    size = _number(binary, at, 3)
    return F.when((size > 0) & (F.octet_length(binary) >= at + 3 + size), F.substring(binary, F.lit(at + 4), size.cast("int")))


def certificate_of_entry(leaf: Column, extra: Column) -> Column:
    """The certificate in an entry of a transparency log (RFC 6962); null where there is none to read."""
    is_leaf = _number(leaf, 1, 1) == 0
    kind = F.when(is_leaf, _number(leaf, 10, 2))
    return F.when(kind == 0, _opaque(leaf, 12)).when(kind == 1, _opaque(extra, 0))
