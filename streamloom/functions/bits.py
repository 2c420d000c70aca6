"""Unsigned 64-bit arithmetic on BIGINT columns.

A BIGINT holds the bit pattern of an unsigned number.  Multiplication and
addition have to wrap, which ANSI mode refuses, so expressions with them are
built, and their DataFrame resolved, inside :func:`wrapping`.  It sets the
session's ANSI mode meanwhile, one thread at a time; threads that build other
plans should use a session of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import RLock

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
# splitmix64 and 64-bit FNV-1a.
GAMMA = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


_ONE_AT_A_TIME = RLock()


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Arithmetic in DataFrames made within wraps, also when they run later."""
    with _ONE_AT_A_TIME:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


def signed(value: int) -> int:
    value &= MASK
    return value - (1 << 64) if value >> 63 else value


def u64(value: int) -> Column:
    return F.lit(signed(value)).cast("bigint")


def mod_unsigned(h: Column, m: int) -> Column:
    """``h`` as an unsigned number modulo ``m``, for m up to 2**62."""
    return (F.shiftrightunsigned(h, 1) % m * 2 + h.bitwiseAND(F.lit(1))) % m


def _shake(z: Column, shift: int) -> Column:
    return z.bitwiseXOR(F.shiftrightunsigned(z, shift))


def mix(seed: int | Column, n: Column) -> Column:
    """splitmix64 of the n-th step from ``seed``."""
    z = (seed if isinstance(seed, Column) else u64(seed)) + (n + 1) * u64(GAMMA)
    return _shake(_shake(_shake(z, 30) * u64(MIX_A), 27) * u64(MIX_B), 31)


def big_endian(n: Column) -> Column:
    """The 8 bytes of a BIGINT."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def _eat(h: Column, byte: Column) -> Column:
    return h.bitwiseXOR(byte) * u64(FNV_PRIME)


def fnv1a_of_long(n: Column) -> Column:
    """FNV-1a of the 8 big-endian bytes of ``n``, unrolled."""
    h = u64(FNV_OFFSET)
    for shift in range(56, -8, -8):
        h = _eat(h, F.shiftrightunsigned(n, shift).bitwiseAND(F.lit(255)))
    return h


def long_of(key: Column) -> Column:
    """The number whose 8 big-endian bytes a BINARY is; of another length nothing of use."""
    code = F.hex(key)
    hi = F.conv(F.substring(code, 1, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring(code, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def fnv1a(key: Column, number: Column | None = None) -> Column:
    """FNV-1a of a BINARY of any length; the 8-byte case stays out of loops.

    ``number`` is a column with :func:`long_of` the key.  Within a condition an
    expression is computed wherever it stands, so without such a column the
    number goes through a lambda variable, which costs more.
    """
    code = F.hex(key)
    at = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), 2 * F.octet_length(key), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("bigint")
    loop = F.aggregate(at, u64(FNV_OFFSET), lambda h, i: _eat(h, byte(i)))
    short = fnv1a_of_long(number) if number is not None else F.transform(F.array(long_of(key)), fnv1a_of_long)[0]
    return F.when(F.octet_length(key) == 8, short).otherwise(loop)
