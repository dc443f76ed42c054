"""FNV-1a hashes as Column expressions.

Spark has no unsigned 64-bit type and ANSI mode rejects overflow, so the 64-bit
hash runs on two 32-bit limbs and ends as a signed BIGINT bit pattern."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
# FNV-1a offsets and primes
_FNV32_OFFSET, _FNV32_PRIME = 0x811C9DC5, 0x01000193
_FNV64_OFFSET = 0xCBF29CE484222325
_FNV64_PRIME_LOW = 0x1B3  # the prime is 2**40 + 435


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def utf8_bytes(text: Column) -> Column:
    """Bytes of a string (or binary) as array<bigint>."""
    raw = text.cast("binary")
    one = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint")
    size = F.octet_length(raw)
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), size), one))


def le_bytes(value: Column, width: int) -> Column:
    """Little-endian bytes of a BIGINT bit pattern."""
    return F.array(*[F.shiftrightunsigned(value, 8 * i).bitwiseAND(_long(255)) for i in range(width)])


def fnv32_bytes(data: Column) -> Column:
    step = lambda h, b: (h.bitwiseXOR(b) * _long(_FNV32_PRIME)).bitwiseAND(_long(_MASK))
    return F.aggregate(data, _long(_FNV32_OFFSET), step)


def fnv64_bytes(data: Column) -> Column:
    """Fold of integers below 2**32 (bytes, or whole indices) into FNV-1a-64."""

    def step(acc, b):
        low = acc["lo"].bitwiseXOR(b)
        prod = low * _long(_FNV64_PRIME_LOW)
        high = acc["hi"] * _long(_FNV64_PRIME_LOW) + low * _long(256) + F.shiftrightunsigned(prod, 32)
        return F.struct(
            high.bitwiseAND(_long(_MASK)).alias("hi"),
            prod.bitwiseAND(_long(_MASK)).alias("lo"),
        )

    start = F.struct(_long(_FNV64_OFFSET >> 32).alias("hi"), _long(_FNV64_OFFSET & _MASK).alias("lo"))
    return F.aggregate(data, start, step, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"]))


def fnv32(text: Column) -> Column:
    return fnv32_bytes(utf8_bytes(text))


def fnv64(text: Column) -> Column:
    return fnv64_bytes(utf8_bytes(text))


def unsigned_mod(h: Column, m: int) -> Column:
    """h mod m where h is read as unsigned 64 bit."""
    high = F.shiftrightunsigned(h, 32)
    low = h.bitwiseAND(_long(_MASK))
    return (high * _long((1 << 32) % m) + low) % _long(m)


def hex64(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def any_true(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
