"""64-bit FNV-1 over binary columns, in decimal arithmetic, and bloom positions.

ANSI mode raises on BIGINT overflow, so the state is decimal(20,0) reduced modulo 2**64; only its low
byte takes part in the exclusive or.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis and prime of 64-bit FNV (fixed values, public).
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211
_D = "decimal(20,0)"


def _dec(v: int) -> Column:
    return F.lit(str(v)).cast(_D)


def _low(x: Column, n: int) -> Column:
    return x % _dec(n)


def fnv1(key: Column) -> Column:
    """FNV-1 of a binary column as decimal(20,0)."""
    text = F.hex(key)
    size = F.length(text) / 2
    places = F.when(size > 0, F.sequence(F.lit(1), size.cast("int"))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.conv(F.substring(text, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))

    def step(h: Column, b: Column) -> Column:
        product = (h.cast("decimal(20,0)") * F.lit(str(FNV_PRIME)).cast("decimal(13,0)")) % F.lit(str(1 << 64)).cast(_D)
        product = product.cast(_D)
        low = _low(product, 256).cast("int")
        return (product - low.cast(_D) + low.bitwiseXOR(b).cast(_D)).cast(_D)

    return F.aggregate(codes, _dec(FNV_BASIS), step)


def bloom_positions(key: Column, bits: int) -> Column:
    """The two bit positions of a key: the hash, and its upper half, modulo the number of bits."""
    if bits <= 0:
        raise ValueError("a filter needs bits")
    h = fnv1(key)
    upper = F.floor(h.cast("decimal(38,10)") / F.lit(str(1 << 32)).cast("decimal(20,0)")).cast(_D)
    return F.array(_low(h, bits).cast("long"), _low(upper, bits).cast("long"))
