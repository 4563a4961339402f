"""Scalar functions on columns: 32-bit wrap, generated weights, priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the integer hash and of the two priority seeds.
HASH_FACTOR = 73244475
SEED_HIGH, SEED_LOW = 712313887, 683067839
MASK32 = 4294967295


def wrap32(x: Column) -> Column:
    """The signed 32-bit value of a long, as a product of ints overflows."""
    return F.shiftright(F.shiftleft(x, 32), 32)


def edge_weight(src: Column, dst: Column, n: int, bits: int = 32) -> Column:
    """The generated weight, from the ids' product as ints of 32 bits wrap it or, with ``bits=64``, from the whole product (at least 1, at most n)."""
    product = src * dst
    return F.abs(1 + (wrap32(product) if bits == 32 else product) % F.lit(n)).cast("long")


def hash32(x: Column) -> Column:
    """Unsigned 32-bit integer hash (a bijection of 32-bit numbers)."""
    x = x.bitwiseAND(F.lit(MASK32))
    for _ in range(2):
        x = (F.shiftrightunsigned(x, 16).bitwiseXOR(x) * F.lit(HASH_FACTOR)).bitwiseAND(F.lit(MASK32))
    return F.shiftrightunsigned(x, 16).bitwiseXOR(x)


def mis_priority(v: Column, mode: str = "u32") -> Column:
    """An orderable priority of vertex ``v``; structs order by their high part first."""
    high = hash32(v + F.lit(SEED_HIGH))
    low = hash32(v + F.lit(SEED_LOW))
    if mode == "u32":
        return high
    if mode == "s32":
        return wrap32(high)
    if mode == "u32_mod1000":
        return high % 1000
    if mode == "u64":
        return F.struct(low.alias("hi"), high.alias("lo"))
    if mode == "u64_mod":
        # high | ((low << 32) % 1000): 2**32 % 1000 = 296, so the shifted number's remainder needs no 64-bit product
        return high.bitwiseOR((low % 1000) * 296 % 1000)
    raise ValueError(f"unknown priority mode {mode!r}")
