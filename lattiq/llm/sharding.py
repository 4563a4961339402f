"""Reproducible global shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Row ``r`` of the table in ``order`` goes to position ``p = permute(r)``, shard ``p mod shards`` and slot
``p div shards``: shard sizes differ by at most one row, slots have no gaps, and anyone who knows the
number of rows and the seed can compute either direction without looking at the data.

The permutation works on a grid of ``a x b >= n`` cells with ``a = ceil(sqrt(n))``: each round adds a keyed
hash of one coordinate to the other, so it is a bijection of the grid.  Values outside ``0..n-1`` are
walked on until they fall inside; fewer than ``a`` cells lie outside, so walks are short.
DataFrame functions only.

Defined results: a null text has size 1 (no bytes, plus one) and the checksum of no bytes; a null key
sorts first; rows with equal keys are ordered by size and checksum, so repeated rows are
interchangeable; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

ROUNDS = 6
MASK = (1 << 32) - 1
#: For large n, fewer than one row in n**31 would need more steps; for small n the grid bounds the walk.
MOST_STEPS = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds: a linear congruential sequence, so that any engine can repeat it."""
    keys, x = [], seed & MASK
    for _ in range(rounds):
        x = (x * 1664525 + 1013904223) & MASK
        keys.append(x)
    return keys


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of the grid: a * b >= n > a * b - a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _hashed(x: Column, key: Column) -> Column:
    """A 32-bit hash of x (below 2**31) under a key; every product stays below 2**63."""
    t = (x * F.lit(2654435) + key).bitwiseAND(F.lit(MASK))
    for _ in range(2):
        t = (F.shiftright(t, 16).bitwiseXOR(t) * F.lit(73244475)).bitwiseAND(F.lit(MASK))
    return F.shiftright(t, 16).bitwiseXOR(t)


def _turn(n: int, keys: list[int], back: bool = False):
    """One pass of all rounds (or its inverse) as a function from Column to Column."""
    a, b = grid(n)
    rounds = [F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2).alias("odd")) for i, k in enumerate(keys)]
    table = F.array(*(rounds[::-1] if back else rounds))
    sign = F.lit(-1 if back else 1)

    def step(s: Column, k: Column) -> Column:
        down = F.pmod(s["l"] + sign * _hashed(s["r"], k["key"]), F.lit(a).cast("long"))
        across = F.pmod(s["r"] + sign * _hashed(s["l"], k["key"]), F.lit(b).cast("long"))
        odd = k["odd"] == 1
        return F.struct(F.when(odd, s["l"]).otherwise(down).alias("l"), F.when(odd, across).otherwise(s["r"]).alias("r"))

    def turn(x: Column) -> Column:
        low = x % F.lit(a).cast("long")
        start = F.struct(low.alias("l"), ((x - low) / F.lit(a)).cast("long").alias("r"))
        return F.aggregate(table, start, step, lambda s: s["r"] * F.lit(a).cast("long") + s["l"])

    return turn


def permute(row: Column, n: int, seed: int = 0, back: bool = False) -> Column:
    """Position of a row number in 0..n-1 (or, with ``back``, the row number at a position)."""
    turn = _turn(n, round_keys(seed), back)
    a, _ = grid(n)
    more = F.sequence(F.lit(1), F.lit(max(1, min(a, MOST_STEPS))))
    walk = lambda x, _: F.when(x < F.lit(n), x).otherwise(turn(x))
    inside = lambda x: F.when(x < F.lit(n), x).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long"))
    return F.aggregate(more, turn(row.cast("long")), walk, inside)


def row_numbers(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``row_number`` (from 0) in the given order, by a range shuffle and one count per range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within = (1 << 33) - 1
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    here = F.monotonically_increasing_id()
    ordered = scratch.keep(
        ordered.withColumn("range_no", F.shiftright(here, 33)).withColumn("in_range", here.bitwiseAND(F.lit(within))),
        "ranges",
    )
    # one row per range, as many as shuffle partitions: bounded by the cluster, not by the rows
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("range_no").count().collect())
    before, offsets = 0, []
    for range_no, count in counts:
        offsets.append((range_no, before))
        before += count
    starts = spark.createDataFrame(offsets, "range_no long, before long")
    numbered = ordered.join(F.broadcast(starts), "range_no")
    return numbered.withColumn("row_number", F.col("before") + F.col("in_range")).drop("range_no", "in_range", "before")


def assign_shards(
    docs: DataFrame, shards: int = 16, seed: int = 20240607, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is ``rows``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    numbered = row_numbers(scratch.keep(rows, "sizes"), "doc_id", "size", "text_crc32")
    n = numbered.count()
    place = numbered.withColumn("place", permute(F.col("row_number"), n, seed))
    return place.select(
        F.col("doc_id").alias(key),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle_sql(shards: int = 16, seed: int = 20240607) -> str:
    """The same in DuckDB SQL: the permutation by a recursive walk, the checksum byte by byte with a table made by its rule."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(h, 2 * i + {at}, 1)) - 1)"
    x, low, high = "x", "(x % a)", "(x // a)"
    rounds = []
    for i, key in enumerate(round_keys(seed)):
        of = "r" if i % 2 == 0 else "l"
        t = f"((({of} * 2654435 + {key}) & {MASK}))"
        for _ in range(2):
            t = f"((xor({t} >> 16, {t}) * 73244475) & {MASK})"
        t = f"xor({t} >> 16, {t})"
        rounds.append(f"(l + {t}) % a as l, r" if i % 2 == 0 else f"l, (r + {t}) % b as r")
    turned = f"(select d, {low} as l, {high} as r, a, b, n from walk where {x} >= n or first)"
    for pair in rounds:
        turned = f"(select d, {pair}, a, b, n from {turned})"
    return f"""
with recursive rows_ as (
  select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size, coalesce(text, '') as t,
         cast(row_number() over (order by doc_id nulls first) - 1 as bigint) as d, count(*) over () as n from documents),
sized as (select *, cast(ceil(sqrt(n)) as bigint) as a from rows_),
crcs as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc_of),
bytes_ as (select d, list_transform(range(size - 1), lambda i: {digit(1)} * 16 + {digit(2)}) as bs
           from (select d, size, hex(encode(t)) as h from rows_)),
crc as (select d, cast(xor(list_reduce(list_prepend({MASK}, bs), lambda c, k: xor(c >> 8, crc_of[(xor(c, k) & 255) + 1])), {MASK}) as bigint)
        as text_crc32 from bytes_, crcs),
walk(d, x, first, a, b, n) as (
  select d, d, true, a, cast((n + a - 1) // a as bigint), n from sized
  union all
  select d, r * a + l, false, a, b, n from {turned})
select s.doc_id, s.size, crc.text_crc32, 'rows' as law, cast(w.x % {shards} as integer) as shard,
       cast(w.x // {shards} as bigint) as slot, cast(null as integer) as grown_shard
from sized s join walk w using (d) join crc using (d) where not w.first and w.x < w.n"""
