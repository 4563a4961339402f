"""Mix sources to target weights by systematic sampling.

Targets: the sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words;
a target stops at ``most`` times its source's words and the excess is shared again by weight.

The documents of a source are laid out by falling size, their expected copies are prefix-summed in one sweep over the source, one random offset
per source is added, and a document is emitted once per integer boundary that its stretch crosses.  All documents of a tier expect
equally many copies: what the target still lacks after the larger documents, over the words that remain.  So what chance does with a few huge
documents is made up for by the smaller ones.  Tiers grow from ``FIRST`` documents by ``GROWTH`` to the middle of the source and
shrink again to its smallest documents, so that the last corrections are made with small change.  The prefix sum and the offset run on across tiers.

Ranks in a source come from a range shuffle by (source, size, id, locator) and a count per range, so a source may hold any share of the rows,
and the mix depends on the rows alone, not on the number of partitions.  Sources may be many: weights, targets and rates are tables, joined
by source as Spark finds fit for their sizes.  The driver holds sums over all sources, and counts per range.
DataFrame functions only.

Defined results: null text has no words; documents without words are ranked but take nothing; a source
without words has target 0; equal sizes are ordered by id and locator; repeated rows count as rows of
their own; an empty table gives an empty table; other columns, whatever their names, do not matter.  A locator is the row's
file and its number there; ``docs`` that is no plain Parquet scan is first written as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .sharding import row_numbers

#: Documents of a source in its first and in its last tier, and how many times more the next tier towards the middle holds.
FIRST, GROWTH = 16, 8
#: Tiers on each side of the middle, enough for 16 * 8**10 documents.
SIDE = 12


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    whole = F.coalesce(text, F.lit(""))
    blank = [F.lit(c) for c in " \t\n\x0b\x0c\r"]
    ends = [F.substring(whole, 1, 1), F.substring(whole, -1, 1)]
    outside = sum((F.when(e.isin(*blank), 1).otherwise(0) for e in ends), F.lit(0))
    parts = F.size(F.split(whole, r"[\x20\x09-\x0D]+")) - outside  # blanks at an end make an empty part there
    return F.when(whole == "", F.lit(0)).otherwise(parts).cast("long")


def fill_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """``sizes(source, words)`` with ``target``: weights by rank in code point order (null last), filled up to the caps by rounds in which
    two sums reach the driver."""
    nulls_last = sizes.withColumn("no_source", F.col("source").isNull())
    ranked = row_numbers(nulls_last, "no_source", "source").select(
        "source", "words", (F.col("row_number") % 3 + 1).alias("weight"), (F.col("words") * F.lit(float(most))).alias("cap")
    )
    state = scratch.keep(ranked, "weights")
    total = state.agg(F.sum("words")).first()[0] or 0
    level, free = 0.0, F.lit(True)  # a source is free while its share at the level is not above its cap
    while True:
        capped, weight = state.select(F.when(free, None).otherwise(F.col("cap")).alias("c"), F.when(free, F.col("weight")).alias("w")).agg(F.sum("c"), F.sum("w")).first()
        if not weight:
            break
        level = (total - (capped or 0.0)) / weight
        over = free & (F.col("weight") * F.lit(level) > F.col("cap"))
        if state.where(over).isEmpty():
            break
        free = free & ~(F.col("weight") * F.lit(level) > F.col("cap"))
    return state.select("source", "words", F.when(free, F.col("weight") * F.lit(level)).otherwise(F.col("cap")).alias("target"))


def _ranked(sized: DataFrame) -> DataFrame:
    """``rank`` (from 0) of each row in its source by falling size, id and locator, and ``n``, the documents of the source."""
    numbered = row_numbers(sized.withColumn("smaller", -F.col("size")), "source", "smaller", "doc_id", "row").drop("smaller")
    starts = numbered.groupBy("source").agg(F.min("row_number").alias("first"), F.count(F.lit(1)).alias("n"))
    starts = scratch.keep(starts.select(F.col("source").alias("s_source"), "first", "n"), "source-starts")
    joined = numbered.join(starts, F.col("source").eqNullSafe(F.col("s_source")))
    return joined.select("row", "doc_id", "source", "size", (F.col("row_number") - F.col("first")).alias("rank"), "n")


def _side(place: Column) -> Column:
    """Tier of a place counted from an end."""
    bounds = F.array(*[F.lit(FIRST * GROWTH**t).cast("long") for t in range(SIDE - 1)])
    return F.size(F.filter(bounds, lambda b: b <= place))


def _tiered(ranked: DataFrame) -> DataFrame:
    """``tier`` of each row: 0 to SIDE - 1 up to the middle of its source, 2 * SIDE - 1 for its smallest documents."""
    back = F.col("n") - 1 - F.col("rank")
    tier = F.when(F.col("rank") * 2 < F.col("n"), _side(F.col("rank"))).otherwise(2 * SIDE - 1 - _side(back))
    return ranked.withColumn("tier", tier.cast("int"))


def _copies() -> Column:
    """Integer boundaries within the stretch of a document: ``base`` is the prefix sum, offset included, before its tier."""
    place = F.col("rank") - F.col("tier_first")
    return (F.floor(F.col("base") + (place + 1) * F.col("rate")) - F.floor(F.col("base") + place * F.col("rate"))).cast("long")


def mix(
    docs: DataFrame, most: float = 3.0, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """(row, doc_id, size, source, source_size, target, copies, taken) for every row of ``docs``; row is its locator."""
    docs = scratch.located(docs)
    sized = scratch.keep(
        docs.select(
            scratch.locator().alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")
        ),
        "sized",
    )
    tiered = scratch.keep(_tiered(_ranked(sized)), "tiered", "tier")  # a folder per tier: a step reads its own
    parts = tiered.groupBy("source", "tier").agg(F.sum("size").alias("words"), F.min("rank").alias("tier_first"), F.count(F.lit(1)).alias("docs"))
    parts = scratch.keep(parts.withColumnRenamed("source", "p_source"), "parts")
    sizes = scratch.keep(parts.groupBy(F.col("p_source").alias("source")).agg(F.sum("words").alias("words")), "source-sizes")
    targets = scratch.keep(fill_targets(sizes, most), "targets")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # what a source still lacks, the words that remain to take it from, and the prefix sum so far
    state = targets.select("source", F.col("target").alias("lacks"), F.col("words").alias("remains"), offset.alias("base"))
    rates: DataFrame | None = None
    for tier in sorted(r[0] for r in parts.select("tier").distinct().collect()):  # at most 2 * SIDE
        here = parts.where(F.col("tier") == tier).drop("tier")
        joined = state.join(here, F.col("source").eqNullSafe(F.col("p_source")), "left")
        share = F.when(F.col("remains") > 0, F.col("lacks") / F.col("remains")).otherwise(F.lit(0.0))
        rate = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), share))
        step = joined.select("source", "lacks", "remains", "base", "words", "tier_first", "docs", F.when(F.col("docs") > 0, rate).alias("rate"))
        step = scratch.keep(step, "step")
        own = step.where("rate is not null").select(F.col("source").alias("r_source"), F.lit(tier).alias("r_tier"), "tier_first", "base", "rate")
        rates = own if rates is None else rates.unionByName(own)
        rows = tiered.where(F.col("tier") == tier).join(own, F.col("source").eqNullSafe(F.col("r_source")))
        took = rows.groupBy(F.col("source").alias("t_source")).agg(F.sum(_copies() * F.col("size")).alias("took"))
        state = step.join(took, F.col("source").eqNullSafe(F.col("t_source")), "left").select(
            "source", (F.col("lacks") - F.coalesce("took", F.lit(0))).alias("lacks"), (F.col("remains") - F.coalesce("words", F.lit(0))).alias("remains"),
            F.when(F.col("rate").isNull(), F.col("base")).otherwise(F.col("base") + F.col("docs") * F.col("rate")).alias("base"),
        )
    if rates is None:
        return sized.select("row", "doc_id", "size", "source", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), *[F.lit(0).cast("long").alias(c) for c in ("copies", "taken")])
    goals = targets.select(F.col("source").alias("g_source"), F.col("words").alias("source_size"), "target")
    plan = scratch.keep(rates.join(goals, F.col("r_source").eqNullSafe(F.col("g_source"))).drop("g_source"), "rates")
    out = tiered.join(plan, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("tier") == F.col("r_tier"))).withColumn("copies", _copies())
    return out.select(
        "row", "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (not at all where it takes none).

    Rows are matched by their locator, so rows that share an id, or have none, each get their own copies.
    """
    docs = scratch.located(docs)
    own, of, times, copy = scratch.unused(docs, "mix_row", "mix_of", "mix_times", "mix_copy")
    share = mix(docs, **options).where("copies > 0").select(F.col("row").alias(of), F.col("copies").cast("int").alias(times))
    numbered = docs.select("*", scratch.locator().alias(own)).join(share, F.col(own) == F.col(of))
    return numbered.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(own, of, times, copy)
