"""Best-fit packing of token sequences by minimum bin slack.

Documents become token ids plus an end id; only a document longer than ``capacity`` is cut, into pieces
of ``capacity`` tokens of which the first may be shorter.  Packing needs only how many pieces there are of
each length, so the driver solves a problem of at most ``capacity`` numbers, whatever the number of
documents: per bin, a bitset subset-sum dynamic programme over the available lengths, seeded with the longest piece left,
finds the fullest feasible combination, and the combination is removed as often as the lengths last.
Pieces then take their places by rank among the pieces of their length; ranks come from counts per
(length, salt), so no length, however common, is ranked in one task.

Defined results: a null text is empty and is the end id alone; repeated rows are packed as often as they
occur; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

CAPACITY = 1024
END_ID = 2
#: Groups of the rank per shuffle partition, if that leaves them ``LEAST_ROWS`` pieces.
GROUPS, LEAST_ROWS = 8, 500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


class Encoder:
    """Ids of ``byte_bpe_50k.json``: by the same vocabulary as ranks, which is several times faster, with the
    tokenizers library itself for texts in which the two could differ or the ranks be slow (special
    tokens; letters or marks in runs of thousands)."""

    LONG_RUN = 2000

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("lattiq", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self._exact = public_tokenizers.path(f"{vocabulary}.json"), None

    def exact(self, text: str) -> list[int]:
        if self._exact is None:  # few texts need it
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact.encode(text, add_special_tokens=False).ids

    def _has_long_run(self, text: str) -> bool:
        if len(text) < self.LONG_RUN:
            return False
        lengths = list(map(len, text.split()))
        gaps = len(text) - sum(lengths) - len(lengths)
        return gaps >= self.LONG_RUN or max(lengths, default=0) >= self.LONG_RUN

    def __call__(self, text: str) -> np.ndarray:
        if "<|" in text or self._has_long_run(text):
            return np.array(self.exact(text), dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenised_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False
) -> DataFrame:
    """A row per piece; with ``ids``, the piece's token ids as well."""
    schema = PIECES + (", ids array<int>" if ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for part in scratch.pieces_of(batches):
            out: list[tuple] = []
            for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tokens = np.append(encoder(value) if value else np.empty(0, "<u4"), np.array([end_id], "<u4"))
                for i, (start, n) in enumerate(cut(len(tokens), capacity)):
                    own = tokens[start : start + n]
                    row = (doc, i, start, n, zlib.crc32(own.tobytes()), zlib.crc32(b"%d:%d" % (doc or 0, i)) & 0x7FFFFFFF)
                    out.append((*row, own.astype(np.int32)) if ids else row)
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names[: len(cols)]
                )

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(encode, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of the available lengths that holds the longest one, by a bitset per length.

    ``reach[i]`` has bit s set if the first i lengths (longest first) can sum to s.
    """
    lengths = sorted(counts, reverse=True)
    room = capacity - lengths[0]
    mask = (1 << (room + 1)) - 1
    reach, used = [1], []
    for n in lengths:
        left = counts[n] - (n == lengths[0])
        if n > room or not left:
            continue
        bits, times, step = reach[-1], min(left, room // n), 1
        while times > 0:  # copies by powers of two
            step = min(step, times)
            bits |= bits << (n * step) & mask
            times -= step
            step *= 2
        reach.append(bits)
        used.append(n)
        if bits >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    chosen = {lengths[0]: 1}
    for i in range(len(used) - 1, -1, -1):
        n = used[i]
        while not reach[i] >> total & 1:
            total -= n
            chosen[n] = chosen.get(n, 0) + 1
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a bin with their multiplicities, number of such bins)], until nothing is left.

    A combination is used as often as its lengths last, so each step at least halves the count of one length:
    at most capacity * log2(pieces) steps.
    """
    left, plan = {n: c for n, c in counts.items() if c}, []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[n] // m for n, m in chosen.items())
        for n, m in chosen.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
        plan.append((chosen, times))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, multiplicity, offset) per stretch of ranks of a length."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in plan:
        offset = 0
        for n, m in sorted(chosen.items(), reverse=True):
            first = rank.get(n, 0)
            rows.append((n, first, times * m, sequence, m, offset))
            rank[n] = first + times * m
            offset += n * m
        sequence += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every row."""
    spark = docs.sparkSession
    pieces = scratch.keep(tokenised_pieces(docs, capacity=capacity, **options), "pieces")
    # at most ``capacity`` rows, whatever the number of pieces
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_rows = max(LEAST_ROWS, -(-sum(counts.values()) // (GROUPS * partitions)))
    salts = spark.createDataFrame([(n, -(-c // group_rows)) for n, c in counts.items()], "s_length long, salts long")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("s_length"))
    salted = salted.withColumn("group_no", F.col("salt") % F.col("salts")).drop("s_length", "salts", "salt")
    before = Window.partitionBy("length").orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "group_no").count().select(
        F.col("length").alias("g_length"), F.col("group_no").alias("g_no"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    starts = scratch.keep(starts, "starts")
    inside = Window.partitionBy("length", "group_no").orderBy("doc_id", "piece")
    ranked = salted.withColumn("in_group", F.row_number().over(inside) - 1).join(
        starts, (F.col("length") == F.col("g_length")) & (F.col("group_no") == F.col("g_no"))
    )
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_group"))
    # the stretches of one length as an array, found by binary search over their first ranks: one row per length
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, first, _, sequence, m, offset in places(plan_bins(counts, capacity)):
        by_length.setdefault(n, []).append((first, sequence, m, offset))
    stretch = "array<struct<first: long, sequence: long, times: long, offset: long>>"
    table = spark.createDataFrame(list(by_length.items()), f"p_length long, stretches {stretch}")
    placed = ranked.join(F.broadcast(table), F.col("length") == F.col("p_length"))
    own = F.element_at(F.filter(F.col("stretches"), lambda s: s["first"] <= F.col("rank")), -1)
    placed = placed.withColumn("own", own).withColumn("nth", F.col("rank") - F.col("own.first"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return placed.select(
        *columns,
        (F.col("own.sequence") + F.floor(F.col("nth") / F.col("own.times"))).cast("long").alias("sequence_id"),
        (F.col("own.offset") + F.col("nth") % F.col("own.times") * F.col("length")).cast("long").alias("offset"),
        *[c for c in pieces.columns if c == "ids"],
    )
