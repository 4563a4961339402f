"""Near-duplicate vectors by an inverted multi-index.

The unit vectors are turned by their principal axes, dealt out so that both halves carry as much information, and cut into the two halves,
each with a codebook of its own (k-means on a bounded sample); the pairs of codewords form a product grid and every vector lives
in one cell.  A query visits cells by a multi-sequence traversal: half-distances sorted per codebook, cells taken in the order of their sum.
The sums are lower bounds: a vector of codeword i is at least as far from the query as the plane between i and the query's own
codeword, and the squares of both halves add up.  The traversal stops where the target recall is reached: that sum is measured
on the sample, from its own true pairs and from pairs made at exactly the threshold in random directions; with target 1.0 it
is the squared distance that the threshold allows, which misses nothing.  Everything in the visited cells is verified in double precision.

Codebooks grow with the square root of the number of vectors, so a cell keeps its size.  Neighbouring codewords of the first half (of both halves, where
the first has too few) are grouped into regions: a query travels once to each region in which it visits a cell, with the list of those cells, however many they are.

Identical vectors are one class with a multiplicity.  Regions that hold many vectors, and regions that many queries visit, are cut
by salt into blocks of bounded size; a block reports a count per query and a star per component of its links, never all of
its pairs.

Vectors of different lengths are never linked; each length has an index of its own, all built in the same jobs (a number per length goes to the
driver).

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing; rows that share
an id are one vertex whose ``n_links`` counts rows; a null id has no links; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 20_000
#: Vectors that a cell and a region aim at, and the longest codebook of a half and of its groups.
CELL, REGION, LARGEST, MOST_GROUPS = 128, 8192, 1024, 64
#: Vectors or queries of a block, on average at most, and the bytes that they may take.
BLOCK, BLOCK_BYTES = 16_384, 1 << 25
#: Share of pairs at the threshold that the traversal has to reach, and the factor put on the sum measured for it.
RECALL, MARGIN = 0.998, 1.1
#: Sampled vectors whose true pairs are looked up in the sample.
PROBES = 4000
#: Links of a block that are turned into stars at a time.
LINKS_AT_ONCE = 1 << 21


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Codewords of Lloyd's iteration from a random start; an empty cluster keeps its codeword."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T * -2 + (centres**2).sum(1)).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def half_bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword of each half, and the squared distance to the plane towards every other codeword."""
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    own = d.argmin(1)
    norms = (centres**2).sum(1)
    apart = np.sqrt(np.maximum(norms[:, None] - 2 * centres @ centres.T + norms, 0))
    np.fill_diagonal(apart, 0)
    gap = d - d[np.arange(len(x)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart[own] > 0, gap / (2 * apart[own]), 0.0)
    return own, np.maximum(plane, 0) ** 2


def visits(first: np.ndarray, second: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, i, j) of the cells with first[query, i] + second[query, j] <= radius, per query in the order of that sum."""
    row, i = np.nonzero(first <= radius)
    row2, j = np.nonzero(second <= radius)
    counts = np.bincount(row2, minlength=len(first))
    starts = np.cumsum(counts) - counts
    times = counts[row]  # each i of a query meets each j of it
    query = np.repeat(row, times)
    place = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
    one, two = np.repeat(i, times), j[np.repeat(starts[row], times) + place]
    total = first[query, one] + second[query, two]
    near = np.flatnonzero(total <= radius)
    near = near[np.lexsort((total[near], query[near]))]
    return query[near], one[near], two[near]


def radius_for(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float, seed: int) -> float:
    """The sum of half bounds at which the share ``recall`` of linked pairs of the (turned) sample is reached, with a margin."""
    most = 2 - 2 * threshold + 1e-9
    if recall >= 1:
        return most
    rng, cut = np.random.default_rng(seed), x.shape[1] // 2
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    queries, others = [x], [threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * noise]
    for at in range(0, min(len(x), PROBES), 500):
        i, j = np.nonzero(x[at : min(at + 500, PROBES)] @ x.T >= threshold)
        some = np.flatnonzero(i + at != j)[:100_000]
        queries.append(x[i[some] + at])
        others.append(x[j[some]])
    reached = [most * 0]
    for q, o in zip(queries, others, strict=True):
        if not len(q):
            continue
        total = np.zeros(len(q))
        for part, book in ((slice(None, cut), books[0]), (slice(cut, None), books[1])):
            own = half_bounds(o[:, part], book)[0]
            total += half_bounds(q[:, part], book)[1][np.arange(len(q)), own]
        reached.append(float(np.quantile(total, recall)))
    return min(most, MARGIN * max(reached) + 1e-9)


def axes(x: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal axes of ``x``, the odd ones first: halves of like variance."""
    _, vectors = np.linalg.eigh(x.T @ x)
    return np.concatenate([vectors[:, ::-1][:, ::2], vectors[:, ::-1][:, 1::2]], axis=1)


@dataclass
class Index:
    """The product grid of the vectors of one length."""

    turn: np.ndarray
    books: tuple[np.ndarray, np.ndarray]
    groups: tuple[np.ndarray, np.ndarray]  # the group of each codeword
    radius: float

    @classmethod
    def fitted(cls, x: np.ndarray, n: int, threshold: float, recall: float, seed: int) -> Index:
        """From a sample ``x`` of ``n`` unit vectors."""
        dim = x.shape[1]
        k = int(min(LARGEST, round((n / CELL) ** 0.5)))
        if dim < 2 or k < 2 or len(x) < 2 * k:  # one cell
            return cls(np.eye(dim), (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))), (np.zeros(1, int), np.zeros(1, int)), 0.0)
        turn, cut = axes(x), dim // 2
        turned = x @ turn
        books = (kmeans(turned[:, :cut], k, seed), kmeans(turned[:, cut:], k, seed + 1))
        first = max(1, min(k, round(n / REGION)))  # the first half alone, as long as it has codewords enough
        second = max(1, min(MOST_GROUPS, round(n / REGION / first)))
        groups = tuple(half_bounds(book, kmeans(book, g, seed + 2))[0] for book, g in zip(books, (first, second), strict=True))
        return cls(turn, books, groups, radius_for(turned, books, threshold, recall, seed))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(region, cell) of each unit vector and the (query, region, cell) that they visit."""
        turned, cut, wide = x @ self.turn, x.shape[1] // 2, len(self.books[1])
        own1, near1 = half_bounds(turned[:, :cut], self.books[0])
        own2, near2 = half_bounds(turned[:, cut:], self.books[1])
        query, i, j = visits(near1, near2, self.radius)
        across = self.groups[1].max() + 1
        region = lambda a, b: self.groups[0][a] * across + self.groups[1][b]
        return region(own1, own2), own1 * wide + own2, (query, region(i, j), i * wide + j)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, smallest of its component) for all but the smallest vertex of each component of the links."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[one], label[two])
        after = label.copy()
        np.minimum.at(after, label[one], low)
        np.minimum.at(after, label[two], low)
        while (after[after] != after).any():
            after = after[after]
        after = after[label]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def classes_of(vectors: DataFrame, key: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows with the smallest id of their class, and the classes (rep, copies, dim, v)."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = rows.where(F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    # keyed by a digest, so that hot vectors meet as short rows and are summed up before the shuffle
    valid = valid.withColumn("digest", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))).cast("binary"), 256))
    classes = valid.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = scratch.keep(classes.withColumn("dim", F.size("v")), "vector-classes")
    of = valid.select("vec_id", "digest").join(classes.select("digest", "rep", "copies"), "digest")
    return of.select("vec_id", "rep", "copies"), classes.select("rep", "copies", "dim", "v")


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


PLACED = "dim int, region long, role int, rep long, copies long, cells binary, v binary"


def _placed(classes: DataFrame, indexes: dict[int, Index], dtype: str) -> DataFrame:
    """A row per class in its own region (``role`` 0), and per region where it visits cells as a query (``role`` 1)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in scratch.pieces_of(batches, 1024):
            dims = part.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                raw = part.column(3).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)
                home, cell, (query, region, seen) = indexes[dim].place(unit(raw))
                order = np.lexsort((region, query))  # stable: the order of the traversal within a region stays
                query, region, seen = query[order], region[order], seen[order].astype(np.uint32)
                first = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (region[1:] != region[:-1]))) if len(query) else np.empty(0, int)
                lists = [c.tobytes() for c in np.split(seen, first[1:])] if len(first) else []
                index = np.concatenate([np.arange(len(own)), query[first]])
                rows, data = own[index], [v.tobytes() for v in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(index), dim, np.int32)), pa.array(np.concatenate([home, region[first]]).astype(np.int64)),
                        pa.array(np.repeat([0, 1], [len(own), len(first)]).astype(np.int32)),
                        part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)),
                        pa.array([c.tobytes() for c in cell.astype(np.uint32)] + lists, pa.binary()), pa.array([data[i] for i in index], pa.binary()),
                    ],
                    names=["dim", "region", "role", "rep", "copies", "cells", "v"],
                )

    return classes.mapInArrow(place, PLACED)


def _product(threshold: float, dtype: str):
    """Counts per query and stars of the links of one block, cell by cell."""

    def run(table: pa.Table) -> pa.Table:
        role, rep, copies = (table[c].to_numpy() for c in ("role", "rep", "copies"))
        members, queries = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        cells = [np.frombuffer(c, np.uint32) for c in table["cells"].to_pylist()]
        total, stars, held = np.zeros(len(role), np.int64), [], []

        def flush() -> None:
            if held:
                stars.append(_stars(*(np.concatenate(side) for side in zip(*held, strict=True))))
                held.clear()

        if len(members) and len(queries):
            x = unit(np.stack([np.frombuffer(v, dtype) for v in table["v"].to_pylist()]))
            home = np.array([cells[i][0] for i in members])
            members = members[np.argsort(home, kind="stable")]
            home = np.sort(home)
            asked = np.concatenate([cells[i] for i in queries])
            asks = np.repeat(queries, [len(cells[i]) for i in queries])
            order = np.argsort(asked, kind="stable")
            asked, asks = asked[order], asks[order]
            for cell in np.unique(home):
                m = members[np.searchsorted(home, cell) : np.searchsorted(home, cell, "right")]
                every = asks[np.searchsorted(asked, cell) : np.searchsorted(asked, cell, "right")]
                for at in range(0, len(every), 1024):
                    q = every[at : at + 1024]
                    linked = x[q] @ x[m].T >= threshold
                    linked &= rep[q][:, None] != rep[m][None]
                    total[q] += linked @ copies[m]
                    i, j = np.nonzero(linked)
                    if len(i):
                        held.append((rep[q[i]], rep[m[j]]))
                    if sum(len(h[0]) for h in held) > LINKS_AT_ONCE:
                        flush()
            flush()
        some = np.flatnonzero(total)
        a = np.concatenate([rep[some], *(s[0] for s in stars)])
        b = np.concatenate([total[some], *(s[1] for s in stars)])
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(a) - len(some)])
        return pa.table({"kind": kind, "a": a.astype(np.int64), "b": b.astype(np.int64)})

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, recall: float = RECALL, key: str = "vec_id", embedding: str = "embedding",
    sample: int = SAMPLE, seed: int = 5,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    spark = vectors.sparkSession
    of, classes = classes_of(vectors, key, embedding)
    lengths = {r[0]: r[1] for r in classes.groupBy("dim").count().collect() if r[1] > 1}  # a row per length of a vector
    links = spark.createDataFrame([], "a long, b long")
    counts = spark.createDataFrame([], "q_rep long, near long")
    if lengths:
        classes = classes.where(F.col("dim").isin(*lengths))
        fitted: dict[int, list] = {dim: [] for dim in lengths}
        for r in classes.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(sample).select("dim", "v").collect():
            fitted[r[0]].append(r[1])
        indexes = {
            dim: Index.fitted(unit(np.array(v, np.float64).reshape(-1, dim)), lengths[dim], threshold, recall, seed) for dim, v in fitted.items()
        }
        dtype = "float32" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "float64"
        placed = _placed(classes, indexes, dtype)
        # at most LARGEST * MOST_GROUPS rows of counts per length
        sizes = placed.select("dim", "region", "role").groupBy("dim", "region").agg(F.sum(1 - F.col("role")).alias("members"), F.sum("role").alias("queries"))
        room = F.least(F.lit(BLOCK), F.lit(BLOCK_BYTES) / (8 * F.col("dim")))
        cuts_of = lambda n: F.ceil(F.col(n) / room).cast("int")
        cuts = sizes.where("members > 0 and queries > 0").select(
            F.col("dim").alias("c_dim"), F.col("region").alias("c_region"), cuts_of("members").alias("m_cuts"), cuts_of("queries").alias("q_cuts")
        )
        cuts = F.broadcast(scratch.keep(cuts, "cuts"))
        salted = placed.join(cuts, (F.col("dim") == F.col("c_dim")) & (F.col("region") == F.col("c_region")))
        one = lambda cuts: F.array(F.pmod(F.xxhash64("rep"), F.col(cuts)).cast("int"))
        every = lambda cuts: F.sequence(F.lit(0), F.col(cuts) - 1)
        member = F.col("role") == 0
        blocks = salted.withColumn("m_cut", F.explode(F.when(member, one("m_cuts")).otherwise(every("m_cuts"))))
        blocks = blocks.withColumn("q_cut", F.explode(F.when(member, every("q_cuts")).otherwise(one("q_cuts"))))
        found = blocks.select("dim", "region", "m_cut", "q_cut", "role", "rep", "copies", "cells", "v").groupBy("dim", "region", "m_cut", "q_cut")
        found = scratch.keep(found.applyInArrow(_product(threshold, dtype), "kind int, a long, b long"), "found")
        counts = found.where("kind = 0").groupBy(F.col("a").alias("q_rep")).agg(F.sum("b").alias("near"))
        links = found.where("kind = 1").select("a", "b")
    # rows of one id in several classes join them
    both = of.groupBy(F.col("vec_id").alias("o_id")).agg(F.min("rep").alias("b"), F.max("rep").alias("high")).where("b <> high")
    links = links.unionByName(of.join(both, F.col("vec_id") == F.col("o_id")).where("rep <> b").select(F.col("rep").alias("a"), "b"))
    labels = connected_components(links).select(F.col("id").alias("c_rep"), "component")
    known = of.join(counts, F.col("rep") == F.col("q_rep"), "left").join(labels, F.col("rep") == F.col("c_rep"), "left")
    known = known.groupBy("vec_id").agg(
        F.max(F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"), F.min(F.coalesce("component", "rep")).alias("comp")
    ).select(F.col("vec_id").alias("k_id"), "links", "comp")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id")).join(known, F.col("vec_id") == F.col("k_id"), "left")
    component = F.coalesce("comp", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def oracle_sql(threshold: float = 0.95) -> str:
    return f"""
with recursive x as (select vec_id, cast(embedding as double[]) as v from embeddings),
y as (select vec_id, v from x where len(v) > 0 and len(list_filter(v, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(v, lambda e: e <> 0)) > 0),
l as (select a.vec_id as u, b.vec_id as v from y a join y b on len(a.v) = len(b.v) and a.vec_id <> b.vec_id
      and case when len(a.v) = len(b.v) then list_cosine_similarity(a.v, b.v) end >= {threshold}),
n as (select u, count(*) as n from l group by 1),
c(v, d) using key (v) as (select vec_id, vec_id from embeddings union
  select l.v, min(c.d) from c join l on l.u = c.v left join recurring.c r on r.v = l.v group by l.v having min(c.d) < min(r.d))
select e.vec_id, coalesce(n.n, 0) as n_links, c.d as component_id, e.vec_id = c.d as kept
from embeddings e left join n on n.u = e.vec_id join c on c.v = e.vec_id"""
