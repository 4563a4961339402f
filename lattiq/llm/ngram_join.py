"""Jaccard self-join on word n-grams, by a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row per document and a column per n-gram.  It is never laid out whole:

1. *Columns.*  Tasks cut their documents' entries into blocks of columns (hash ranges), as many as the bytes of the input ask for.  Of a column
   that several documents of a batch have, one entry with their number goes out and the documents stay in the batch's own message, so a column
   that a third of all documents have costs an entry per batch.  A reducer merges a column block from all batches, counts each column (document
   frequency) and answers the batches with the columns that more than one document has.  Each row then keeps its *prefix*: with the columns
   ordered from rare to frequent, a partner must share one of the first ``n - ceil(t n) + 1``; columns of one document take places there but can
   have no partner.
2. *Candidates.*  Equal rows are one class, of which only the smallest id goes on.  Documents that share a prefix column
   are compared with the smallest of them, then only across the components found so far: what is linked
   already needs no further link, so a group of near copies costs its size, not its square.
3. *Product.*  The rows of documents with candidates are laid out once.  For the candidate pairs they are multiplied block by block: members' rows
   against a leader's row, by blocks of columns, overlap counts accumulating.  After each block the pairs are discarded whose count plus what
   is left of the shorter row stays below the bound that their sizes set.
4. Components of the links (``components``).

Exact but for 64-bit hashes.  Words are runs of non-blanks (ASCII white space), A-Z lower-cased; a text with fewer than n
words but at least one is one n-gram; a text without words (or null) has an empty set and no link.

Defined results: rows that share an id are one vertex; a row whose id is null links with nothing; repeated rows give
repeated results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components

#: Rows of a block of the incidence matrix, at most (blocks of long rows have fewer, see ``scratch.pieces_of``).
BLOCK_DOCS = 1024
#: Bytes of entries that a shuffle partition aims at, entry bytes per byte of stored text, and column blocks per partition.
PARTITION_BYTES, ENTRY_BYTES, BLOCKS_PER_PARTITION = 1 << 25, 2, 12
#: Column blocks within one product.
PRODUCT_BLOCKS = 4
#: Rows that a leader is multiplied with in one group, and rows of a group altogether.
LEADER_ROWS, GROUP_ROWS = 500, 2000
#: At most so many candidate rows (three numbers each) are broadcast; beyond, they are shuffled with the rows of their documents.
BROADCAST_ROWS = 400_000
#: Mark of an entry that stands for several documents of its batch.
SEVERAL = 0xFFFF
#: Words whose hashes a worker remembers.
MEMO = 150_000


@dataclass(frozen=True)
class Threshold:
    """similarity >= num / den, in whole numbers."""

    num: int = 85
    den: int = 100

    def least_overlap(self, a, b):
        """Smallest overlap of sets of sizes a and b that reaches the threshold."""
        return -(-(self.num * (a + b)) // (self.num + self.den))

    def prefix(self, n):
        return n - -(-(self.num * n) // self.den) + 1


class Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _factors(n: int) -> list[np.uint64]:
    """Odd multipliers, one per place in the n-gram."""
    return [np.uint64(xxhash.xxh3_64_intdigest(b"place%d" % i) | 1) for i in range(n)]


def ngram_set(text: str | None, n: int, memo: Memo) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.zeros(len(ids) - size + 1, np.uint64)
    for i, factor in enumerate(_factors(size)):
        total += ids[i : i + len(total)] * factor
    return np.unique(_mix(total + np.uint64(size)))


def _planes(keys: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, byte plane by byte plane (the first planes compress well)."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :6] = np.frombuffer(data, np.uint8).reshape(6, n).T
    return whole.view(">u8").reshape(n).astype(np.uint64)


BLOCK = pa.schema([("block", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
REPLY = pa.schema([("batch", pa.int64()), ("info", pa.bool_()), ("n", pa.int64()), ("data", pa.binary())])
ROWS = "doc_id long, n_shingles long, h1 long, h2 long, alone long, prefix array<long>"


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_batch(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Entries (sorted keys, row or ``SEVERAL``, how many rows those have) of a batch, and the rows of the latter as bytes."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    many = times > 1
    own = rows[first].copy()
    own[many] = SEVERAL
    inside = np.repeat(many, times)
    shared = times[many]
    data = np.array([len(shared), inside.sum()], np.int64).tobytes() + keys[first[many]].tobytes() + shared.astype(np.int64).tobytes() + rows[inside].tobytes()
    return keys[first], own, shared.astype(np.uint16), data


def _blocks_of(n: int, blocks: int):
    """Entries of the incidence matrix by column block, and each batch's ids, sizes, row hashes and shared columns as a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, number = Memo(), TaskContext.get().partitionId() << 24
        for part in scratch.pieces_of(batches, BLOCK_DOCS):
            number += 1
            ids = part.column(0)
            sets = [ngram_set(t, n, memo) for t in part.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            first = np.array([int(_mix(s ^ np.uint64(77)).sum(dtype=np.uint64)) for s in sets], np.uint64)
            second = np.array([int(_mix(s ^ np.uint64(9)).sum(dtype=np.uint64)) for s in sets], np.uint64)
            known = np.array([v is not None for v in ids.to_pylist()], np.uint8)
            info = ids.fill_null(0).to_numpy().astype(np.int64).tobytes() + sizes.tobytes() + first.tobytes() + second.tobytes() + known.tobytes()
            keys = np.concatenate(sets) & ~np.uint64(0xFFFF) if sets else np.empty(0, np.uint64)
            rows = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(keys)
            keys, rows, shared, inside = _in_batch(keys[order], rows[order])
            out = [[-number], [number], [len(sets)], [info + inside]]
            several = np.append(0, np.cumsum(rows == SEVERAL))
            block = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            edges = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[b], edges[b + 1]
                data = _planes(keys[lo:hi]) + rows[lo:hi].tobytes() + shared[several[lo] : several[hi]].tobytes()
                for column, value in zip(out, (b, number, hi - lo, data), strict=True):
                    column.append(value)
            yield _batch(out, BLOCK)

    return run


def _count_columns(table: pa.Table) -> pa.Table:
    """Replies to the batches of one column block: the entries of columns that more than one row has, with the number."""
    sizes, batches, data = table["n"].to_pylist(), table["batch"].to_pylist(), table["data"].to_pylist()
    if table["block"][0].as_py() < 0:
        return pa.Table.from_batches([_batch([batches, [True] * len(batches), sizes, data], REPLY)])
    keys = np.concatenate([_from_planes(d[: 6 * n], n) for d, n in zip(data, sizes, strict=True)])
    rows = np.concatenate([np.frombuffer(d, np.uint16, n, 6 * n) for d, n in zip(data, sizes, strict=True)])
    times = np.ones(len(keys), np.int64)
    times[rows == SEVERAL] = np.concatenate([np.frombuffer(d, np.uint16, offset=8 * n) for d, n in zip(data, sizes, strict=True)])
    _, inverse = np.unique(keys, return_inverse=True)
    count = np.minimum(np.bincount(inverse, times)[inverse], 0xFFFFFFFF).astype(np.uint32)
    out, at = [[], [], [], []], 0
    for batch, n in zip(batches, sizes, strict=True):
        mine = np.flatnonzero(count[at : at + n] > 1) + at
        if len(mine):
            payload = _planes(keys[mine]) + rows[mine].tobytes() + count[mine].tobytes()
            for column, value in zip(out, (batch, False, len(mine), payload), strict=True):
                column.append(value)
        at += n
    return pa.Table.from_batches([_batch(out, REPLY)])


def _spread(keys: np.ndarray, rows: np.ndarray, counts: np.ndarray, inside: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries with those that stand for several documents laid out again (``inside`` as by ``_in_batch``)."""
    m, total = np.frombuffer(inside, np.int64, 2).tolist()
    own, times = np.frombuffer(inside, np.uint64, m, 16), np.frombuffer(inside, np.int64, m, 16 + 8 * m)
    members = np.frombuffer(inside, np.uint16, total, 16 + 16 * m)
    many = np.flatnonzero(rows == SEVERAL)
    if not len(many):
        return keys, rows, counts
    count = np.zeros(m, np.uint32)
    count[np.searchsorted(own, keys[many])] = counts[many]
    one = rows != SEVERAL
    return (
        np.concatenate([keys[one], np.repeat(own, times)]), np.concatenate([rows[one], members]), np.concatenate([counts[one], np.repeat(count, times)])
    )


def _prefixes(threshold: Threshold):
    """Rows of a batch with the columns of their prefix that some other row has too."""

    def run(table: pa.Table) -> pa.Table:
        info, keys, rows, counts = b"", [], [], []
        for is_info, n, data in zip(table["info"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist(), strict=True):
            if is_info:
                info, docs = data, n
                continue
            keys.append(_from_planes(data[: 6 * n], n))
            rows.append(np.frombuffer(data, np.uint16, n, 6 * n))
            counts.append(np.frombuffer(data, np.uint32, n, 8 * n))
        ids, sizes, first, second = np.frombuffer(info, np.int64, 4 * docs).reshape(4, docs)
        known = np.frombuffer(info, np.uint8, docs, 32 * docs).astype(bool)
        prefix: list[np.ndarray] = [np.empty(0, np.int64)] * docs
        alone = sizes.copy()
        if keys:
            key, row, count = _spread(np.concatenate(keys), np.concatenate(rows), np.concatenate(counts), info[33 * docs :])
            order = np.lexsort((key, count, row))
            key, row = key[order], row[order]
            edges = np.searchsorted(row, np.arange(docs + 1))
            alone -= np.diff(edges)
            for i in np.flatnonzero(np.diff(edges)):
                room = threshold.prefix(int(sizes[i])) - int(alone[i])
                if room > 0:
                    prefix[i] = key[edges[i] : edges[i] + room].view(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=~known), "n_shingles": sizes, "h1": first, "h2": second,
                "alone": alone, "prefix": pa.array(prefix, pa.list_(pa.int64())),
            }
        )

    return run


def _overlaps(leader: np.ndarray, members: list[np.ndarray], threshold: Threshold) -> np.ndarray:
    """Which rows reach the threshold with the leader's row: product by column blocks, with early discards."""
    sizes = np.array([len(m) for m in members], np.int64)
    least = threshold.least_overlap(sizes, len(leader))
    alive = np.flatnonzero(np.minimum(sizes, len(leader)) >= least)
    overlap = np.zeros(len(members), np.int64)
    bounds = [np.uint64(i << 64 - 2) for i in range(1, PRODUCT_BLOCKS)]
    lead_edges = [0, *np.searchsorted(leader, bounds), len(leader)]
    edges = {i: [0, *np.searchsorted(members[i], bounds), len(members[i])] for i in alive}
    for b in range(PRODUCT_BLOCKS):
        if not len(alive):
            break
        column = leader[lead_edges[b] : lead_edges[b + 1]]
        parts = [members[i][edges[i][b] : edges[i][b + 1]] for i in alive]
        if len(column):
            entries = np.concatenate(parts)
            at = np.minimum(np.searchsorted(column, entries), len(column) - 1)
            owner = np.repeat(np.arange(len(alive)), [len(p) for p in parts])
            overlap[alive] += np.bincount(owner[column[at] == entries], minlength=len(alive))
        left = np.minimum([sizes[i] - edges[i][b + 1] for i in alive], len(leader) - lead_edges[b + 1])
        alive = alive[overlap[alive] + left >= least[alive]]
    found = np.zeros(len(members), bool)
    found[alive] = overlap[alive] >= least[alive]
    return found


def _verify_group(threshold: Threshold):
    def run(table: pa.Table) -> pa.Table:
        docs, leaders = table["v_doc"].to_pylist(), table["v_leader"].to_pylist()
        sets = [np.frombuffer(d, np.uint64) for d in table["grams"].to_pylist()]
        lead, rows = {}, {}
        for i, (doc, leader) in enumerate(zip(docs, leaders, strict=True)):
            (lead if doc == leader else rows).setdefault(leader, []).append(i)
        a, b = [], []
        for leader, own in lead.items():
            members = rows.get(leader, [])
            for i in own:
                found = _overlaps(sets[i], [sets[j] for j in members], threshold) if members else []
                a += [docs[j] for j, ok in zip(members, found, strict=True) if ok]
        # a link's other end is the leader of its rows
                b += [leader] * (len(a) - len(b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def laid_out(docs: DataFrame, ids: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(g_doc, grams) of the documents in ``ids(doc)``, and of few others: one scan of the texts, of which none is shuffled."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for part in scratch.pieces_of(batches):
            data = [ngram_set(t, n, memo).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["g_doc", "grams"])

    texts = docs.select(F.col(key).cast("long").alias("g_doc"), F.col(text).alias("g_text")).where("g_doc is not null")
    found = scratch.sifted(texts, F.col("g_doc"), scratch.sieve(ids, F.col("doc")), "g_hit").where("g_hit").drop("g_hit")
    return scratch.keep(found.mapInArrow(grams, "g_doc long, grams binary"), "grams")


def verified_links(grams: DataFrame, pairs: DataFrame, threshold: Threshold) -> DataFrame:
    """Of the candidate pairs (doc, leader), those that reach the threshold, as (a, b); ``grams`` by ``laid_out``."""
    pairs = scratch.keep(pairs, "pairs")
    fans = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / LEADER_ROWS).cast("int").alias("salts"))
    own_salt = F.pmod(F.xxhash64("v_doc"), F.col("salts")).cast("int")
    members = pairs.select(F.col("doc").alias("v_doc"), F.col("leader").alias("v_leader")).join(
        fans.withColumnRenamed("leader", "f_leader"), F.col("v_leader") == F.col("f_leader")
    )
    members = members.select("v_doc", "v_leader", own_salt.alias("v_salt"))
    heads = fans.select(
        F.col("leader").alias("v_doc"), F.col("leader").alias("v_leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("v_salt")
    )
    need = scratch.keep(members.unionByName(heads), "need")
    rows = need.count()
    groups = max(1, -(-rows // GROUP_ROWS))
    need = need.withColumn("v_group", F.pmod(F.xxhash64("v_leader", "v_salt"), F.lit(groups)))
    if rows <= BROADCAST_ROWS:
        need = F.broadcast(need)
    sets = grams.join(need, F.col("g_doc") == F.col("v_doc")).select("v_group", "v_doc", "v_leader", "grams")
    links = sets.groupBy("v_group").applyInArrow(_verify_group(threshold), "a long, b long")
    return scratch.keep(links, "verified")


def shuffle_partitions(docs: DataFrame, text: str) -> int:
    """Partitions for the entries of the incidence matrix: by the stored bytes of the texts, at least the session's number."""
    stored = int(str(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-stored * ENTRY_BYTES // PARTITION_BYTES), 1 << 17))


def incidence_rows(docs: DataFrame, n: int, threshold: Threshold, key: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, alone, prefix) per row; h1 and h2 identify the set, ``alone`` counts the columns that
    no other row has, after which ``prefix`` begins."""
    partitions = shuffle_partitions(docs, text)
    entries = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        _blocks_of(n, partitions * BLOCKS_PER_PARTITION), "block long, batch long, n long, data binary"
    )
    replies = entries.repartition(partitions, "block").groupBy("block").applyInArrow(_count_columns, "batch long, info boolean, n long, data binary")
    return replies.repartition(partitions, "batch").groupBy("batch").applyInArrow(_prefixes(threshold), ROWS)


def join_components(
    docs: DataFrame, n: int = 4, threshold: Threshold = Threshold(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    docs = scratch.located(docs)  # read twice, and its bytes set the number of partitions
    rows = scratch.keep(incidence_rows(docs, n, threshold, key, text), "incidence")
    usable = rows.where("doc_id is not null and n_shingles > 0")
    # kept as tables of their own, so that the joins with them can split hot keys
    classes = usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    classes = scratch.keep(classes.where("rep <> last").drop("last"), "class-reps")
    same = usable.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"])
    same = scratch.keep(same.where("doc_id <> rep").distinct(), "classes")
    # only the row of the class leaves: another row of the same id may hold another text
    firsts = usable.join(same, ["doc_id", "h1", "h2", "n_shingles"], "left_anti")
    posts = firsts.select(
        F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "alone", F.posexplode("prefix").alias("at", "gram")
    ).withColumn("tail", F.col("n") - F.col("alone") - F.col("at"))
    central = F.min(F.struct(F.col("n") - F.col("tail"), "doc"))["doc"]  # the document with the fewest rarer columns
    lists = posts.groupBy("gram").agg(central.alias("leader"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    lists = scratch.keep(lists.where("low <> high").select(F.col("gram").alias("l_gram"), "leader"), "lists")
    posts = posts.join(lists, F.col("gram") == F.col("l_gram")).select("doc", "n", "tail", "gram", "leader")
    posts = scratch.keep(posts, "posts")
    tried = scratch.keep(posts.where("doc <> leader").select("doc", "leader").distinct(), "tried")
    grams = laid_out(docs, posts.select("doc"), n, key, text)
    links = verified_links(grams, tried, threshold)
    links = links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    while True:
        labels = scratch.keep(connected_components(links), "labels")
        pairs = scratch.keep(_across(posts, labels, tried, threshold), "across")
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs)
        links = links.unionByName(verified_links(grams, pairs, threshold))
    labels = labels.select(F.col("id").alias("c_id"), "component")
    out = rows.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("c_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _across(posts: DataFrame, labels: DataFrame, tried: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (doc, leader) still to be compared: no link found so far joins their components, and a prefix
    column that they share leaves enough columns after it on both sides for the overlap that their sizes ask for (at
    the first column that a linked pair shares it does)."""
    marked = posts.join(labels, F.col("doc") == F.col("id"), "left").select(
        "doc", "n", "tail", "gram", F.coalesce("component", "doc").alias("part")
    )
    mixed = marked.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    mixed = scratch.keep(mixed.select(F.col("gram").alias("m_gram")), "mixed")
    open_ = marked.join(mixed, F.col("gram") == F.col("m_gram")).drop("m_gram")
    open_ = scratch.keep(open_, "open")
    other = open_.select(F.col("gram").alias("o_gram"), F.col("doc").alias("leader"), F.col("n").alias("m"), F.col("tail").alias("o_tail"), F.col("part").alias("o_part"))
    fits = F.least("tail", "o_tail") * (threshold.num + threshold.den) >= (F.col("n") + F.col("m")) * threshold.num
    pairs = open_.join(other, (F.col("gram") == F.col("o_gram")) & (F.col("doc") > F.col("leader")))
    pairs = pairs.where(fits & (F.col("part") != F.col("o_part"))).select("doc", "leader").distinct()
    return pairs.join(tried, ["doc", "leader"], "left_anti")


def one_of_each(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns."""
    stays = join_components(docs, key=key, **options).where("doc_id is null or doc_id = component_id")
    (kept,) = scratch.unused(docs, "join_kept")
    stays = stays.select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(stays, F.col(key).eqNullSafe(F.col(kept)), "left_semi")


def oracle_sql(n: int = 4, threshold: Threshold = Threshold()) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' ')) end) as g from w),
z as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
k as (select u, v from p join z a on a.doc_id = u join z b on b.doc_id = v where {threshold.den} * m >= {threshold.num} * (a.n + b.n - m)),
l as (select u, v from k union all select v, u from k),
c(v, d) using key (v) as (select doc_id, doc_id from documents union
  select l.v, min(c.d) from c join l on l.u = c.v left join recurring.c r on r.v = l.v group by l.v having min(c.d) < min(r.d))
select w.doc_id, coalesce(z.n, 0) as n_shingles, c.d as component_id from w left join z using (doc_id) join c on c.v = w.doc_id"""
