"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Random indexing: every token has a sparse ternary index vector drawn from its hash; a token's word vector is the sum of the
index vectors of its neighbours over the fitting sample, scaled to length one.  Tokens are of two kinds: the
word (lower case, letters only) and its shape (runs of capitals, small letters and digits reduced to one mark each, other
characters as they are; a word that repeats the one before it has a shape of its own).  The vocabulary of each kind is counted: what
``LEAST_DOCS`` sampled documents have is an entry of its own, found by a 64-bit hash of the whole word or shape; all rarer ones share one.
A document is the mean of its tokens' vectors.  The network has one hidden layer (tanh) and a logistic
output; a temperature fitted on rows set aside turns its output into a calibrated probability of label 1.

The fit takes at most ``SAMPLE`` labelled rows (those with the smallest hashes of their ids); vectors and features of the sample
are made on the executors, the driver gets a vocabulary and tables of bounded size and one short vector per sampled row.

Defined results: null and empty texts are pooled as a zero vector and scored like any other; rows with a null label are not
learned from, of several labels of one id the smallest counts; with no labelled row the score is 0.5, with labels of one class only it
is that class's smoothed share; repeated rows get equal scores; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Labelled rows that the fit takes at most.
SAMPLE = 6000
#: Tasks that the sample is read by; each sends the driver one table of word vectors.
TASKS = 4
DIM, WINDOW = 64, 2
#: Entries of the vocabularies at most (the most frequent), and the sampled documents that an entry is found in at least.
MOST_WORDS, MOST_SHAPES, LEAST_DOCS = 1 << 15, 1 << 11, 2
#: Rows of the table of vectors that are summed up over the tasks at a time.
ROWS_AT_ONCE = 1 << 12
#: Rows of the vectors that all rare words or shapes share, and of the shape of a repeated word.
RARE, SAME = 0, 1
MEMO = 150_000
THRESHOLD = 0.3
FOLDS, HELD_FOLD = 5, 0


def shape_of(word: str) -> str:
    shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x", word))
    return re.sub(r"(.)\1{3,}", r"\1\1\1", shape)


def hashes_of(token: str) -> tuple[int, int]:
    """64-bit hashes of a token's word and shape."""
    letters = token if token.isalpha() else "".join(c for c in token if c.isalpha())
    return tuple(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in (letters.lower(), shape_of(token)))


class Hashes(dict):
    """token -> ``hashes_of`` it, of the tokens seen last."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        value = hashes_of(token)
        if len(token) <= 64:
            self[token] = value
        return value


class Vocabulary:
    """Rows of words and shapes by their hashes."""

    def __init__(self, words: list[int], shapes: list[int]):
        self.words = {h: i + RARE + 1 for i, h in enumerate(words)}
        self.shapes = {h: i + SAME + 1 for i, h in enumerate(shapes)}
        self.n_words, self.n_shapes = len(words) + RARE + 1, len(shapes) + SAME + 1


class Memo(dict):
    """token -> row of its word * n_shapes + row of its shape."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, 0

    def __missing__(self, token: str) -> int:
        if self.held >= 16 * MEMO:
            self.clear()
            self.held = 0
        self.held += 8 + len(token)
        word, shape = hashes_of(token)
        v = self.vocabulary
        value = self[token] = v.words.get(word, RARE) * v.n_shapes + v.shapes.get(shape, RARE)
        return value


def token_ids(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape rows of a text's tokens."""
    tokens = text.split() if text else []
    both = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
    words, shapes = both // memo.vocabulary.n_shapes, both % memo.vocabulary.n_shapes
    if len(words) > 1:
        again = np.flatnonzero((words[1:] == words[:-1]) & (words[1:] != RARE)) + 1
        rare = np.flatnonzero((words[1:] == RARE) & (words[:-1] == RARE)) + 1
        shapes[again] = SAME
        shapes[[i for i in rare.tolist() if hashes_of(tokens[i])[0] == hashes_of(tokens[i - 1])[0]]] = SAME
    return words, shapes


def index_vectors(n: int, seed: int, ones: int = 6) -> np.ndarray:
    """Sparse ternary vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    rows = np.arange(n)[:, None]
    places = rng.random((n, DIM)).argpartition(ones, axis=1)[:, :ones]
    out[rows, places] = rng.choice(np.array([-1, 1], np.float32), (n, ones))
    return out


def contexts(texts: Iterator[str | None], vocabulary: Vocabulary) -> np.ndarray:
    """Sums of the neighbours' index vectors, for words and then shapes."""
    index = (index_vectors(vocabulary.n_words, 1), index_vectors(vocabulary.n_shapes, 2))
    total = np.zeros((vocabulary.n_words + vocabulary.n_shapes, DIM), np.float32)
    memo = Memo(vocabulary)
    for text in texts:
        words, shapes = token_ids(text, memo)
        if not len(words):
            continue
        own = index[0][words] + index[1][shapes]
        around = np.zeros_like(own)
        for step in range(1, WINDOW + 1):
            around[step:] += own[:-step]
            around[:-step] += own[step:]
        # a word that repeats its neighbour, and odd shapes, speak for themselves as well
        around += index[1][shapes]
        for rows in (words, vocabulary.n_words + shapes):
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
            total[rows[order[first]]] += np.add.reduceat(around[order], first, axis=0)
    return total


def pooled(text: str | None, vectors: np.ndarray, memo: Memo) -> np.ndarray:
    words, shapes = token_ids(text, memo)
    if not len(words):
        return np.zeros(2 * DIM, np.float32)
    by_shape = np.bincount(shapes, minlength=memo.vocabulary.n_shapes)
    some = np.flatnonzero(by_shape)
    half = by_shape[some].astype(np.float32) @ vectors[memo.vocabulary.n_words + some]
    return np.concatenate([vectors[words].mean(0), half / np.float32(len(words))])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 60, batch: int = 128, seed: int = 3) -> Network:
    """Adam on the mean log loss with weight decay; a fifth of the rows is set aside for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, fit = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(
        x[fit].mean(0), x[fit].std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0
    )
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(rounds):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), batch):
            rows = fit[at : at + batch]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
            d = (p - y[rows]) / len(rows)
            dh = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[rows].T @ dh + 1e-3 * params[0], dh.sum(0), h.T @ d + 1e-3 * params[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= 3e-3 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(aside) and 0 < y[aside].mean() < 1:
        logits, ones = net.logits(x[aside]), y[aside].sum()
        # targets smoothed by one row of each class, so that rows that happen to be told apart without a fault set no limit of zero
        goal = np.where(y[aside] > 0, (ones + 1) / (ones + 2), 1 / (len(aside) - ones + 2))

        def loss(temperature: float) -> float:
            return float((goal * np.logaddexp(0, -logits / temperature) + (1 - goal) * np.logaddexp(0, logits / temperature)).mean())

        net.temperature = float(min(np.geomspace(0.125, 8, 121), key=loss))
    return net


@dataclass
class Model:
    """``vectors`` and ``network``, or a constant ``score`` where there was nothing to tell apart."""

    vectors: np.ndarray | None
    network: Network | None
    score: float = 0.5
    vocabulary: Vocabulary = field(default_factory=lambda: Vocabulary([], []))

    def scores(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.score)
        return self.network(np.stack([pooled(t, self.vectors, memo) for t in texts]).astype(np.float64))


def fold_of(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    known = labels.select(F.col(key).cast("long").alias("l_id"), F.col(label).cast("int").alias("l_y")).where("l_id is not null and l_y is not null")
    known = known.where(fold_of("l_id") != HELD_FOLD).groupBy("l_id").agg(F.min("l_y").alias("l_y"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(known), F.col("id") == F.col("l_id")).select("id", "text", "l_y")
    rows = scratch.keep(rows, "labelled").coalesce(TASKS)
    share = rows.agg(F.count(F.lit(1)), F.sum("l_y")).first()
    n, ones = share[0], share[1] or 0
    if not 0 < ones < n:
        return Model(None, None, (ones + 1) / (n + 2) if n else 0.5)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hashes = (Counter(), Counter()), Hashes()

        def counted() -> pa.RecordBatch:
            kinds = np.repeat(np.array([0, 1], np.int32), [len(c) for c in seen])
            columns = [kinds, [h for c in seen for h in c], [k for c in seen for k in c.values()]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["kind", "hash", "docs"])
            for c in seen:
                c.clear()
            return out

        for b in scratch.pieces_of(batches):
            for t in b.column(0).to_pylist():
                for c, own in zip(seen, zip(*map(hashes.__getitem__, set((t or "").split())), strict=True), strict=False):
                    c.update(set(own))
            if sum(map(len, seen)) > MEMO:
                yield counted()
        yield counted()

    found = scratch.keep(rows.select("text").mapInArrow(count, "kind int, hash long, docs long").groupBy("kind", "hash").agg(F.sum("docs").alias("docs")), "vocabulary")
    top = lambda kind, most: [r[0] for r in found.where((F.col("kind") == kind) & (F.col("docs") >= LEAST_DOCS)).orderBy(F.desc("docs"), "hash").limit(most).select("hash").collect()]
    vocabulary = Vocabulary(top(0, MOST_WORDS), top(1, MOST_SHAPES))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for b in scratch.pieces_of(batches) for t in b.column(0).to_pylist())
        total = contexts(texts, vocabulary)
        starts = range(0, len(total), ROWS_AT_ONCE)
        sums = [total[at : at + ROWS_AT_ONCE].tobytes() for at in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(sums, pa.binary())], names=["first", "sums"])

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(b, np.float32) for b in table["sums"].to_pylist())
        return pa.table({"first": table["first"][:1], "sums": pa.array([whole.tobytes()], pa.binary())})

    parts = rows.select("text").mapInArrow(gather, "first long, sums binary").groupBy("first").applyInArrow(add, "first long, sums binary")
    vectors = np.frombuffer(b"".join(r[1] for r in sorted(parts.collect())), np.float32).reshape(-1, DIM)  # one table of bounded size
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors = vectors.astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(vocabulary)
        for b in scratch.pieces_of(batches):
            x = [pooled(t, vectors, memo).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["id", "y", "x"])

    seen = rows.mapInArrow(features, "id long, y int, x binary").collect()
    seen.sort(key=lambda r: (r.id, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in seen]).astype(np.float64)
    return Model(vectors, train(x, np.array([r.y for r in seen], np.float64)), vocabulary=vocabulary)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.vocabulary)
        for b in scratch.pieces_of(batches):
            found = model.scores(b.column(1).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold_of("doc_id") == HELD_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns, without a shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.vocabulary)
        for b in scratch.pieces_of(batches):
            found = model.scores(b.column(at).to_pylist(), memo)
            yield b.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
