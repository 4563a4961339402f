"""Language identification of mixed text.

Texts are cut into words at blanks; what is still in several scripts or longer than a word (scripts without blanks, words joined by
punctuation) is cut further, and every letter belongs to some word.  A word's script narrows the candidates to the languages that
use it; each candidate scores the word by the log probabilities of its character n-grams.  Viterbi decoding with a penalty per
switch labels every word, which gives spans; the document's language is the one that most letters are labelled with.

Most documents need no decoding: where no stretch of words gains more than half a penalty in any other language
over the best single one, the single language is the best path (each excursion would cost more than it gains).  The others
are decoded together, a step for all of them at a time; each step keeps its totals only, and the paths follow from these run by run.

Tokens are taken apart many at a time, and words with the same letters are scored once.

Learned from at most about ``PER_LANGUAGE`` documents per language (those with the smallest hashes), counted on the executors.

Defined results: null texts and texts without a letter are ``und`` with score 0; with nothing learned, all are; the score is the
share of letters labelled with the language; ties go to the smallest code; repeated rows get equal results; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Documents per language that the model is learned from, on average at most.
PER_LANGUAGE = 1500
BUCKETS, LONGEST = 1 << 16, 4
PENALTY = 12.0
MEMO = 200_000
#: Letters of a word; tokens with more are cut into several words.
LONGEST_WORD = 40
#: Letters that are scored, words that are counted, tokens that are taken apart, words that are decoded (a document's together), at a time.
LETTERS_AT_ONCE, COUNTED_AT_ONCE, TOKENS_AT_ONCE, DECODED_AT_ONCE = 1 << 18, 1 << 16, 1 << 14, 1 << 17
FOLDS, HELD_FOLD = 4, 2
UNKNOWN = "und"
#: First code points of script ranges (fixed values of the Unicode block table) and the script from there on.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2C00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0x10000, "other"), (0x20000, "han"),
)
STARTS = [start for start, _ in SCRIPTS]
NAMES = sorted({name for _, name in SCRIPTS})


def script_of(letter: str) -> int:
    return NAMES.index(SCRIPTS[bisect_right(STARTS, ord(letter)) - 1][1])


def letters_of(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(c for c in token if c.isalpha()).lower()


class Kinds(dict):
    """character -> its script, ``GLUE`` for what stands inside words (marks, apostrophes, joiners), ``BREAK`` for the rest."""

    def __missing__(self, c: str) -> int:
        if c.isalpha():
            kind = script_of(c.lower()[0])
        else:
            kind = GLUE if c in "'\u2019" or unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") else BREAK
        self[c] = kind
        return kind


GLUE, BREAK, UNSEEN = -1, -2, -3
KINDS = Kinds()
#: The same by code point, as far as they were met.
KIND_OF = np.full(sys.maxunicode + 1, UNSEEN, np.int8)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kinds_of(points: np.ndarray) -> np.ndarray:
    kinds = KIND_OF[points]
    if (kinds == UNSEEN).any():
        for point in np.unique(points[kinds == UNSEEN]).tolist():
            KIND_OF[point] = KINDS[chr(point)]
        kinds = KIND_OF[points]
    return kinds


def letters_in(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    """``letters_of`` of each token (tokens hold no line ends), and whether ``words_in`` cuts it."""
    points = points_of("\n".join([*tokens, ""]))
    kinds = kinds_of(points)
    letter, end = kinds >= 0, points == ord("\n")
    starts = np.append(0, np.flatnonzero(end) + 1)[:-1]
    lowest, highest = np.minimum.reduceat(np.where(letter, kinds, np.int8(127)), starts), np.maximum.reduceat(kinds, starts)
    cut = (lowest < highest) & (highest >= 0) | (np.add.reduceat(letter, starts, dtype=np.int64) > LONGEST_WORD)
    # line ends are neither letters nor marks, so that no letter is lowered by what is in another token
    letters = points[letter | end].tobytes().decode("utf-32-le", "surrogatepass").lower()
    return letters.split("\n")[:-1], cut


def words_in(token: str) -> list[str]:
    """The token, or the words that it is cut into: a token of more than ``LONGEST_WORD`` letters or of several scripts is cut
    where the script changes, a long one also at punctuation and then into words of even lengths.  Together they are the token."""
    if len(token) <= LONGEST_WORD and token.isascii():
        return [token]
    kinds = kinds_of(points_of(token))
    at = np.flatnonzero(kinds >= 0)  # the letters
    if not len(at):
        return [token]
    script = kinds[at]
    first = np.append(True, script[1:] != script[:-1])  # letters that begin a run
    if len(at) > LONGEST_WORD:
        breaks = np.cumsum(kinds == BREAK)[at]
        first[1:] |= breaks[1:] != breaks[:-1]
        run = np.flatnonzero(first)
        lengths = np.diff(np.append(run, len(at)))
        parts = -(-lengths // LONGEST_WORD)
        place = np.arange(len(at)) - np.repeat(run, lengths)
        part = place * np.repeat(parts, lengths) // np.repeat(lengths, lengths)
        first[1:] |= part[1:] != part[:-1]
    starts = at[first].tolist()
    starts[0] = 0
    return [token[a:b] for a, b in zip(starts, [*starts[1:], len(token)], strict=True)]


def gram_buckets(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per n-gram length the bucket of every window over the words with their ends marked (``BUCKETS`` where a
    window leaves its word), and where each word starts."""
    points = points_of(f"^{'$^'.join(words)}$")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))
    hashed, found = np.zeros(len(points), np.uint32), []
    for n in range(1, LONGEST + 1):
        ahead = np.concatenate([points[n - 1 :], np.zeros(n - 1, np.uint32)])
        hashed = (hashed ^ ahead) * np.uint32(0x01000193) + np.uint32(n)
        mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append(np.where(left >= n, mixed >> np.uint32(16), BUCKETS).astype(np.int64))
    return found, starts


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log probabilities by bucket and language, and a row of zeros
    allowed: np.ndarray  # by script and language

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores per language of words of letters; a language that the script rules out gets far less than any candidate."""
        found, starts = gram_buckets(words)
        scores = sum(np.add.reduceat(self.table[b], starts, axis=0) for b in found) / LONGEST
        candidates = self.allowed[[KINDS[w[0]] for w in words]]
        candidates[~candidates.any(1)] = True
        least = np.where(candidates, scores, np.inf).min(1, keepdims=True)
        return np.where(candidates, scores, least - 2 * PENALTY)


class Words(dict):
    """token -> row of ``scores`` and ``weights`` (its letters), the same for tokens of the same letters; row 0 is that of tokens
    without letters.  A token that is cut has the row -1 - i, its words are ``cut[i]``."""

    def __init__(self, model: Model):
        self.model = model
        self.scores, self.weights, self.used = np.zeros((1024, len(model.languages))), np.zeros(1024), 1
        self.row_of = {"": 0}  # by letters
        self.cut: list[list[str]] = []
        self.held = 0  # characters of the tokens

    def learn(self, token_lists: list[list[str]]) -> None:
        """Give a row to every token that has none yet."""
        if len(self) > MEMO or self.held > MEMO * LONGEST_WORD:
            self.clear()
            self.cut.clear()
            self.row_of = {"": 0}
            self.used, self.held = 1, 0
        new = list(set().union(*token_lists).difference(self))
        for at in range(0, len(new), TOKENS_AT_ONCE):
            tokens = new[at : at + TOKENS_AT_ONCE]
            self.held += sum(map(len, tokens))
            letters, cut = letters_in(tokens)
            if cut.any():
                whole = [(t, w) for t, w, c in zip(tokens, letters, cut.tolist(), strict=True) if not c]
                for i in np.flatnonzero(cut).tolist():
                    own = words_in(tokens[i])
                    self.cut.append(own)
                    self[tokens[i]] = -len(self.cut)
                    whole += [(w, letters_of(w)) for w in own if w not in self]
                tokens, letters = [t for t, _ in whole], [w for _, w in whole]
            self.add(letters)
            self.update(zip(tokens, map(self.row_of.__getitem__, letters), strict=True))

    def add(self, words: list[str]) -> None:
        """Score the words of letters that have no row yet."""
        words = list(set(words).difference(self.row_of))
        while self.used + len(words) > len(self.weights):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
        for at in range(0, len(words), LETTERS_AT_ONCE // LONGEST_WORD):
            some = words[at : at + LETTERS_AT_ONCE // LONGEST_WORD]
            rows = slice(self.used, self.used + len(some))
            self.scores[rows] = self.model.word_scores(some)
            self.weights[rows] = [len(w) for w in some]
            self.row_of.update(zip(some, range(rows.start, rows.stop), strict=True))
            self.used = rows.stop

    def rows(self, tokens: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of the tokens and their rows."""
        found = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if not len(found) or found.min() >= 0:
            return tokens, found
        tokens = [w for t, row in zip(tokens, found.tolist(), strict=True) for w in (self.cut[-1 - row] if row < 0 else (t,))]
        return tokens, np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def needs_decoding(scores: np.ndarray, best: int, penalty: float) -> bool:
    """Could an excursion from the best single language pay? (Largest gain of any stretch in any language.)"""
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain]), axis=0)[:-1]
    return bool((gain - low).max() > penalty / 2)


def decode(all_scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Viterbi paths of several documents, a step of all of them at a time (longest first, so that ended ones drop off)."""
    if not sum(map(len, all_scores)):
        return [np.empty(0, np.int64)] * len(all_scores)
    order = sorted(range(len(all_scores)), key=lambda i: -len(all_scores[i]))
    lengths = np.array([len(all_scores[i]) for i in order])
    starts = np.cumsum(lengths) - lengths
    words = np.arange(lengths.sum()) - np.repeat(starts, lengths)  # the number of each word in its document
    by_step = np.argsort(words, kind="stable")
    step = np.concatenate([all_scores[i] for i in order])[by_step]
    ends = np.cumsum(np.bincount(words)).tolist()
    # from here on ``step`` holds the totals: of the paths that end with this word in this language
    before, a = 0, ends[0]
    for b in ends[1:]:
        old, now = step[before : before + b - a], step[a:b]
        switch = np.maximum.reduce(old, axis=1, keepdims=True)
        switch -= penalty
        now += np.maximum(old, switch)
        before, a = a, b
    total = np.empty_like(step)
    total[by_step] = step
    top = total.argmax(1)
    stay = total >= total.max(1, keepdims=True) - penalty
    # by word and language, the last word up to here after which a path in this language comes from another
    left = np.maximum.accumulate(np.where(stay, -1, np.arange(len(total))[:, None]), axis=0)
    paths: list[np.ndarray] = [np.empty(0, np.int64)] * len(order)
    for i, start, length in zip(order, starts.tolist(), lengths.tolist(), strict=True):
        path, at = np.empty(length, np.int64), start + length - 1
        while at >= start:
            state = top[at]
            switched = max(int(left[at - 1, state]), start - 1) if at > start else start - 1
            path[switched + 1 - start : at + 1 - start] = state
            at = switched
        paths[i] = path
    return paths


def label_words(texts: list[str | None], model: Model, words: Words, penalty: float = PENALTY):
    """(words, labels, weights) per text; labels index the model's languages."""
    out, open_, waiting = [], [], 0

    def close() -> None:
        for (i, _), path in zip(open_, decode([s for _, s in open_], penalty), strict=True):
            out[i][1] = path
        open_.clear()

    split = [t.split() if t else [] for t in texts]
    words.learn(split)
    for i, tokens in enumerate(split):
        tokens, rows = words.rows(tokens)
        scores, weights = words.scores[rows], words.weights[rows]
        best = int(scores.sum(0).argmax()) if len(tokens) else 0
        out.append([tokens, np.full(len(tokens), best), weights])
        if len(tokens) and needs_decoding(scores, best, penalty):
            open_.append((i, scores))
            waiting += len(tokens)
            if waiting > DECODED_AT_ONCE:
                close()
                waiting = 0
    close()
    return out


def spans_of(text: str, tokens: list[str], labels: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, language) of runs of equally labelled words, in code points."""
    if len(tokens) and (labels == labels[0]).all():
        start = text.index(tokens[0])
        return [(start, text.rindex(tokens[-1]) + len(tokens[-1]), languages[labels[0]])]
    spans, at = [], 0
    for token, label in zip(tokens, labels.tolist(), strict=True):
        start = text.index(token, at)
        at = start + len(token)
        if spans and spans[-1][2] == languages[label]:
            spans[-1] = (spans[-1][0], at, languages[label])
        else:
            spans.append((start, at, languages[label]))
    return spans


def counted_words(tokens: Counter) -> Iterator[tuple[str, int]]:
    """The words of letters in counted tokens, and how often each is there (a word may come several times)."""
    pairs = list(tokens.items())
    for at in range(0, len(pairs), TOKENS_AT_ONCE):
        some = pairs[at : at + TOKENS_AT_ONCE]
        letters, cut = letters_in([t for t, _ in some])
        for (token, times), own, is_cut in zip(some, letters, cut.tolist(), strict=True):
            if is_cut:
                yield from ((letters_of(w), times) for w in words_in(token))
            else:
                yield own, times


def fold_of(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(fold_of("id") != HELD_FOLD, F.lit(True)))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, per_language / counts[name])))])
    fraction = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(fraction < share[F.col("lang")]).select("text", "lang")
    n, scripts = len(languages), len(NAMES)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {name: Counter() for name in languages}
        table, used = np.zeros((BUCKETS, n), np.float32), np.zeros((scripts, n), np.float32)

        def add(j: int, counted: Counter) -> None:
            counted.pop("", None)
            pairs = list(counted.items())
            counted.clear()
            for at in range(0, len(pairs), LETTERS_AT_ONCE // LONGEST_WORD):
                some = pairs[at : at + LETTERS_AT_ONCE // LONGEST_WORD]
                times = np.array([k for _, k in some], np.float64)
                buckets, starts = gram_buckets([w for w, _ in some])
                lengths = np.diff(np.append(starts, len(buckets[0])))
                for b in buckets:
                    table[:, j] += np.bincount(b, np.repeat(times, lengths), BUCKETS + 1)[:BUCKETS]
                for word, n_word in some:
                    used[script_of(word[0]), j] += n_word

        for b in scratch.pieces_of(batches):
            tokens = {name: Counter() for name in languages}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens[name].update(t.split())
            for j, name in enumerate(languages):
                for w, n_word in counted_words(tokens.pop(name)):
                    seen[name][w] += n_word
                    if len(seen[name]) > COUNTED_AT_ONCE:
                        add(j, seen[name])
        for j, name in enumerate(languages):
            add(j, seen[name])
        if used.any():
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes() + used.tobytes()], pa.binary())], names=["total"])

    total = np.zeros(BUCKETS * n + scripts * n, np.float64)
    # tables of fixed size, one per task
    for r in sample.repartition(6).mapInArrow(gather, "total binary").collect():
        total += np.frombuffer(r[0], np.float32)
    table, used = total[: BUCKETS * n].reshape(BUCKETS, n) + 0.5, total[BUCKETS * n :].reshape(scripts, n)
    allowed = used > 0.01 * np.maximum(used.sum(0), 1)
    return Model(languages, np.vstack([np.log(table / table.sum(0)), np.zeros((1, n))]), allowed)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score[, spans]) for every row of ``docs``."""
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<start: long, end: long, lang: string>>" if spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model) if model else None
        for b in scratch.pieces_of(batches):
            texts = b.column(1).to_pylist()
            names, scores, all_spans = [], [], []
            labelled = label_words(texts, model, words) if model else [([], np.empty(0, np.int64), np.empty(0))] * len(texts)
            for t, (tokens, labels, weights) in zip(texts, labelled, strict=True):
                whole = float(weights.sum())
                share = np.bincount(labels, weights, len(model.languages)) if whole else np.zeros(1)
                names.append(model.languages[int(share.argmax())] if whole else UNKNOWN)
                scores.append(float(share.max() / whole) if whole else 0.0)
                if spans:
                    own = spans_of(t, tokens, labels, model.languages) if whole else []
                    all_spans.append([{"start": s, "end": e, "lang": name} for s, e, name in own])
            columns = [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
                columns.append(pa.array(all_spans, pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    found = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, schema)
    held = F.coalesce(fold_of("doc_id") == HELD_FOLD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), *found.columns[1:])
