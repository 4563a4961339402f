"""Secret scan with multipart credential linking.

Strong candidates stand alone: ``assign`` (a password-like name, a sign, a value), ``access`` (an access key id)
and ``hex`` (a long hexadecimal run).  Weak ones are parts that mean little by themselves: ``ident`` (a user or
client name given as a setting), ``opaque`` (a run that looks random) and ``endpoint`` (a URL or host with port).
A weak candidate is reported only where complementary parts meet in one scope: an opaque run with an access
identifier, an identifier with a secret, an endpoint with both.  Scopes of a part are ``REACH`` characters around it within its
block (blocks end at blank lines), and the whole section of settings that it stands in: consecutive lines of the form name = value or
name: value, blank lines and section titles between them included, of whatever length.  Parts meet through an interval join, by one sweep
over sorted intervals.

Defined results: a null text is empty and has no spans; the hash of no spans is that of the empty string;
repeated rows give repeated results; an empty table gives an empty table; other columns are not read.
Offsets count code points, ends are exclusive.  No shuffle: each text is scanned whole where it is read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENT = re.compile(
    r"""(?:client_?id|key_?id|user(?:_?name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
URL = re.compile(r"""(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", re.ASCII)
HOST = re.compile(r"(?<![a-z0-9.-])[a-z0-9.-]+:\d{2,5}\b", re.ASCII)  # read run by run, each once; checked by ``is_host``
BLANK = re.compile(r"\n[\x20\t\r]*\n")
SETTING = re.compile(r"""[\x20\t]*["']?[\w.-]{1,64}["']?[\x20\t]*[:=].*""", re.ASCII)
TITLE = re.compile(r"[\x20\t]*(?:\[[^\]\n]{1,64}\]|[#;].*|[{}],?)?[\x20\t\r]*")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ident", "opaque", "endpoint")
REACH = 200
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, str]


def strong_spans(text: str) -> list[Span]:
    """The base kinds; matching whole runs and dropping short ones is the same as asking for long runs."""
    low, spans = text.lower(), []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def looks_random(value: str, bits: float = 3.5) -> bool:
    if not (any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in (value.count(c) for c in set(value))) >= bits


def is_host(value: str) -> bool:
    """Is ``value`` (before its port) a dotted name without empty parts?"""
    parts = value.rpartition(":")[0].split(".")
    return len(parts) > 1 and all(parts)


def sections(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs of settings lines; titles, comments and blank lines do not end a run but are no part of its ends."""
    found, at, lines = [], 0, 0
    start = end = 0
    for line in text.split("\n"):
        if SETTING.fullmatch(line.rstrip("\r")):
            start, lines, end = (at, 1, at + len(line)) if not lines else (start, lines + 1, at + len(line))
        elif not TITLE.fullmatch(line):
            if lines > 1:
                found.append((start, end))
            lines = 0
        at += len(line) + 1
    if lines > 1:
        found.append((start, end))
    return found


def near(spans: list[Span], others: list[Span], breaks: list[int], reach: int, runs: list[tuple[int, int]] = ()) -> list[bool]:
    """For each span, does another one lie within reach in its block, or in its section? Both lists are sorted by start.

    One sweep: the others are taken up to the last that starts within reach, and of those of a block the farthest end decides.
    """
    starts = [s for s, _ in runs]
    section = lambda at: i if (i := bisect_right(starts, at) - 1) >= 0 and at <= runs[i][1] else -1
    held = {section(s) for s, _, _ in others} - {-1} if runs else set()
    found, at, farthest = [], 0, {}
    ahead = sorted(spans, key=lambda x: x[1])  # in the order of their reach to the right
    answer = {}
    for s, e, kind in ahead:
        while at < len(others) and others[at][0] <= e + reach:
            block = bisect_right(breaks, others[at][0])
            farthest[block] = max(farthest.get(block, -1), others[at][1])
            at += 1
        answer[s, e, kind] = farthest.get(bisect_right(breaks, s), -math.inf) >= s - reach
    for span in spans:
        found.append(answer[span] or bool(held) and section(span[0]) in held)
    return found


def linked_spans(text: str, strong: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that complementary parts near them make credible."""
    idents = [(m.start(), m.end(), "ident") for m in IDENT.finditer(text)]
    access = [x for x in strong if x[2] == "access"]
    identifiers = sorted(access + idents)
    if not identifiers:
        return []
    secrets = [x for x in strong if x[2] != "access"]
    taken = sorted(strong + idents)
    opaque = [(m.start(), m.end(), "opaque") for m in OPAQUE.finditer(text) if looks_random(m[0])]
    covered = near(opaque, taken, [], -1) if taken else [False] * len(opaque)  # overlaps a part already named
    opaque = [x for x, over in zip(opaque, covered, strict=True) if not over]
    scope = ([m.start() for m in BLANK.finditer(text)], reach, sections(text))
    opaque = [x for x, ok in zip(opaque, near(opaque, identifiers, *scope), strict=True) if ok]
    all_secrets = sorted(secrets + opaque)
    idents = [x for x, ok in zip(idents, near(idents, all_secrets, *scope), strict=True) if ok]
    known = sorted(access + idents)
    ends = [(m.start(), m.end(), "endpoint") for m in URL.finditer(text)]
    ends += [(m.start(), m.end(), "endpoint") for m in HOST.finditer(text) if is_host(m[0])]
    ends = [x for x, before in zip(sorted(ends), accumulate((e for _, e, _ in sorted(ends)), max, initial=0), strict=False) if x[0] >= before]
    both = zip(ends, near(ends, known, *scope), near(ends, all_secrets, *scope), strict=True)
    return [*opaque, *idents, *(x for x, a, b in both if a and b)]


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    strong = strong_spans(text)
    counts = [sum(kind == k for _, _, kind in strong) for k in BASE]
    base = joined(strong)
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), joined(strong + linked_spans(text, strong)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for part in scratch.pieces_of(batches):
            found = [scan_text(t) for t in part.column(1).to_pylist()]
            columns = zip(*found, strict=True)
            arrays = [part.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)
