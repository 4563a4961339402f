"""Every operator on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import embedding_dedup, exact_dedup, language_id, mixing, ngram_join, packing, quality, queries, scratch, secret_scan, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, row long, size long, salt long, component string"
EXTRA = (1, 2, 3, 4, "x")
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def table(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(60)
    near = base.split()
    near[30] = "changed"
    rows = [(i, text(rng.randint(1, 400)), f"s{i % 3}") for i in range(20)]
    rows += [(20, None, None), (21, "", "s0"), (22, " \t\n", "s1"), (23, "one", "s0"), (24, "ONE", None), (25, "a b c", "s2")]
    rows += [(26, base, "s0"), (27, base.upper(), "s1"), (28, " ".join(near), "s0"), (29, base.replace(" ", "\n\t"), "s0")]
    rows += [(30, text(20_000), "s1"), (31, "x" * 50_000, "s2"), (None, base, "s0"), (None, None, None)]
    rows += [(19, "other text for an id that is there already", "s1"), (26, base, "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    table(spark, edge_rows()).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    table(spark, []).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def norm(text):
    return BLANK.sub(" ", text or "")


def words_of(text):
    return [w for w in BLANK.split(text or "") if w]


def test_packing(docs, none):
    rows = packing.pack(docs, ids=True).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    exact = packing.Encoder()
    for doc, text in {r.doc_id: r.text for r in docs.where("doc_id not in (19, 26)").collect() if r.doc_id is not None}.items():
        whole = [*exact.exact(text or ""), packing.END_ID]
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == whole and [r.start for r in own] == [s for s, _ in packing.cut(len(whole), 1024)]
        assert all(r.length == 1024 for r in own[1:])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_doc[26]) == 2 and len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fullest_bin_is_optimal(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(3, 40) for _ in range(14))
    chosen = packing.fullest(dict(counts), 64)
    assert all(counts[n] >= m for n, m in chosen.items()) and chosen[max(counts)] >= 1
    sums = {0}
    left = counts.copy()
    left[max(counts)] -= 1
    for n in left.elements():
        sums |= {s + n for s in sums if s + n <= 64 - max(counts)}
    assert sum(n * m for n, m in chosen.items()) == max(counts) + max(sums)
    plan = packing.plan_bins(dict(counts), 64)
    assert sum((Counter({n: m * t for n, m in c.items()}) for c, t in plan), Counter()) == counts


def brute_components(sets, num, den):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text, n):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_ngram_join_edges(docs, none):
    rows = ngram_join.join_components(docs).collect()
    assert len(rows) == docs.count()
    single = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (19, None)}
    sets = {i: shingles(t, 4) for i, t in single.items()}
    expected = brute_components(sets, 85, 100)
    for r in rows:
        if r.doc_id in sets:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id])
        assert r.doc_id is not None or r.component_id is None
    assert {r.component_id for r in rows if r.doc_id in (26, 27, 28, 29)} == {26}
    assert ngram_join.join_components(none).count() == 0
    kept = ngram_join.one_of_each(docs, n=5, threshold=ngram_join.Threshold(80, 100))
    assert kept.columns == docs.columns and not {27, 28, 29} & {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("num", [80, 85])
def test_ngram_join_random_groups(spark, num):
    """Near copies of several bases, many of them just around the threshold."""
    rng = random.Random(num)
    rows = []
    for b in range(4):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([12, 40, 90]))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"u{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own), "s"))
    sets = {i: shingles(t, 4) for i, t, _ in rows}
    found = ngram_join.join_components(table(spark, rows), threshold=ngram_join.Threshold(num, 100)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(sets, num, 100)


def test_ngram_join_keeps_other_texts_of_a_repeated_id(spark):
    words = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    near = " ".join([*words[1][:59], "changed"])
    a, b = map(" ".join, words)
    for rows in ([(3, a), (5, a), (5, b), (7, near)], [(3, b), (5, a), (5, b), (4, a), (7, near)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.component_id for r in ngram_join.join_components(docs).collect()} == {3}


def test_warc_round_trip_and_salvage(spark, tmp_path):
    big, small = "<p>" + "y" * 200, "<p>z"
    rows = [(5, "http://a", big), (3, None, big), (9, "http://b\r\nX: y", big), (1, "u", small), (2, "u", small), (4, "e", None), (None, "n", big), (7, "é", "ü" * 90)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest long")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        revisits = html == big and page != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisits else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0
    records = [warc.build_record(i, "u", b"p%d" % i * 50, hashlib.sha256(b"p%d" % i * 50).hexdigest(), len(b"p%d" % i * 50), None, False) for i in range(4)]
    import gzip

    for members in ([gzip.compress(r, mtime=0) for r in records], records):
        clean = b"".join(members)
        assert [x[0] for x in warc.salvage(clean)] == ["record"] * 4
        start = len(members[0])
        broken = bytearray(clean)
        broken[start + len(members[1]) - 40] ^= 0xFF  # inside the second record
        found = list(warc.salvage(bytes(broken)))
        assert [x[0] for x in found] == ["record", "gap", "record", "record"]
        assert found[1][1:3] == (start, start + len(members[1]))
        cut = list(warc.salvage(clean[: len(clean) - 30]))
        assert [x[0] for x in cut] == ["record"] * 3 + ["gap"] and cut[-1][2] == len(clean) - 30
        junk = list(warc.salvage(b"junk\r\n" + clean))
        assert junk[0][0] == "gap" and junk[0][1:3] == (0, 6) and len(junk) == 5
    (tmp_path / "a.warc.gz").write_bytes(b"junk" + gzip.compress(records[0], mtime=0))
    kinds = Counter(r.kind for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert kinds == {"gap": 1, "record": 1}


def test_warc_archives_end_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "CHUNKS", 2)
    rows = [(i, "u", random.Random(i).randbytes(700_000).hex()) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "out"))
    sizes = [f.stat().st_size for f in (tmp_path / "out").glob("*.txt")]
    assert len(sizes) > 1 and max(sizes) < 2 * (warc.CHUNK_BYTES + 800_000)
    found = warc.read_archives(spark, str(tmp_path / "out"), payloads=False).collect()
    assert sorted(r.payload_digest for r in found) == sorted(hashlib.sha256(h.encode()).hexdigest() for _, _, h in rows)
    monkeypatch.setattr(warc, "MOST_INFLATED", 50_000)
    import gzip

    content, _, fault = warc.inflate(gzip.compress(random.Random(1).randbytes(300_000)), 0)
    assert fault == "gzip member is too long" and len(content) >= 50_000


def test_warc_very_long_url(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://" + "u" * (1 << 21), "<p>"), (2, "v", "<p>")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(pages).collect()) == [1, 2]
    monkeypatch.setattr(warc, "write_archives", lambda rows, path: rows.selectExpr("'junk'").write.text(path))
    with pytest.raises(Exception, match="gap in an archive just written"):
        warc.round_trip(pages).collect()


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_a_member(level):
    import gzip

    data = [random.Random(i).randbytes(3000).hex().encode() for i in range(40)]
    records = [warc.build_record(i, "u", d, hashlib.sha256(d).hexdigest(), len(d), None, False) for i, d in enumerate(data)]
    ids = lambda found: [int(x[3]["warc-record-id"].strip("<>").rpartition(":")[2]) for x in found if x[0] == "record"]
    gaps = lambda found: [x[1:4] for x in found if x[0] == "gap"]
    bad = records[1].replace(b"Content-Length: ", b"Content-Size: ")
    whole = gzip.compress(b"".join([records[0], bad, *records[2:4]]), level, mtime=0)
    found = list(warc.salvage(whole + gzip.compress(records[4], mtime=0)))
    assert ids(found) == [0, 2, 3, 4] and len(gaps(found)) == 1 and gaps(found)[0][:2] == (0, len(whole))
    assert f"(bytes {len(records[0])} to {len(records[0] + bad)} of the content)" in gaps(found)[0][2]
    member, after = gzip.compress(b"".join(records), level, mtime=0), gzip.compress(b"".join(records[:2]), mtime=0)
    cut = list(warc.salvage(member[: len(member) * 3 // 4]))
    assert ids(cut) == list(range(len(ids(cut)))) and 28 <= len(ids(cut)) <= 30 and gaps(cut)[0][2] == "gzip member has no end"
    late = bytearray(member)
    late[-6] ^= 0xFF  # the checksum, after all of the content
    found = list(warc.salvage(bytes(late) + after))
    assert ids(found) == [*range(40), 0, 1] and len(gaps(found)) >= 1 and "gzip" in gaps(found)[0][2]
    lost = list(warc.salvage(member[: len(member) // 2] + after + records[39]))  # its second half is missing
    n = Counter(ids(lost))
    assert n[0] == n[1] == 2 and n[39] == 1 and all(n[i] == 1 for i in range(2, 18))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = np.repeat(centres, 8, axis=0) + rng.standard_normal((320, 16)) * rng.choice([0.0, 0.1, 0.3], (320, 1))
    rows = [(int(i), [float(v) for v in r], 1, 2) for i, r in enumerate(x.astype(np.float32))]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3, [float("inf")] * 16]
    rows += [(1000 + i, v, 1, 2) for i, v in enumerate(odd)] + [(None, rows[0][1], 1, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors).collect()}
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    assert sum(got[i].n_links for i in range(320)) >= 0.99 * linked.sum()
    assert all(got[i].n_links <= linked[i].sum() for i in range(320))
    for i in [*range(1000, 1000 + len(odd))]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows) and got[None].component_id is None
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id is not None)
    exact = embedding_dedup.near_duplicates(vectors, recall=1.0).collect()
    assert {r.vec_id: r.n_links for r in exact if r.vec_id is not None and r.vec_id < 1000} == {i: int(linked[i].sum()) for i in range(320)}
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_embeddings_recall_and_lengths(spark):
    """Links around the threshold among vectors that fill several regions, and two lengths in one table."""
    rng = np.random.default_rng(3)
    n = 20_000
    x = rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base, noise = x[:4000], rng.standard_normal((4000, 32))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = rng.uniform(0.94, 0.97, (4000, 1))
    x[-4000:] = near * base + np.sqrt(1 - near**2) * noise
    x = x.astype(np.float32)
    short = [[1.0, 1.0], [2.0, 2.0], [1.0, -1.0], [1.0, 1.01], [5.0], [7.0]]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(n + i, v) for i, v in enumerate(short)] + [(n + 6, short[2]), (n + 6, short[0])]
    got = {}
    for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r.vec_id] = r
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = np.concatenate([(unit[at : at + 2000] @ unit.T >= 0.95).sum(1) - 1 for at in range(0, n, 2000)])
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= linked).all() and found.sum() >= 0.99 * linked.sum() > 4000
    assert [got[n + i].component_id - n for i in range(7)] == [0, 0, 0, 0, 4, 4, 0]  # n + 6 has two vectors, which join [1, 1] and [1, -1]
    index = embedding_dedup.Index.fitted(unit[:5000], 100_000, 0.95, 0.998, 1)
    _, _, (query, region, cell) = index.place(unit[:500])
    assert len(np.unique(np.stack([query, region]), axis=1).T) < 12 * 500
    turned, cut = unit[:500] @ index.turn, 16
    one, two = (embedding_dedup.half_bounds(part, book)[1] for part, book in zip((turned[:, :cut], turned[:, cut:]), index.books, strict=True))
    for q in range(20):  # in the order of the traversal, nearest first, and none left out
        own = cell[query == q]
        sums = one[q, own // len(index.books[1])] + two[q, own % len(index.books[1])]
        assert (np.diff(sums) >= 0).all() and len(own) == (one[q][:, None] + two[q][None] <= index.radius).sum()


def test_embeddings_without_a_valid_vector(spark):
    rows = [(1, None), (2, [0.0]), (2, [float("nan"), 1.0])]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def plain_secrets(text):
    """The base kinds by the patterns as they are stated, match by match."""
    kinds = {
        "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
    }
    least, found = {"assign": 8, "access": 16, "hex": 32}, []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least[kind]:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], list(kinds).index(x[0])))


def test_secrets_against_a_plain_scan(spark):
    """Base spans of the given documents and of made ones, and the linked ones against all pairs of parts."""
    rng = random.Random(12)
    bits = ["password", "PassWD=", "secret:", " = ", '"', "token", "api_key", "APIKEY: ", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "x" * 9, "\n", "\n\n", "é", "ſ",
            "user=bob1", "login: alice", "Zx9kLm2PqR7tUv4wYz1BcD", "https://h.example/x", "db.local:5432", " ", "words and words " * 9]
    made = [(10**6 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for i in range(600)]
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = given.union(spark.createDataFrame(made, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secret_scan.scan(docs).collect():
        base = plain_secrets(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    for _ in range(300):
        spans = lambda k: sorted((s, s + rng.randint(1, 90), "x") for s in rng.sample(range(1000), k))
        some, others, breaks = spans(8), spans(6), sorted(rng.sample(range(1000), 5))
        runs = [(100, 300), (500, 900)]
        block = lambda at, b=breaks: sum(x <= at for x in b)
        run = lambda at: [i for i, (s, e) in enumerate(runs) if s <= at <= e]
        expected = [
            any((o[0] <= x[1] + 20 and o[1] >= x[0] - 20 and block(o[0]) == block(x[0])) or (run(x[0]) and run(x[0]) == run(o[0])) for o in others) for x in some
        ]
        assert secret_scan.near(some, others, breaks, 20, runs) == expected


def test_secrets_scopes_and_long_texts():
    import time

    kinds = lambda text: {s.split(":")[0] for s in secret_scan.scan_text(text)[4].split(",")} - {""}
    opaque, filler = "Zx9kLm2PqR7tUv4wYz1BcD", "\n".join(f"name{i} = {i}" for i in range(60))
    assert kinds(f"[db]\naccess_key_id = bob1\n\n# next\n{filler}\nvalue = {opaque}\nurl = https://h.example/x") == {"ident", "opaque", "endpoint"}
    assert kinds(f"access_key_id = bob1\n{'prose, no setting. ' * 30}\n\nvalue {opaque}") == set()
    assert kinds(f"user=alice1 {opaque} at db.example.com:5432, not a..b:5432 or :99") == {"ident", "opaque", "endpoint"}
    for run in ("a-" * 500_000, "a." * 500_000, "9" * 1_000_000, "a=b\n" * 250_000, "http:/" * 150_000, f"user=ab1 {opaque} " * 20_000):
        began = time.perf_counter()
        secret_scan.scan_text("user=alice " + run)
        assert time.perf_counter() - began < 6  # seconds where a quadratic pattern takes hours


def test_secrets(docs, none, spark):
    hexes, key = "0123456789abcdef" * 2, "AKIA" + "Q" * 16
    texts = [
        f"é Password: 'hunter2hunter2' and {hexes}", f"api_key={hexes}; {key}", "token: short", None, "paſſword=aaaaaaaaaa",
        f"user=alice key {key}\nZx9kLm2PqR7tUv4wYz1BcD at https://db.example.com:5432/x", "Zx9kLm2PqR7tUv4wYz1BcD alone", "secret=abcdefgh" * 3,
    ]
    rows = {r.doc_id: r for r in secret_scan.scan(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [(rows[i].n_assign, rows[i].n_access, rows[i].n_hex) for i in range(8)] == [
        (1, 0, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (1, 0, 0)
    ]
    assert rows[0].spans.startswith("assign:2:27,hex:") and rows[6].spans == ""
    assert {s.split(":")[0] for s in rows[5].spans.split(",")} == {"access", "ident", "opaque", "endpoint"}
    assert rows[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.scan(docs).count() == docs.count() and secret_scan.scan(none).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, none, weak):
    options = {"digest": lambda t: (F.length(t) % 7).cast("string"), "triggers": 3} if weak else {}
    rows = exact_dedup.exact_groups(docs, **options).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r.doc_id)
    seen = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = seen[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == dict.fromkeys(seen, 1)
    assert exact_dedup.exact_groups(none, **options).count() == 0
    kept = exact_dedup.deduplicated(docs, **options)
    assert kept.columns == docs.columns and sorted(norm(r.text) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_hits_the_state_of_earlier_triggers(spark, tmp_path):
    """Copies of one text in several files: as many triggers as files touch its key, and the locator of the smallest id stays."""
    schema = "row " + scratch.LOCATOR + ", id long, digest string"
    for part in range(4):
        rows = [((part, i), 100 - 10 * part + i, "same" if i == 0 else f"d{part}-{i}") for i in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    batches = []
    keep = exact_dedup.scratch.new_path
    exact_dedup.scratch.new_path = lambda s, name: batches.append(keep(s, name)) or batches[-1]
    try:
        states = exact_dedup.run_stream(spark, str(tmp_path / "landing"), spark.read.parquet(str(tmp_path / "landing")).schema, triggers=4)
    finally:
        exact_dedup.scratch.new_path = keep
    found = {r.digest: r for r in states.collect()}
    assert len(found) == 9 and (found["same"].group_size, found["same"].keep.id, tuple(found["same"].keep.row)) == (4, 70, (3, 0))
    touched = spark.read.parquet(batches[0]).where("digest = 'same'").select("group_size").collect()
    assert sorted(r.group_size for r in touched)[-1] == 4 and len(touched) > 1


def test_sieve(spark):
    keys = spark.range(0, 20_000, 7).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    found = scratch.sifted(rows, F.col("k"), scratch.sieve(keys, F.col("k")), "hit")
    assert found.where("k % 7 = 0 and not hit").count() == 0 and found.where("hit").count() < 2900
    assert scratch.sifted(rows, F.col("k"), scratch.sieve(keys.limit(0), F.col("k")), "hit").where("hit").count() == 0


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 100] * 50 + ["y" * 10_000] + ["z"] * 9})
    parts = list(scratch.pieces_of([batch], rows=40, most=1000))
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.nbytes <= 1000 or p.num_rows == 1 for p in parts) and max(p.num_rows for p in parts) <= 40


def test_sharding(docs, none, spark):
    rows = sharding.assign_shards(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.assign_shards(none).count() == 0
    for n in (1, 2, 3, 7, 100, 1000):
        df = spark.range(n).withColumn("p", sharding.permute(F.col("id"), n, 9))
        df = df.withColumn("back", sharding.permute(F.col("p"), n, 9, back=True))
        got = df.collect()
        assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)


def test_quality(docs, none, spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "inge", "thon", "rest"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["THE!!", "x$$$", "|", "ZZ%%"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(240)]
    learn = table(spark, rows)
    labels = spark.createDataFrame([(i, min(1, i % 3), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(learn, labels)
    out = quality.score(learn, model).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == min(1, r.doc_id % 3) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.accepted(learn, model).columns == learn.columns
    assert quality.score(none, model).count() == 0
    assert quality.fit(learn, labels.limit(0)).score == 0.5 and quality.fit(learn, labels.where("quality = 1")).network is None


def test_quality_vectors_and_score_by_hand(spark):
    """Vectors, pooling and probability recomputed token by token, and log loss and calibration on held-out rows."""
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("ba", "du", "ki", "Lo", "MA") for b in ("n", "ster", "x1", "!!", "")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(20)] + ["", "same same same", "x" * 500]
    seen = [Counter(), Counter()]
    for t in texts:
        for c, own in zip(seen, zip(*map(quality.hashes_of, set(t.split())), strict=True), strict=False):
            c.update(set(own))
    v = quality.Vocabulary(*[sorted(h for h, n in c.items() if n > 1) for c in seen])
    total = quality.contexts(iter(texts), v)
    index = quality.index_vectors(v.n_words, 1), quality.index_vectors(v.n_shapes, 2)
    expected = np.zeros_like(total)
    for t in texts:
        words, shapes = quality.token_ids(t, quality.Memo(v))
        assert len(words) == len(t.split())
        for i in range(len(words)):
            near = [j for j in range(max(0, i - 2), min(len(words), i + 3)) if j != i]
            around = sum((index[0][words[j]] + index[1][shapes[j]] for j in near), index[1][shapes[i]].copy())
            expected[words[i]] += around
            expected[v.n_words + shapes[i]] += around
    assert np.allclose(total, expected, atol=1e-3)
    words, shapes = quality.token_ids("same same same", quality.Memo(v))
    assert shapes[1] == shapes[2] == quality.SAME != shapes[0]
    rows = []
    for i in range(900):  # label 1 with a chance that depends on the text
        odd = rng.random()
        rows.append((i, " ".join(rng.choice(["zig", "zag"]) if rng.random() < odd else rng.choice(["the", "of"]) for _ in range(30)), int(rng.random() > odd)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    held = [(r.score, rows[r.doc_id][2], r.predicted) for r in quality.score(docs, model).collect() if r.held_out]
    p, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    bins = np.minimum((p * 5).astype(int), 4)
    gap = sum(abs(p[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    assert loss < 0.62 and gap < 0.12 and all(r[2] == (r[0] >= 0.3) for r in held)
    x = quality.pooled(rows[0][1], model.vectors, quality.Memo(model.vocabulary))
    net = model.network
    hidden = np.tanh(((x - net.mean) / net.scale) @ net.w1 + net.b1)
    assert model.scores([rows[0][1]], quality.Memo(model.vocabulary))[0] == pytest.approx(1 / (1 + np.exp(-(hidden @ net.w2 + net.b2) / net.temperature)))


def filled(sizes, most=3.0):
    """Targets by source, round by round in plain Python."""
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, free = {s: 1 + i % 3 for i, s in enumerate(ordered)}, {}, set(sizes)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        over = {s for s in free if weight[s] * left / sum(weight[f] for f in free) > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * left / sum(weight[f] for f in free) for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(words_of(r.text))) for r in docs.collect())
    targets = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 3 * r.size
    for n in (1, 64):  # the mix is the same for every number of partitions
        with scratch.settings(spark, {"spark.sql.shuffle.partitions": str(n), "spark.sql.files.maxPartitionBytes": str(10_000 * n)}):
            assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(none).count() == 0
    many = mixing.mixed_documents(docs)
    assert many.columns == docs.columns and sum(len(words_of(r.text)) for r in many.collect()) == sum(r.taken for r in rows)


def test_mixing_meets_its_targets(spark, tmp_path):
    """Ties, one document that holds most of its source, sources of few and of many documents."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([3, 3, 3, 7, 50, 400]), f"s{i % 4}") for i in range(1200)] + [(2000 + i, "w " * 5, "ties") for i in range(300)]
    rows += [(3000, "w " * 9000, "huge")] + [(3001 + i, "w " * rng.randint(1, 40), "huge") for i in range(300)]
    rows += [(4000 + i, "w " * (i + 1), "few") for i in range(12)] + [(5000, None, None), (5001, "w", None)]
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    found = mixing.mix(spark.read.parquet(str(tmp_path / "docs"))).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= max(10, 0.004 * goal), (source, goal, taken[source])
    # one prefix sum and one offset: within a tier, copies differ by at most one
    assert {r.copies for r in found if r.source == "ties"} <= {k for c in [min(r.copies for r in found if r.source == "ties")] for k in (c, c + 1, c + 2)}


def test_targets_fill_up(spark):
    fill = lambda rows: {r.source: r.target for r in mixing.fill_targets(spark.createDataFrame(rows, "source string, words long")).collect()}
    t = fill([("a", 10), ("b", 1), (None, 89)])
    assert t["b"] == 3 and sum(t.values()) == pytest.approx(100) and t[None] / t["a"] == pytest.approx(3)
    assert fill([("a", 0), ("b", 5)]) == {"a": 0, "b": pytest.approx(5)}
    rng = random.Random(8)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(40)}
    assert fill(list(sizes.items())) == pytest.approx(filled(sizes))


def test_language(docs, none, spark):
    words = {"en": ["the", "thing", "water", "which", "house"], "de": ["über", "nicht", "schön", "wasser", "haus"], "el": ["νερό", "σπίτι", "και"]}
    rng = random.Random(3)
    say = lambda lang, n=30: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang), lang, "s", 1) for i, lang in enumerate(["en", "de", "el"] * 40)] + [(900, "x", None, "s", 1)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    model = language_id.fit(learn)
    out = {r.doc_id: r for r in language_id.identify(learn, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang, _, _ in rows if lang) and all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    mixed = say("en") + "\n" + say("de", 50) + " 12 " + say("el", 10)
    got = language_id.identify(spark.createDataFrame([(1, mixed), (2, None), (3, "12 ..")], "doc_id long, text string"), model, spans=True)
    got = {r.doc_id: r for r in got.collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de", "el"] and got[1].lang_pred == "de"
    assert mixed[got[1].spans[1].start : got[1].spans[1].end].split()[0] in words["de"]
    assert (got[2].lang_pred, got[2].score, got[3].lang_pred) == ("und", 0.0, "und")
    assert language_id.identify(docs, model).count() == docs.count() and language_id.identify(none, model).count() == 0
    assert language_id.fit(none) is None and {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_language_reads_all_of_unspaced_text(spark):
    words = {"en": ["the", "thing", "water", "which", "house"], "de": ["über", "nicht", "schön", "wasser", "haus"]}
    signs = {"zh": "的是不了在人有我他这", "ja": "日本語東京駅新聞社員"}
    rng = random.Random(5)
    say = lambda lang, n, by=" ": by.join(rng.choice(words.get(lang) or signs[lang]) for _ in range(n))
    learn = [(i, say(lang, 60, " " if lang in words else ""), lang) for i, lang in enumerate(["en", "de", "zh", "ja"] * 40)]
    model = language_id.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    texts = {
        1: say("en", 50) + " " + say("de", 400, ","),  # long run, words joined by punctuation
        2: say("zh", 200, "") + say("ja", 600, ""),  # a switch after the first 200 letters
        3: say("en", 3, ".") + say("zh", 30, ""),  # a script change within a short token
        4: say("en", 45) + " " + say("de", 200, ""),  # one run of letters
    }
    got = language_id.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model, spans=True)
    got = {r.doc_id: r for r in got.collect()}
    assert [got[i].lang_pred for i in texts] == ["de", "ja", "zh", "de"]
    assert [[s.lang for s in got[i].spans] for i in texts] == [["en", "de"], ["zh", "ja"], ["en", "zh"], ["en", "de"]]
    assert got[2].score == pytest.approx(0.75, abs=0.06) and abs(got[2].spans[1].start - 200) <= language_id.LONGEST_WORD
    assert all(got[i].spans[-1].end == len(t) for i, t in texts.items())
    for token in ["don't", "नमस्ते" * 30, "a" * 1001 + "," * 90 + "é", "," * 300, "x中y", "İ" * 90, "...abc...中文..."]:
        own = language_id.words_in(token)
        assert "".join(own) == token and all(len(w) <= language_id.LONGEST_WORD or not language_id.letters_of(w) or sum(map(str.isalpha, w)) <= language_id.LONGEST_WORD for w in own)
    assert language_id.words_in("don't") == ["don't"]


def test_language_scores_words_of_the_same_letters_once(monkeypatch):
    rng = np.random.default_rng(2)
    languages, scripts = ["de", "en"], len(language_id.NAMES)
    table = np.vstack([rng.normal(-9, 1, (language_id.BUCKETS, 2)), np.zeros((1, 2))])
    model = language_id.Model(languages, table, np.ones((scripts, 2), bool))
    scored, plain = [], language_id.gram_buckets
    monkeypatch.setattr(language_id, "gram_buckets", lambda words: scored.extend(words) or plain(words))
    texts = ["Wasser, Haus", "(wasser) HAUS! --", "haus; 'Wasser' 12 x中y", "ΟΔΟΣ ΑΣ-Α İ. " + "wasser," * 9]
    words = language_id.Words(model)
    language_id.label_words(texts, model, words)
    assert sorted(scored) == sorted(set(scored)) and {"wasser", "haus", "x", "中", "y"} < set(scored)
    assert len(words.row_of) == words.used == len(scored) + 1
    for token in [t for text in texts for t in text.split()]:
        for word, row in zip(*words.rows([token]), strict=True):
            own = language_id.letters_of(word)
            assert words.weights[row] == len(own) and (not own or words.scores[row].tolist() == model.word_scores([own])[0].tolist())


def test_language_takes_tokens_apart_together_as_alone():
    rng = random.Random(6)
    signs = "abcXYZéßΣσςΑΟΔ'’.,-0|中文日本เरनाЖжİıȺ\u0301\u200d\xad"
    tokens = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 3, 5, 8, 40, 41, 90]))) for _ in range(4000)]
    letters, cut = language_id.letters_in(tokens)
    assert letters == [language_id.letters_of(t) for t in tokens]
    assert cut.tolist() == [len(language_id.words_in(t)) > 1 for t in tokens]


def test_viterbi_of_documents_of_all_lengths_together_as_alone():
    rng = np.random.default_rng(7)
    docs = [np.round(rng.normal(0, 4, (n, 3)), 1) for n in [0, 1, 700, 2, 0, 33, 33, 5]]
    for scores, path in zip(docs, language_id.decode(docs, 3.0), strict=True):
        total, back = np.zeros(3), []
        for row in scores:  # ties: stay, then the first language
            top = int(total.argmax())
            back.append([s if not back or total[s] >= total[top] - 3.0 else top for s in range(3)])
            total = np.array([total[b] - (0.0 if b == s else 3.0) for s, b in enumerate(back[-1])]) + row
        state, alone = int(total.argmax()), []
        for step in reversed(back):
            alone.append(state)
            state = step[state]
        assert path.tolist() == alone[::-1]


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(60):
        docs = [rng.normal(0, 2, (rng.integers(1, 6), 3)) for _ in range(3)]
        for scores, path in zip(docs, language_id.decode(docs, 2.5), strict=True):
            value = lambda p, s=scores: sum(s[i, x] for i, x in enumerate(p)) - 2.5 * sum(a != b for a, b in itertools.pairwise(p))
            best = max(itertools.product(range(3), repeat=len(scores)), key=value)
            assert value(path.tolist()) == pytest.approx(value(best))


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = rng.normal(0, 1, (rng.integers(1, 12), 3)) + rng.normal(0, 1, 3)
        best = int(scores.sum(0).argmax())
        path = language_id.decode([scores], 4.0)[0]
        value = lambda p, s=scores: s[np.arange(len(p)), p].sum() - 4.0 * (np.diff(p) != 0).sum()
        if not language_id.needs_decoding(scores, best, 4.0):
            assert value(path) == pytest.approx(scores[:, best].sum())
        assert value(path) >= scores[:, best].sum() - 1e-9


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op4_embedding_near_dedup"])
def test_queries_match_sql(spark, name):
    """Also on embeddings and documents of the given tables, whole."""
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = queries.queries()[name](spark, folder)
    columns = ", ".join(found.columns)
    expected = con.execute(f"select {columns} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_stages_leave_columns_with_their_own_names_alone(spark, docs, tmp_path):
    names = ["dedup_row", "dedup_kept_row", "join_kept", "mix_row", "mix_of", "mix_times", "mix_copy", "copies", "rows"]
    odd = docs.select("*", *[F.lit(n).alias(n) for n in names])
    odd.write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    for stage in (exact_dedup.deduplicated, ngram_join.one_of_each, mixing.mixed_documents):
        found = stage(odd)
        assert found.columns == odd.columns
        assert found.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == found.count() > 0


def test_mixing_copies_rows_that_share_an_id(spark, tmp_path):
    rows = [(i % 7, f"{'word ' * (i % 5)}{i}", f"s{i % 2}") for i in range(60)] + [(None, f"no id {i}", "s0") for i in range(5)]
    table(spark, rows).repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    number = docs.select("*", scratch.locator().alias("no"))
    copies = {r.row: r.copies for r in mixing.mix(docs).collect()}
    expected = Counter({r.text: copies[r.no] for r in number.collect() if copies[r.no]})
    assert Counter(r.text for r in mixing.mixed_documents(docs).collect()) == expected and expected


def test_locators_do_not_depend_on_splits(spark, docs):
    find = lambda: sorted(map(str, docs.select("doc_id", scratch.locator().alias("at")).collect()))
    before = find()
    assert len(set(before)) == docs.count()
    with scratch.settings(spark, {"spark.sql.files.maxPartitionBytes": "20000"}):
        assert find() == before
    assert scratch.located(docs) is docs
    made = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("twice"))  # a scan's numbers would repeat here
    assert exact_dedup.deduplicated(made).count() == exact_dedup.deduplicated(docs).count()
