"""Ranked search, byte-level BPE and periodic runs against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoka.llm import byte_bpe, lexical, periodic, queries

from .test_operators import AWKWARD, DATA, LONG, empty, lower, texts, words
from .test_operators import awkward, docs  # noqa: F401


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranking(rows, items, k=50):
    """(item, rank, doc_id, score) by scoring every document for every item."""
    every = [(i, Counter(terms(t))) for i, t in rows]
    every = [(i, c) for i, c in every if c]
    n, total = len(every), sum(sum(c.values()) for _, c in every)
    df = Counter(t for _, c in every for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        own = set(terms(text)) & set(df)
        found = []
        for i, c in every:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_search(spark, docs):  # noqa: F811
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = [(r.item_id, r.text) for r in items.collect()]
    found = searched(queries.op11_lexical_search(spark, DATA))
    assert found and found == ranking(texts(docs), rows)
    # Blocks and passes of any size give the same.
    index = lexical.build_index(docs, block_terms=500)
    assert index.blocks.count() > 20
    assert searched(lexical.search(index, items, k=3, max_terms=50)) == ranking(texts(docs), rows, 3)


def test_search_of_awkward_rows(spark, awkward):  # noqa: F811
    """Nulls, ties of repeated rows and null ids, items without terms, repeated items."""
    items = [(1, "One two THREE w1 w2 w976"), (1, "x"), (2, None), (3, "?! \n"), (4, "unseen"), (5, "licensed under the mit license w5 x x one")]
    items = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, rank int")
    rows = [(r.item_id, r.text) for r in items.collect()]
    for k in (1, 2, 50):
        found = searched(lexical.search(lexical.build_index(awkward, block_terms=7), items, k=k))
        assert found == ranking(texts(awkward), rows, k)
    assert lexical.search(lexical.build_index(empty(awkward)), items).count() == 0
    assert lexical.search(lexical.build_index(awkward), empty(items)).count() == 0


def test_search_bounds_hold(spark):
    """A byte's bounds enclose the exact score, and hold back most documents."""
    rng = np.random.default_rng(2)
    n, times = rng.integers(1, 30_000, 20_000), rng.integers(1, 400, 20_000)
    exact = lexical.impact(times, n, 1_000_000, 400_000_000)
    high = -(-exact // lexical.STEP) * lexical.STEP
    assert (high >= exact).all() and (high - exact < lexical.STEP).all() and high.max() // lexical.STEP <= 255
    assert [int(x) for x in exact[:50]] == [1_000_000_000 * int(t) // (1000 * int(t) + 20 * (50 + 50 * int(m) * 1_000_000 // 400_000_000)) for t, m in zip(times[:50], n[:50], strict=True)]


@pytest.fixture(scope="module")
def ranks_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library(ranks_path):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks_path), special_tokens={})


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_byte_bpe(request, which, ranks_path, library):
    df = request.getfixturevalue(which)
    ids = byte_bpe.encode_documents(df, ranks_path, block_bytes=20_000)
    assert sorted(((r.doc_id, list(r.ids)) for r in ids.collect()), key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t in texts(df)), key=str)
    back = byte_bpe.decode_documents(ids, ranks_path, block_ids=5_000)
    assert sorted(((r.doc_id, bytes(r.data)) for r in back.collect()), key=str) == sorted(((i, (t or "").encode()) for i, t in texts(df)), key=str)
    for frame in (df, empty(df)):
        found = [tuple(r) for r in byte_bpe.round_trip_digests(frame, ranks_path).collect()]
        want = [(i, library.encode_ordinary(t or ""), t or "") for i, t in texts(frame)]
        digests = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in want]
        assert sorted(found, key=str) == sorted(digests, key=str)


def test_byte_bpe_of_unknown_ids(spark, ranks_path):
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode_documents(spark.createDataFrame([(1, [5, 60_000])], "doc_id long, ids array<int>"), ranks_path).collect()
    assert bytes(byte_bpe.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), ranks_path).first().data) == b""


@pytest.mark.parametrize("long_from", [1, byte_bpe._LONG, 10**9])
def test_byte_bpe_words(monkeypatch, ranks_path, library, long_from):
    """Odd white space, endings after apostrophes, every class of characters, and
    words of vocabulary pieces; each by single steps and by those of long words."""
    monkeypatch.setattr(byte_bpe, "_LONG", long_from)
    encoder = byte_bpe.ByteEncoder(ranks_path)
    rng = np.random.default_rng(11)
    some = [*" \n\t\r'strevmldab19.,!?éñ中　\xa0\x1c\x85_-", "'s", "'ll", "'re", " '", " 's", "  ", "\n\n", "\U0001f600", "é", "\U00010d50", "the", " of", "՘"]
    pieces = [p.decode("utf-8", "ignore") for p in list(encoder.ranks)[::7]]
    made = ["".join(rng.choice(some, rng.integers(0, 60))) for _ in range(600)] + ["".join(rng.choice(pieces, rng.integers(1, 25))) for _ in range(600)]
    made += [x * n for x in ("ab", "x", "nd", "the", "中国") for n in (2, 7, 50)]
    ids, counts = encoder.encode(made)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in made]
    assert encoder.decode(ids, counts) == [t.encode() for t in made]


def test_byte_bpe_of_very_long_words(ranks_path, library):
    rng = np.random.default_rng(4)
    encoder = byte_bpe.ByteEncoder(ranks_path)
    for text in ("x" * 50_000, "ab" * 20_000, "".join(rng.choice(list("ndreatheblyonzß"), 5_000)), "".join(rng.choice(list("的一是在不了有和人这中大"), 5_000))):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_byte_bpe_forgets(monkeypatch, ranks_path, library):
    encoder = byte_bpe.ByteEncoder(ranks_path, limit=3)
    for text in ("one two three four five", "six seven one nonesuch", "one", ""):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)
    # Unlike matches of one hash are told apart.
    monkeypatch.setattr(byte_bpe.np, "add", type("same", (), {"reduceat": staticmethod(lambda x, at: np.zeros(len(at), np.uint64))}))
    assert byte_bpe.ByteEncoder(ranks_path).encode(["abc abd abe abc zzz"])[0].tolist() == library.encode_ordinary("abc abd abe abc zzz")


def all_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, p, n) for (s, n), p in out.items())


def test_runs_of_words():
    rng = np.random.default_rng(1)
    made = []
    for _ in range(600):
        w = rng.integers(0, rng.choice([1, 2, 3, 5, 40]), rng.choice([0, 1, 2, 11, 12, 13, 30, 70, 150])).tolist()
        if rng.random() < 0.5 and len(w) > 4:
            a = int(rng.integers(len(w)))
            p = 1 + int(rng.integers(max(1, (len(w) - a) // 2)))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        made.append(w)
    for group in (made, made[:1], made[50:52]):
        found = periodic.runs_of([np.array(w, np.int64) for w in group])
        assert [[(s, p, n) for s, n, p in r.tolist()] for r in found] == [all_runs(w) for w in group]


def reported(i, text, plant):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(i).encode()) if plant and i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    runs = all_runs(w)
    best = min(((-n, s, p) for s, p, n in runs), default=None)
    gone = {j for s, p, n in runs for j in range(s + p, s + n)}
    kept = " ".join(x for j, x in enumerate(w) if j not in gone)
    listed = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
    own = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (i, n, len(runs), *own, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), [list(r) for r in ((s, n, p) for s, p, n in runs)], kept


@pytest.mark.parametrize("block_words", [1, 5_000, 10**7])
def test_run_report(docs, block_words):  # noqa: F811
    config = periodic.PeriodicConfig(block_words=block_words)
    found = periodic.run_report(docs, config=config, change=periodic.planted)
    want = [reported(i, t, True) for i, t in texts(docs)]
    assert any(r[1] for r in want) and sorted(map(tuple, found.collect())) == sorted(r[0] for r in want)


def test_runs_of_awkward_rows(spark, awkward):  # noqa: F811
    """Null, empty, long and repeated texts, and one whose runs end at both ends."""
    some = [(i, t) for i, t in AWKWARD if t is None or len(t) < 10_000]
    some += [(20, "a b c " * 30), (21, "x y x y x y x y x y x y z"), (22, "q " + "r " * 11 + "r"), (None, "a b " * 9)]
    df = spark.createDataFrame(some, "doc_id long, text string").withColumn("runs", F.lit(1))
    want = [reported(i, t, False) for i, t in some]
    assert sorted(map(str, map(tuple, periodic.run_report(df).collect()))) == sorted(str(r[0]) for r in want)
    found = [(r.doc_id, r.n_words, [list(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(df).collect()]
    assert sorted(map(str, found)) == sorted(str((r[0][0], r[0][1], r[1], r[2])) for r in want)
    assert periodic.run_report(empty(awkward)).count() == 0
    # Words that come back every 977 words, 60,000 in all.
    long = {r.doc_id: r for r in periodic.run_report(awkward.where("doc_id in (7, 8)")).collect()}
    assert [(long[i].n_runs, long[i].start, long[i].length, long[i].period) for i in (7, 8)] == [(1, 0, 60_000, 977)] * 2
    assert long[7].collapsed_sha256 == hashlib.sha256(" ".join(LONG.split()[:977]).encode()).hexdigest()
