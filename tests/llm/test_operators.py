"""The training-data operators against brute force, and on awkward tables."""

import base64
import gzip
import hashlib
import io
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from evoka.llm import chat, exact_dedup, licenses, mixing, near_dedup, packing, quality, queries, toxicity, warc, word_bpe
from evoka.llm.common import new_folder, written

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
AWKWARD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "One TWO"), (6, "one two"), (6, "one two"), (6, "other words entirely"),
    (7, LONG), (8, LONG + " end"), (None, "no id at all here"), (None, None), (9, "Licensed under the Apache License, Version 2.0."),
    (10, "a\x00b éß中\U0001f600 <|im_end|> <\\|x|>"), (11, "the mit license and the MIT  License"), (12, "x " * 50),
]


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names."""
    clash = "row run lane digest key node n hits places _id value block bucket component parts rate first".split()
    rows = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None) for i, t in AWKWARD], "doc_id long, text string, lang string")
    return rows.select("*", *[F.lit("x").alias(c) for c in clash])


def empty(df):
    return df.where("false")


def texts(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1


def rules(text):
    w = words(text)
    n = len(w)
    at = defaultdict(list)
    for i in range(n - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeated = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            duplicates += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(repeated), n < 20 or 100 * len(repeated) > 30 * n


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_quality_rules(request, which):
    df = request.getfixturevalue(which)
    found = quality.quality_report(df, quality.fit_references(df)).collect()
    own = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert own == sorted((i if i is not None else -1, *rules(t)) for i, t in texts(df))
    assert not any(r.kept and r.base_failed for r in found)


def test_quality_keeps_ordinary_texts_and_drops_symbol_soup(spark, docs):
    refs = quality.fit_references(docs)
    ordinary = [r.text for r in docs.where("lang = 'en'").collect() if not rules(r.text)[5] and rules(r.text)[2] == 0][:40]
    soup = [" ".join(f"{w}$$$%%%###" for w in words(t)) for t in ordinary[:10]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(ordinary + soup)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.keep_quality(df, refs).collect()}
    assert len(kept & set(range(len(ordinary)))) >= 0.95 * len(ordinary)
    assert not kept & set(range(len(ordinary), len(ordinary) + 10))


def test_quality_words_decide(spark):
    """Texts of rare words go at every length where chance can't explain them;
    clean ones of the same lengths stay, also far under 100 words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    refs = quality.fit_references(docs)
    limits = quality.word_limits(refs)
    none = np.append(np.zeros(quality.N_COMMON), 1.0)
    assert all(quality.js_distance(none, refs.words[k]) > own[min(n, len(own) - 1)] for k, own in limits.items() for n in (50, 100, 150, 1000))
    clean = [r.text for r in docs.where("lang = 'en'").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id").collect() if not rules(r.text)[5]]
    clean = [" ".join(words(t)[:n]) for t in clean[:60] for n in (40, 80, 150) if len(words(t)) >= n]
    junk = [" ".join("".join(rng.choice(list("aeinorstdlmu"), 6)) for _ in range(n)) for n in (50, 80, 120, 150) for rng in [np.random.default_rng(n)]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(junk + clean)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.quality_report(df, refs).collect()}
    assert not any(found[i].kept or found[i].base_failed for i in range(len(junk)))
    by_words = [found[i].word_distance > limits["en"][min(found[i].n_words, len(limits["en"]) - 1)] for i in range(len(junk), len(found))]
    assert len(by_words) > 50 and np.mean(by_words) <= 0.02


def test_quality_verdicts_by_brute_force(spark, docs):
    """References, both distances, limits and verdicts anew, in plain Python."""
    limits = quality.QualityLimits()
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    marks = "".join(chr(b) for b in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])

    def classes(text):
        of = [sum("a" <= c <= "z" for c in text), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text), sum(c in " \t\n\v\f\r" for c in text), sum(c in ".,;:'\"!?-()" for c in text), 0, sum(ord(c) > 127 for c in text)]
        of[5] = len(text) - sum(of)
        return of

    def common(text, key):
        own = quality.COMMON_WORDS["en" if key == "*" else key][:30]
        w = Counter(x.strip(marks) for x in words(lower(text)))
        found = [w[x] for x in own]
        return [*found, len(words(text)) - sum(found)]

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))

    sums = {}
    for _, text, lang in rows:
        key, c, n = lang if lang in quality.COMMON_WORDS else "*", classes(text), len(words(text))
        if n >= 20 and rules(text)[2] <= 0.02 * sum(c) and c[1] <= 0.3 * (c[0] + c[1] + c[6]):
            own = sums.setdefault(key, [[], []])
            own[0].append([x / sum(c) for x in c])
            own[1].append([x / n for x in common(text, key)])
    mean = {k: [[sum(x) / len(x) for x in zip(*h, strict=True)] for h in v] for k, v in sums.items()}
    word_limit = quality.word_limits(quality.References({}, {k: np.array(v[1]) for k, v in mean.items()}), limits)
    found = {r.doc_id: r for r in quality.quality_report(docs, quality.fit_references(docs)).collect()}
    for i, text, lang in rows:
        key, n, failed = lang if lang in quality.COMMON_WORDS else "*", len(words(text)), rules(text)[5]
        by_char = distance(classes(text), mean[key][0]) if len(text) >= 200 else None
        by_word = distance(common(text, key), mean[key][1]) if n >= 20 else None
        assert found[i].char_distance == pytest.approx(by_char, abs=1e-9) and found[i].word_distance == pytest.approx(by_word, abs=1e-9)
        ok = (by_char is None or by_char <= (0.2 if len(text) >= 500 else 0.3)) and (by_word is None or by_word <= word_limit[key][min(n, len(word_limit[key]) - 1)])
        assert found[i].kept == (not failed and ok)


def test_js_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0


# 2


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_exact_dedup(request, which):
    df = request.getfixturevalue(which)
    groups = defaultdict(list)
    for i, t in texts(df):
        groups[lower(t)].append(i)
    want = sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids)) for ids in groups.values() for i in ids)
    found = exact_dedup.exact_dedup(df, largest=True, fan_in=2).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    assert exact_dedup.drop_copies(df).count() == len(groups)
    assert exact_dedup.drop_copies(df).columns == df.columns


def test_exact_dedup_of_many_rows_without_ids(spark, docs):
    """A third of the rows has no id, some ids and rows repeat: of each text one
    row stays, the one with the smallest id, and texts are exchanged once."""
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))).union(docs.where("doc_id % 5 = 0")).union(docs.where("doc_id % 7 = 0").withColumn("doc_id", F.lit(1).cast("long")))
    odd = written(odd, "odd")
    want = {}
    for i, t in texts(odd):
        own = want.setdefault(lower(t), i)
        if i is not None and (own is None or i < own):
            want[lower(t)] = i
    left = exact_dedup.drop_copies(odd)
    assert sorted((lower(t), str(i)) for i, t in texts(left)) == sorted((t, str(i)) for t, i in want.items())
    left.collect()
    assert "ReusedExchange" in left._jdf.queryExecution().executedPlan().toString()


# 3


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_license_scan(request, which):
    df = request.getfixturevalue(which)
    phrases = [(p.split(), label) for p, label in licenses.BASE_PHRASES.items()]

    def base(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        hits = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in hits]
        return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    rows = licenses.scan_licenses(df)
    found = rows.collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found))) == sorted(map(str, ((i, *base(t)) for i, t in texts(df))))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()


def test_license_templates(spark):
    rows = [(1, "Code. Licensed under the Apache License, Version 2.0. More."), (2, "apache"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files")]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "apache,apache-2.0" and found[1].score > 0.9
    assert found[2].labels == "" and found[2].score == 0
    assert found[3].labels == "mit" and found[3].base_labels == ""


def test_license_notices_of_one_file_do_not_hide_each_other(spark):
    notices = [t.text for t in licenses.TEMPLATES]
    notice = {t.label: t.text for t in licenses.TEMPLATES}
    four = [notices[0], notices[2], notice["bsd"], notice["cc-by-4.0"]]
    rows = [(1, ". Then ".join(four)), (2, ". Then ".join(notices))] + [(3 + i, f"common text {x}") for i, x in enumerate([notices[0], notice["cc-by-4.0"]] * 40)]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found[1].labels.split(",")) == {"apache", "cc-by", "apache-2.0", "mit", "bsd", "cc-by-4.0"} and found[1].score > 0.9
    assert {t.label for t in licenses.TEMPLATES} <= set(found[2].labels.split(","))


def test_license_labels_and_scores_by_brute_force(spark):
    """Every alignment of every template, tried word by word on whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0").select("doc_id", "text")
    extra = [(-1 - k, f"aaa {t.text} bbb {t.text.replace('license', 'licence')}") for k, t in enumerate(licenses.TEMPLATES)] + [(-100, " ".join(t.text for t in licenses.TEMPLATES))]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    each = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) for i, t in texts(docs)]
    df = Counter(w for _, ws in each for w in set(ws))
    value = lambda w: math.log((len(each) + 1) / (df[w] + 1)) + 1e-9
    plans = []
    for t in licenses.TEMPLATES:
        own = t.text.split()
        rare = set(sorted({w for w in own if w not in licenses.STOP}, key=lambda w: (-value(w), w))[:16])
        keys = [(own_at, p) for p in (k.split() for k in t.key_phrases) for own_at in [next(i for i in range(len(own)) if own[i : i + len(p)] == p)]]
        plans.append((t.label, [(at, w, value(w)) for at, w in enumerate(own) if w in rare], keys))
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    phrases = [(p.split(), label) for p, label in licenses.BASE_PHRASES.items()]
    n_labelled = 0
    for i, ws in each:
        labels = {label for p, label in phrases if any(ws[k : k + len(p)] == p for k in range(len(ws)))}
        best, at = 0.0, lambda k, ws=ws: ws[k] if 0 <= k < len(ws) else None
        for label, postings, keys in plans:
            at0, first = keys[0]
            for start in (k - at0 for k in range(len(ws)) if ws[k : k + len(first)] == first):
                if all(ws[max(0, start + a) : start + a + len(p)] == p and start + a >= 0 for a, p in keys):
                    share = sum(v for a, w, v in postings if at(start + a) == w) / sum(v for _, _, v in postings)
                    if share >= 0.5:
                        labels.add(label)
                        best = max(best, min(1.0, share))
        n_labelled += best > 0
        assert found[i].labels == ",".join(sorted(labels)) and found[i].score == pytest.approx(best, abs=1e-6)
    assert n_labelled > 20


# 4


def test_toxicity_scores_by_brute_force(spark, docs):
    """The score of every text anew from the weights, word by word."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, text in texts(docs):
        counts = Counter()
        for w in re.findall(rb"[a-z\x80-\xff]+", lower(text).encode()):
            counts.update([zlib.crc32(x) & (2**18 - 1) for x in {w, w[:4] + b"*", w[:5] + b"*", w[:6] + b"*"}])
        z = model.bias + sum(model.weights[k] * math.log1p(n) for k, n in counts.items())
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=2e-6)
        assert found[i].predicted == (found[i].score >= 0.7)


def test_toxicity_sample_of_a_repeated_id(spark):
    """An id on most rows is one row of the sample, and does not fill it."""
    rows = [(7, f"kill them all {k % 5}") for k in range(300)] + [(100 + k, f"calm words number {k} of many") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(7, 1), *[(100 + k, 0) for k in range(60)]], "doc_id long, toxic int")
    seen = []
    original = toxicity.fit_rows
    try:
        toxicity.fit_rows = lambda p, u, *rest: seen.append((len(p[0]), len(u[0]))) or original(p, u, *rest)
        toxicity.fit_toxicity(docs, labels)
    finally:
        toxicity.fit_rows = original
    assert seen[0][0] <= 1 and 20 < seen[0][1] <= 61


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = found.score.rank().to_numpy()
    y = found.toxic.to_numpy() == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.85
    assert found[~y].predicted.mean() < 0.03


def test_nnpu_gradient():
    rng = np.random.default_rng(0)
    p, u, prior = rng.normal(1, 1, 20), rng.normal(0, 1, 50), 0.2

    def risk(p, u):
        part = np.mean(np.logaddexp(0, u)) - prior * np.mean(np.logaddexp(0, p))
        return prior * np.mean(np.logaddexp(0, -p)) + max(0, part)

    gp, gu = toxicity.nnpu_gradient(p, u, prior)
    step = 1e-6 * np.eye(20)[3]
    assert gp[3] == pytest.approx((risk(p + step, u) - risk(p - step, u)) / 2e-6, rel=1e-4)
    assert gu.sum() == pytest.approx(np.mean(1 / (1 + np.exp(-u))), rel=1e-6)


def test_toxicity_on_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1), (7, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(awkward, labels)
    found = toxicity.score_toxicity(awkward, model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_toxicity(empty(awkward), toxicity.fit_toxicity(empty(awkward), empty(labels))).count() == 0


# 5


def test_warc_round_trip(spark):
    html = [(i, f"http://x/{i}", t) for i, t in AWKWARD if i is not None and t != "other words entirely"] + [(20, None, None), (21, "a\r\nb", "one two")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(1))
    folder = new_folder(spark, "warc")
    warc.write_warc(pages, folder)
    payloads = {i: (t or "").encode() for i, _, t in html}
    best = {}
    for i, p in payloads.items():
        best[p] = max(i, best.get(p, i))
    found = warc.verified_records(warc.read_warc(spark, folder)).collect()
    assert len(found) == len(html)
    for r in found:
        p = payloads[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if best[p] == r.page_id else ("revisit", best[p]))
    some = warc.read_warc(spark, folder, partition_bytes=1000).where("record_type = 'response'")
    assert {r.payload for r in some.collect()} == set(best)
    assert warc.read_warc(spark, folder, payload=False).where("payload is not null").count() == 0


def test_warc_of_repeated_and_null_ids(spark):
    """A row is a record whatever its id: ids with several payloads, rows that
    repeat wholly, rows without an id."""
    rows = [(6, "aaa"), (6, "bbb"), (9, "aaa"), (10, "bbb"), (10, "bbb"), (9, None), (None, "aaa"), (None, None), (3, "")]
    pages = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in rows], "page_id long, url string, html string").repartition(4)
    folder = new_folder(spark, "warc")
    warc.write_warc(pages, folder)
    best = {}
    for i, t in rows:
        if i is not None:
            best[t or ""] = max(i, best.get(t or "", i))
    want = [(str(i), len(t or ""), "revisit" if i is not None and i != best[t or ""] else "response", str(best[t or ""] if i is not None and i != best[t or ""] else None)) for i, t in rows]
    found = warc.verified_records(warc.read_warc(spark, folder)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in found) == sorted(want)


def test_warc_queries_pages(spark):
    found = queries.op5_warc(spark, DATA).collect()
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    best = defaultdict(int)
    for r in pages:
        best[r.html or ""] = max(r.page_id, best[r.html or ""])
    want = [(r.page_id, len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode(), "response" if best[r.html or ""] == r.page_id else "revisit", None if best[r.html or ""] == r.page_id else best[r.html or ""]) for r in pages]
    assert sorted(map(tuple, found)) == sorted(want)


class Counted(io.BytesIO):
    """Bytes that tell how many of them were read."""

    taken = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def archive(n: int, n_bytes: int) -> bytes:
    record = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:x-page:{}>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    return "".join(record.format("resource" if k % 10 else "metadata", k, n_bytes, "x" * n_bytes) for k in range(n)).encode()


def test_warc_steps_over_unwanted_payloads():
    data = archive(50, 200_000)
    source = Counted(data)
    rows = list(warc.read_records(source, {"record_type": {"metadata"}}, True))
    assert [r[1] for r in rows] == [f"<urn:x-page:{k}>" for k in range(0, 50, 10)] and all(len(r[-1]) == 200_000 for r in rows)
    assert source.taken < 0.25 * len(data)
    source = Counted(data)
    assert len(list(warc.read_records(source, {}, False))) == 50 and source.taken < 0.15 * len(data)
    for cut in (len(data) - 100_000, len(data) - 200_050):
        with pytest.raises(ValueError, match="cut short"):
            list(warc.read_records(Counted(data[:cut]), {}, False))


def test_warc_reads_gzip_and_pushes_filters(spark, tmp_path):
    (tmp_path / "crawl-1.warc.gz").write_bytes(gzip.compress(archive(20, 3000)) + gzip.compress(archive(10, 70_000)))
    (tmp_path / "crawl-2.warc").write_bytes(archive(30, 50))
    records = warc.read_warc(spark, f"file://{tmp_path}")
    assert records.count() == 60
    some = records.where("record_type = 'metadata'")
    assert some.count() == 6 and {len(r.payload) for r in some.collect()} == {3000, 70_000, 50}
    assert warc.read_warc(spark, f"file://{tmp_path}", pattern="*.warc").count() == 30
    reader = warc.WarcReader({"files": "/a 1\n/b 2"})
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("payload",), b"")])) == [EqualTo(("payload",), b"")]
    assert reader.wanted == {"record_type": {"response"}} and len(reader.partitions()) == 1 and not pickle.loads(pickle.dumps(reader)).files


# 6


def components(rows):
    sets = []
    for i, t in rows:
        w = words(lower(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None and (least[root(k)] is None or i < least[root(k)]):
            least[root(k)] = i
    return sorted((str(i), len(s), str(least[root(k)])) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_near_dedup(request, which):
    df = request.getfixturevalue(which)
    found = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == components(texts(df))
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns
    stay = {r.doc_id for r in found if r.kept}
    assert sorted(map(str, texts(kept))) == sorted(str(x) for x in texts(df) if x[0] in stay)


def test_near_dedup_of_many_rows_without_ids(spark, docs):
    odd = written(docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))), "odd")
    found = near_dedup.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == components(texts(odd))
    stay = {r.doc_id for r in found if r.kept}
    assert sorted(map(str, texts(near_dedup.drop_near_copies(odd)))) == sorted(str(x) for x in texts(odd) if x[0] in stay)


def test_near_dedup_of_a_large_group(spark):
    """A text and 150 altered copies, most of which link by the text alone."""
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(400)]
    rows = [(1000, " ".join(base))]
    for k in range(150):
        w = list(base)
        for at in rng.choice(400, 9, replace=False):
            w[at] = f"k{k}x{at}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == components(rows)


def test_near_dedup_of_a_net(spark):
    """300 altered copies of a text that isn't there, each linked to about half
    of the others, and 100 whose alterations go too far, each on its own."""
    rng = np.random.default_rng(11)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(400):
        w = list(base)
        for at in rng.choice(300, 4 if k < 300 else 11, replace=False):
            w[at] = f"k{k}x{at}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = near_dedup.near_duplicates(df).collect()
    want = components(rows)
    assert max(Counter(x[2] for x in want).values()) >= 300 and len({x[2] for x in want}) >= 90
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want


def excerpts(kind, n, seed):
    """Copies of one text of 480 words, each without its own quarter: a stretch, 6 of
    24 pieces, or 4 pieces whose place new words take."""
    rng, base = np.random.default_rng(seed), [f"w{i}" for i in range(480)]
    out = [base] if kind != "replaced" else []
    for k in range(n):
        if kind == "stretch":
            a = int(rng.integers(0, 360))
            out.append(base[:a] + base[a + 120 :])
        else:
            cut = set(rng.choice(24, 6 if kind == "pieces" else 4, replace=False).tolist())
            out.append([w if i // 20 not in cut else f"x{k}_{i}" for i, w in enumerate(base) if kind == "replaced" or i // 20 not in cut])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("kind", ["stretch", "pieces", "replaced"])
def test_near_dedup_of_excerpts(spark, monkeypatch, kind):
    """Texts that are all alike below the limit: pairs grow with their number, not
    with its square, and every link is found."""
    verified = []
    compared = near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda pairs, *rest: verified.append(pairs.count()) or compared(pairs, *rest))
    for n in (150, 300):
        rows = excerpts(kind, n, n)
        verified.clear()
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == components(rows)
        # The hubs of 324 tables at first, few pairs of unlike sets after them.
        assert verified[0] <= 60 * n and sum(verified[1:]) <= 4 * n


def test_sketches_bound_differences():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-(2**63), 2**63, n)) for n in (1, 40, 300, 390, 520)]
    sets += [np.unique(np.concatenate([s[: len(s) * 3 // 4], rng.integers(-(2**63), 2**63, len(s) // 5)])) for s in sets]
    made = []
    for s in sets:
        bins = max(256, 1 << (2 * len(s) - 1).bit_length())
        made.append(np.packbits(np.bincount(s & (bins - 1), minlength=bins).astype(np.uint8) & 1).view(np.int64))
    for x, own in zip(sets, made, strict=True):
        for y, other in zip(sets, made, strict=True):
            least = min(len(own), len(other))
            apart = int(np.bitwise_count((near_dedup._folded(own, least) ^ near_dedup._folded(other, least)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(x, y))


def test_near_dedup_rounds_take_the_sets_of_their_pairs(spark, monkeypatch):
    """After the comparison with hubs, only the sets that a round's pairs need are
    handed to it, however many there are."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 240)]
    cut = lambda at, n: " ".join(base[:at] + base[at + n :])
    rows = [(i, cut(int(at), 60)) for i, at in enumerate(rng.integers(0, 180, 40))] + [(100, " ".join(base))]
    rows += [(1000 + 2 * i + j, " ".join(f"x{i}y{k}" for k in range(60 + j))) for i in range(30) for j in range(2)]
    given, compared = [], near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda pairs, sets, *rest: given.append((pairs.select("a").union(pairs.select("b")).distinct().count(), sets.count())) or compared(pairs, sets, *rest))
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(found[1000 + 2 * i + 1] == 1000 + 2 * i for i in range(30))
    assert len(given) > 1 and given[0][1] >= 60 and all(nodes == sets for nodes, sets in given[1:])


def test_near_dedup_recall_at_the_limit(spark):
    """400 pairs of texts whose similarity is from 0.75 to 0.80: all are found."""
    rng = np.random.default_rng(8)
    rows, k = [], 0
    while len(rows) < 800:
        w = [f"p{k}w{i}" for i in range(int(rng.integers(60, 300)))]
        v = list(w)
        for at in rng.choice(len(w), max(1, round(len(w) * 0.027)), replace=False):
            v[at] = f"x{at}"
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        k += 1
        if 0.75 <= len(a & b) / len(a | b) <= 0.80:
            rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.component_id == r.doc_id - r.doc_id % 2 for r in found if r.doc_id % 2) >= 0.99 * 400
    assert sum(r.kept for r in found) <= 404


def test_near_dedup_of_a_drifting_text(spark):
    """Each text alters one word of the one before: a chain of short links."""
    rng = np.random.default_rng(3)
    w = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w[rng.integers(120)] = f"k{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == components(rows)


def test_components_of_a_long_chain(spark, monkeypatch):
    """1,000 links in a row take as many tables as the length has digits."""
    tables = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    chain = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = near_dedup.connected_components(chain).collect()
    assert len(found) == 1001 and {r.component for r in found} == {0} and len(tables) <= 16


# 7


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24, 32])
def test_packing_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64).astype(np.uint32)
    assert (packing.unpack(packing.pack(ids, bits), bits, len(ids)) == ids).all()


def test_packing_of_too_large_ids():
    with pytest.raises(ValueError, match="more than 16 bits"):
        packing.pack(np.array([1, 70_000], np.uint32), 16)


def test_packed_files_of_null_and_repeated_ids(spark, awkward):
    """Null ids come first; rows with equal ids follow in order of their texts."""
    folder, t, start = new_folder(spark, "packed"), tokenizer(), 0
    parts = packing.write_packed(awkward, folder, queries.word_tokenizer(), 49_408, 2)
    found = sorted(packing.read_packed_digests(spark, folder, parts).collect(), key=lambda r: r.start)
    order = sorted(texts(awkward), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for r, (i, text) in zip(found, order, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_packed_files(spark, request, which):
    df = request.getfixturevalue(which)
    if which == "awkward":
        df = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    folder = new_folder(spark, "packed")
    parts = packing.write_packed(df, folder, queries.word_tokenizer(), 49_408, 2)
    found = {r.doc_id: r for r in packing.read_packed_digests(spark, folder, parts).collect()}
    t, start = tokenizer(), 0
    for i, text in sorted(texts(df)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(found) == df.count()
    whole = {r.doc_id: (r.start, r.ids) for r in packing.read_packed(spark, folder, parts).collect()}
    assert all(whole[i] == (found[i].start, [*t.encode(text or "", add_special_tokens=False).ids, 2]) for i, text in texts(df))


# 8


def test_chat_events(spark):
    rows = [("c", 1, 0, "message", "user", "hi"), ("c", 2, 1, "delta", "assistant", "a"), ("c", 2, 2, "delta", None, "b"), ("c", 2, 3, "regenerate", None, None), ("c", 2, 4, "delta", None, "x<|im_end|>"), ("c", 3, 5, "message", "user", "gone"), ("c", 3, 6, "delete", None, None), ("c", 1, 7, "edit", None, "hello"), ("c", 9, 8, "odd", "user", "?")]
    events = spark.createDataFrame(rows, "conv_id string, message int, seq int, kind string, role string, text string")
    folded = chat.fold_events(events)
    assert sorted((r.message, r.role, r.text) for r in folded.collect()) == [(1, "user", "hello"), (2, "assistant", "x<|im_end|>")]
    formatted = chat.format_conversations(folded).collect()[0]
    assert formatted.formatted.count("<|im_end|>") == 2
    back = chat.read_formatted(chat.format_conversations(folded)).collect()[0]
    assert [(t.role, t.text, t.in_loss) for t in back.turns] == [("user", "hello", False), ("assistant", "x<|im_end|>", True)]
    spans = chat.loss_spans(chat.render_messages(folded)).collect()
    assert [formatted.formatted[s.start : s.start + s.length] for s in spans] == ["x<\\|im_end|>"]
    assert chat.fold_events(empty(events)).count() == 0


def test_chat_ties_repeats_nulls_and_deletes(spark):
    long = "y" * 200_000
    rows = [
        ("d", 1, 1, "message", "user", "a"), ("d", 1, 2, "delete", None, None), ("d", 1, 3, "delta", None, "late"),
        ("d", 2, 1, "delete", None, None), ("d", 2, 2, "message", "user", "back"),
        ("d", 3, 1, "message", "user", "b"), ("d", 3, 2, "delta", None, "z"), ("d", 3, 2, "delta", None, "c"), ("d", 3, 2, "delta", None, "c"),
        ("d", 4, 5, "delta", None, "!"), ("d", 4, 5, "edit", None, "new"),
        (None, 1, 1, "message", None, None), ("d", None, 1, "message", "user", long),
    ]
    events = spark.createDataFrame(rows, "conv_id string, message int, seq int, kind string, role string, text string")
    events = events.withColumn("conv", F.lit("x")).withColumn("events", F.lit("x")).withColumn("reset", F.lit("x")).repartition(3)
    found = sorted((str(r.conv_id), str(r.message), r.role, r.text) for r in chat.fold_events(events).collect())
    assert found == sorted([("d", "2", "user", "back"), ("d", "3", "user", "bccz"), ("d", "4", "", "new!"), ("None", "1", "", ""), ("d", "None", "user", long)])


# 9


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_word_bpe(request, which):
    df = request.getfixturevalue(which)
    path, t = queries.word_tokenizer(), tokenizer()
    want = []
    for i, text in texts(df):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), ids, t.decode(ids, skip_special_tokens=False)))
    encoded = written(word_bpe.encode_documents(df, path, block_words=5000), "test-ids")
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == sorted(x[:2] for x in want)
    decoded = word_bpe.decode_documents(encoded, path).collect()
    assert sorted((str(r.doc_id), r.text) for r in decoded) == sorted((i, s) for i, _, s in want)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = word_bpe.round_trip_digests(df, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted((i, len(x), digest(" ".join(map(str, x))), digest(s)) for i, x, s in want)


# 10


PERCENT = mixing.MixingConfig(resolution=100)


def members_of(spark, parts, mass):
    return spark.createDataFrame([(i, int(m), [int(x) for x in p]) for i, (m, p) in enumerate(zip(mass, parts, strict=True))], "doc_id long, n_tokens long, parts array<int>")


def traded(p, share, aim, pull=0.05):
    """Rates of the fit to one aim, by Newton's method in its dual: the rates are
    max(0, 1 - p @ z / pull), and z is what their totals lack."""
    z = np.zeros(p.shape[1])
    rates = lambda z: np.maximum(0, 1 - p @ z / pull)
    lack = lambda z: z - p.T @ (share * rates(z)) + aim
    for _ in range(200):
        curve = np.eye(len(z)) + (p * (share * (rates(z) > 0))[:, None]).T @ p / pull
        move, length = np.linalg.solve(curve, lack(z)), 1.0
        while np.linalg.norm(lack(z - length * move)) > np.linalg.norm(lack(z)) and length > 1e-9:
            length /= 2
        z = z - length * move
    assert np.abs(lack(z)).max() < 1e-9
    return rates(z)


def effective(r):
    return r.sum() ** 2 / (r @ r) / len(r)


def test_mixing_rates_meet_targets(spark):
    """Aims are raised until the totals meet the targets, if that is allowed."""
    rng = np.random.default_rng(6)
    parts = np.stack([mixing.whole_parts(p, 100) for p in rng.dirichlet([0.3, 0.3, 0.3], 300)])
    mass = rng.integers(1, 500, 300)
    members, targets = members_of(spark, parts, mass), np.array([0.5, 0.3, 0.2])
    rates = mixing.fit_rates(members, ("a", "b", "c"), {"a": 50, "b": 30, "c": 20}, replace(PERCENT, least_effective=0, tolerance=1e-4, settled=1e-5))
    found = {r.doc_id: r.rate for r in mixing.mixing_report(members, rates).collect()}
    r = np.array([found[i] for i in range(300)])
    assert r.min() >= 0 and np.abs((parts / 100 * (mass * r)[:, None]).sum(axis=0) / mass.sum() - targets).max() <= 2e-4
    assert np.allclose(r, [rates.of_parts(p) for p in parts], atol=1e-8)
    assert np.isclose(rates.effective, effective(r), atol=1e-6) and np.isclose(rates.largest, r.max(), atol=1e-6)
    assert mixing.fit_rates(members, ("a", "b", "c"), {}).steps == () and mixing.fit_rates(empty(members), ("a",), {"a": 1}).steps == ()


@pytest.mark.parametrize("alpha", [0.3, 2.0])
def test_mixing_is_the_traded_least_squares(spark, alpha):
    """One round's rates are those of Newton's method; further rounds end before
    fewer documents stay effective than stated."""
    rng = np.random.default_rng(3)
    parts = np.stack([mixing.whole_parts(p, 100) for p in rng.dirichlet([alpha] * 3, 1000)])
    mass = rng.integers(20, 500, 1000)
    members, p, share, targets = members_of(spark, parts, mass), parts / 100, mass / mass.sum(), np.array([0.9, 0.07, 0.03])
    wanted = {"good": 90, "poor": 7, "toxic": 3}
    one = mixing.fit_rates(members, ("good", "poor", "toxic"), wanted, replace(PERCENT, max_rounds=0, settled=1e-4))
    r, best = np.array([one.of_parts(x) for x in parts]), traded(p, share, targets)
    assert np.abs(r - best).max() < 3e-3
    assert np.allclose(one.reached, p.T @ (share * r) * mass.sum(), rtol=1e-4) and np.allclose(one.targets, targets * mass.sum())
    least = effective(best) - 0.05
    more = mixing.fit_rates(members, ("good", "poor", "toxic"), wanted, replace(PERCENT, least_effective=least))
    off = lambda x: np.abs(np.array(x.reached) - x.targets).max()
    assert more.effective >= least and off(more) <= off(one) and (off(more) < off(one)) == (more.effective < one.effective)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixing_keeps_the_corpus(spark, sf):
    """Most documents stay, nearly all likely good ones, none more than three times."""
    report = queries.op10_mixing(spark, f"/root/testdata/{sf}").toPandas()
    good = report[report.p_good > 0.5]
    assert (report.copies > 0).mean() > 0.8 and (good.copies > 0).mean() > 0.98 and report.rate.max() < 3
    assert effective(report[report.n_tokens > 0].rate.to_numpy()) >= 0.85
    shares = lambda w: np.array([(w * report[f"p_{d}"]).sum() for d in ("good", "poor", "toxic")]) / w.sum()
    before, after = shares(report.n_tokens), shares(report.n_tokens * report.rate)
    assert after[0] > before[0] + 0.05 and after[1] < 0.75 * before[1] and after[2] < 0.75 * before[2]


def test_whole_parts():
    assert mixing.whole_parts(np.array([1 / 3, 1 / 3, 1 / 3]), 100).tolist() == [34, 33, 33]


def test_mixing_held_out_and_copies(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = mixing.fit_domains(docs, queries.labelled_domains(spark, sf))
    members = written(mixing.soft_members(docs, model), "test-members")
    rates = mixing.fit_rates(members, model.domains, queries.MIX, relative=True)
    report = mixing.mixing_report(members, rates)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.in_training(F.col("doc_id")))
    x = report.join(labels, "doc_id").toPandas()
    # One round against Newton's method on the same posteriors.
    every = report.where("n_tokens > 0").toPandas()
    p, share = every[[f"p_{d}" for d in model.domains]].to_numpy(), (every.n_tokens / every.n_tokens.sum()).to_numpy()
    targets = np.array([queries.MIX[d] for d in model.domains]) * (p.T @ share)
    one = mixing.fit_rates(members, model.domains, queries.MIX, mixing.MixingConfig(max_rounds=0, settled=1e-4), relative=True)
    assert np.allclose(np.array(one.targets) / sum(one.targets), targets / targets.sum(), atol=1e-6)
    assert np.abs([one.of_parts(np.round(q * 10_000)) for q in p] - traded(p, share, targets / targets.sum())).max() < 3e-3
    truth = np.where(x.toxic == 1, "toxic", np.where(x.quality == 0, "poor", "good"))
    guess = np.array(model.domains)[x[[f"p_{d}" for d in model.domains]].to_numpy().argmax(axis=1)]
    assert (truth == guess).mean() > 0.9
    mixed = {r.doc_id: r["count"] for r in mixing.mix_documents(docs, model, rates).groupBy("doc_id").count().collect()}
    assert mixed == {r.doc_id: r.copies for r in report.where("copies > 0").collect()}


def test_mixing_on_awkward(spark, awkward):
    labelled = spark.createDataFrame([(4, "a"), (7, "b"), (None, "a"), (9, None), (4, "b")], "doc_id long, domain string")
    for df, known in ((awkward, labelled), (awkward, empty(labelled)), (empty(awkward), labelled)):
        model = mixing.fit_domains(df, known)
        members = mixing.soft_members(df, model)
        rates = mixing.fit_rates(members, model.domains, {"a": 1, "b": 1, "all": 1})
        assert mixing.mixing_report(members, rates).count() == df.count()
        mixed = mixing.mix_documents(df.withColumn("_draw", F.lit("x")), model, rates)
        assert mixed.columns == [*df.columns, "_draw"] and mixed.where("_draw <> 'x'").count() == 0


# empty tables, registered oracles


def test_empty_tables(spark, awkward):
    none, path = empty(awkward), queries.word_tokenizer()
    assert quality.quality_report(none, quality.fit_references(none)).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert word_bpe.round_trip_digests(none, path).count() == 0
    folder = new_folder(spark, "packed")
    assert packing.read_packed_digests(spark, folder, packing.write_packed(none, folder, path, 49_408, 2)).count() == 0
    pages, folder = none.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")), new_folder(spark, "warc")
    warc.write_warc(pages, folder)
    assert warc.verified_records(warc.read_warc(spark, folder)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    own, other = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    plain = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float, np.number)) else x
    shape = lambda d: sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)
    assert sorted(own.columns) == sorted(other.columns) and shape(own) == shape(other)
