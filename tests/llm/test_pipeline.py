"""Each stage of the pipeline on what the one before it kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from evoka.llm import mixing, queries
from evoka.llm.common import written

from .test_operators import components, lower, rules, tokenizer

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], DATA), name))
    assert all(k.columns == columns for k in kept[:-1])
    raw, good, exact, near, mixed, ids = ([r for r in k.collect()] for k in kept)
    # Quality: nothing that breaks a base rule, and only known rows.
    assert len(good) > 0.5 * len(raw) and not any(rules(r.text)[5] for r in good) and {r.doc_id for r in good} <= {r.doc_id for r in raw}
    # Exact: the smallest id of each text.
    best = {}
    for r in good:
        best[lower(r.text)] = min(r.doc_id, best.get(lower(r.text), r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    # Near: the smallest id of each group.
    assert sorted(str(r.doc_id) for r in near) == sorted({c for _, _, c in components([(r.doc_id, r.text) for r in exact])})
    # Mixing: as often as the report says.
    model = mixing.fit_domains(kept[3], queries.labelled_domains(spark, DATA))
    members = written(mixing.soft_members(kept[3], model), "test-members")
    report = mixing.mixing_report(members, mixing.fit_rates(members, model.domains, queries.MIX, relative=True))
    want = {r.doc_id: r.copies for r in report.where("copies > 0").collect()}
    assert {r.doc_id: r["count"] for r in kept[4].groupBy("doc_id").agg(F.count("*").alias("count")).collect()} == want
    # The corpus is all there: no document stands for many, few clean ones go.
    assert max(want.values()) <= 3 and len(want) > 0.85 * len(near)
    # Encoding: as the library does, for every row.
    t = tokenizer()
    assert sorted((r.doc_id, list(r.ids)) for r in ids) == sorted((r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in mixed)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
    rows = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(docs)


def test_stages_on_awkward_rows(spark):
    """Null, empty, long, repeated and clashing input through the whole chain."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    long = " ".join(r.text for r in docs.where("lang = 'en'").collect() * 20)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "no id here"), (None, None), (500_001, long), (500_001, long), (500_002, long + " and the end")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit("x") for c in ("_draw", "row", "node", "digest", "parts", "rate")})
    for frame in (docs, docs.where("false")):
        columns = frame.columns
        for name, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, DATA), name)
            assert frame.columns == (columns if name != "BPE encoding" else ["doc_id", "ids"])
            if name == "exact dedup" and not frame.isEmpty():
                assert {r.doc_id for r in frame.where("doc_id > 500000").collect()} <= {500_001, 500_002}
            if name == "MinHash near-dedup":
                assert frame.where("doc_id = 500002").count() == 0
