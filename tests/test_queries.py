"""Every query beside its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from evoka import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shape(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: pd.to_numeric(df[c]).astype(float).round(5) if df[c].dtype.kind in "ifb" or str(df[c].dtype) in ("Int64", "boolean") else df[c].astype(str).replace({"None": "-", "<NA>": "-", "nan": "-"}) for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    own, other = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    for c in own.columns:
        if str(other[c].dtype).startswith("datetime"):
            own[c] = pd.to_datetime(own[c]).astype("datetime64[us]")
        if str(other[c].dtype) in ("boolean", "bool"):
            own[c] = own[c].astype("boolean")
    pd.testing.assert_frame_equal(shape(own), shape(other), check_dtype=False, atol=2e-5, rtol=1e-6)


@pytest.mark.parametrize("name", ["fitted_curves", "curve_differences", "resampled_tests", "bandpass_filter", "stratified_inference", "cross_subject_model"])
def test_others_run_and_repeat(spark, name):
    first = queries.QUERIES[name](spark, DATA)
    again = queries.QUERIES[name](spark, DATA).repartition(3)
    a, b = shape(first.toPandas()), shape(again.toPandas())
    assert len(a) > 0
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_resampling_runs_the_whole_numbers(spark, monkeypatch):
    counts = {}
    for module, name, at in ((queries.signal, "fitted_curves", 4), (queries.effects, "resampled_tests", 4), (queries.evaluate, "stratified_inference", 5)):
        monkeypatch.setattr(module, name, lambda df, *a, name=name, at=at: counts.update({name: a[at - 1 :]}) or df.withColumns({c: queries.F.array().cast("array<double>") for c in ("values", "ci_low", "ci_high")}))
        queries.QUERIES[name](spark, DATA)
    assert counts["fitted_curves"] == (500,)
    assert counts["resampled_tests"][:2] == (5000, 2000)
    assert counts["stratified_inference"][:2] == (2000, 2000)
