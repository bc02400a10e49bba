"""Ranking, sets and reshaping, with ties always broken by a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def best(df: DataFrame, order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_seen(df: DataFrame, key: str, place: str) -> DataFrame:
    """Distinct keys with the place where each is first seen."""
    return df.groupBy(key).agg(F.min(place).alias(place))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b) if a.columns != b.columns else a.subtract(b)


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, one boolean: whether both hold the same distinct rows."""
    own = lambda df, n: df.distinct().withColumn("_of", F.lit(n))
    sides = own(a, 1).unionByName(own(b, 2)).groupBy(*a.columns).agg(F.sum("_of").alias("_of"))
    return sides.agg(F.coalesce(F.bool_and(F.col("_of") == 3), F.lit(True)).alias("same"))


def first_or(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """The rows of ``df``, or those of ``fallback`` where it has none, decided
    inside the plan."""
    none = df.agg((F.count("*") == 0).alias("_none"))
    return df.unionByName(fallback.join(F.broadcast(none.where("_none")), F.lit(True), "left_semi"))


def to_long(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, value) of the feature columns."""
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(keys), list(features), "feature", "value")


def feature_group(columns: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    """Columns that begin with a prefix; ``time__`` isn't ``laterality_time__``."""
    return [c for c in columns if c.startswith(tuple(prefixes))]
