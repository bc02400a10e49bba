"""From raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evoka.llm import exact_dedup, mixing, near_dedup, quality, word_bpe
from evoka.llm.common import discard, settled, written
from evoka.llm.queries import MIX, labelled_domains, word_tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go, null and empty texts among them;
    each repeated row is judged by itself, a null language by the pooled
    reference. Columns stay as they are; an empty table stays one."""
    return quality.keep_quality(docs, quality.fit_references(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, a null id only
    where no other has the text; of rows equal in id and text, one."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; a
    repeated id stays if any of its rows does. Texts without words link to none."""
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix wants it: likely poor or toxic ones
    less than once, mostly not at all, for which likely good ones are at a rate of
    1 or somewhat more, so that some appear twice. Null texts have the rate of no
    words; repeated ids are drawn alike; without labels every rate is 1."""
    model = mixing.fit_domains(docs, labelled_domains(spark, sf_dir))
    members = written(mixing.soft_members(docs, model), "soft-members")
    return mixing.mix_documents(docs, model, mixing.fit_rates(members, model.domains, MIX, relative=True))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every row, repeated and null ids too; null texts have no
    ids."""
    return word_bpe.encode_documents(docs, word_tokenizer())


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("BPE encoding", bpe_stage),
]

#: Distances to fitted references, a fitted classifier and a tokenizer are not
#: SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        last, before = k == len(STAGES) - 1, docs
        docs = stage(spark, docs, sf_dir) if last else settled(spark, lambda stage=stage, before=before: stage(spark, before, sf_dir), name)
        if not last and k:
            discard(before)
    return docs
