"""The corpus pipeline: five stages, each over all rows that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and reads back as the next
one's docs.  The first four return the columns of ``documents``:

- ``quality`` drops documents that the quality rules reject,
- ``near_dup`` keeps one document of each group of near duplicates,
- ``decontaminate`` drops documents that hold benchmark passages (contaminated
  by the rule of ``decontaminate.contamination``),
- ``pii`` replaces personal data in the texts,
- ``byte_bpe`` encodes and decodes: doc_id, n_tokens, and the digests of ids and
  of decoded bytes.

Null texts have no words and go with the quality rules.  Empty tables give empty
tables.  Of repeated rows and of ties in doc_id one row stays, as of any copies.
Texts of any length are taken whole.  Extra columns are carried by the first four
stages whatever their names.

A stage's result is written before the next stage is called, as ``run`` does, or
handed to it as its docs.  What a stage stored is deleted once a later stage's
docs no longer read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcewise.llm import byte_bpe, decontaminate, near_dup, pii, quality
from sourcewise.llm.common import Stage, Workspace, documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Stage(docs):
        return quality.keep(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Stage(docs):
        return near_dup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Stage(docs):
        return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Stage(docs):
        return pii.redact(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Stage(docs):
        return byte_bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The signatures, sketches and merges of the stages have no form in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), name, *(n for n, _ in STAGES[:k][-1:]))
    return docs
