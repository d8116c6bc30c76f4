"""A training-data pipeline: five stages over ``documents``, each written and read back.

toxicity drops rejected documents; near_duplicates keeps one document of each class; secrets masks
secrets in the texts; mixing repeats and drops rows to meet the sources' target weights; packing
lays what is left into sequences and returns its pieces.

Every stage but the last returns the columns it was given, others than those of ``documents`` included.
Rows with a null text or an empty one are clean, near no other and have no secret; mixing gives
them size 0 and takes them as often as others of their source; packing gives them their end id. Rows
without a doc_id stay until packing. Repeated rows with one doc_id become one in near_duplicates. An
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastrel.llm import jaccard, mixing, packing, secrets, toxicity
from rastrel.llm.common import cut

#: Near duplicates share 0.8 or more of their five-word shingles.
NEAR = jaccard.Rule(shingle=5, percent=80)


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, NEAR)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("near_duplicates", _near_duplicates), ("secrets", _secrets), ("mixing", _mixing), ("packing", _packing)]

#: The toxicity model and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        # a stage's table goes once the next one is written; the last stage's is returned unread
        docs = cut(out, docs) if i < len(STAGES) - 1 else out
    return docs
