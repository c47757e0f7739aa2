"""A corpus in five stages: reject toxic documents, keep one of each near-duplicate group, remove documents with
benchmark passages, sample to target weights, and write token files.

Each stage takes all documents that the one before it kept; all but the last return the columns of ``documents``.

Null and empty texts are not toxic, are classes of their own, hold no benchmark passage, and give the end id alone. Rows
that repeat an id and a text count as copies, of which the second stage keeps one; a null id is an id of its own. Extra
columns are kept up to the last stage, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, shielded
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.jaccard_join import keep_one
from sparkloom.llm.mixing import mix_documents
from sparkloom.llm.token_files import token_digest
from sparkloom.llm.toxicity import THRESHOLD
from sparkloom.llm.toxicity import toxicity as score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given, names = shielded(docs, ("doc_id", "text"))
    scored = score_toxicity(given, given, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(F.col("_p_toxic") < THRESHOLD).select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given, names = shielded(docs, ("doc_id", "text", "source", "lang"))
    return mix_documents(given).filter("_keep").select(*names).toDF(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Classifiers, tokenizers and probabilistic joins have no SQL. The tests hold every stage and the final rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
