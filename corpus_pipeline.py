"""The corpus pipeline: five stages over the whole documents table, each written as Parquet and read again.

Poor documents go, of each group of near duplicates one stays, personal data is masked, the sources are mixed to their
target weights (a document can then occur up to three times), and the texts become token ids.

Defined cases: null, empty and short texts fail the quality base and go. Of repeated rows, being near duplicates, one stays. Rows without
an id take part in all stages; null sources are one source. Very long texts are taken whole throughout. Extra columns, also those named as an operator's results,
are kept unchanged up to the last stage, which returns its own columns. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import bpe, common, mixing, ngram_join, pii, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    got = bpe.encode(docs.select("doc_id", "source", "lang", "text"), path, pattern, decoded="decoded")
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return got.select("doc_id", "source", "lang", n.alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the learned rules nor BPE; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None
