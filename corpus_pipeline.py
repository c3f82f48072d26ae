"""A corpus pipeline: five stages over ``documents``, each one written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of ``documents`` (the last one
returns token digests). A stage works on all rows that its predecessor kept.

1. quality: documents whose score stays under the threshold go; trees are fitted on the labels of ``sf_dir``.
2. lines: of a line whose key is found in ten documents or more, only the first occurrence stays; n_chars follows the text.
3. near copies: documents whose five-word shingles have a Jaccard similarity of 0.8 or more are linked, candidates being found by
   wide SimHash; one document of each component stays, that of the smallest doc_id.
4. benchmark: documents that hold a window similar to a benchmark item go.
5. tokens: byte-level BPE, encoded and decoded; digests of both.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import bpe_index, common, decontaminate, line_bloom, quality_trees, simhash_similar
from tallygrid.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_trees.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_bloom.marked_rows(docs, line_bloom.MIN_DOCS, line_bloom.MIN_CHARS, True, "doc_id", "text")
    return common.restore(rows, docs.columns, n_chars=F.char_length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_similar.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_index.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("bpe encoding and decoding", tokens)]

#: Trees, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
