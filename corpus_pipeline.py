"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, PII surrogates, packing.

Each stage reads what its predecessor kept, written as Parquet in the shared folder; all but the last return the columns of
documents.

Defined cases: a null or empty text has no word, so the first stage drops it; rows without an id are documents of their own (of equal or near
texts one stays, and a row with an id before one without); repeated rows and rows of one id with other texts are judged each; a null n_chars
is set where a text changes and else stays; an empty table gives no piece; all other columns, whatever their names, go through
the first four stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocktide.llm import decontaminate, near, packing, pii, quality
from stocktide.llm.common import documents, written
from stocktide.llm.queries import PII_KEY
from stocktide.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of 5-word Jaccard similarity of 0.8 and more connect one stays, the one with the least id.

    The stage has its own setting: SimHash of 5-word shingles, the trie self-join within 2 bits, min-hash keys for pairs that
    differ in more bits, each pair checked exactly. op4's contract (3-word fingerprints within 2 bits) binds op4 alone.
    """
    return near.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get surrogates, and n_chars what their lengths then are."""
    return pii.replace_in(docs, PII_KEY, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return packing.digest(packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("quality", quality_rules), ("simhash", simhash_dedup), ("decontamination", benchmark_decontamination), ("pii", pii_surrogates), ("packing", pack)]

#: No stage but the near-dedup could be said in SQL, and boosted trees and tokenizers not at all; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
