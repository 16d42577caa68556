"""Corpus cleaning: quality rules, near-deduplication, decontamination, pseudonyms, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; ``run`` writes each result as
Parquet and reads it again for the next stage. All stages but the last return the columns of ``documents``.

Odd rows: null and empty texts fail the base rules; rows without an id are no near-duplicates of any and pass that stage; of equal ids all
rows stay or go together, unless their texts differ in the rules; an empty table gives no rows; other columns stay, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import bpe, decontaminate, line_frequency, near_dedup, pseudonyms
from linkrank.llm.common import Scratch, read_table
from linkrank.llm.registry import PII_KEY, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go, then documents that fail the base rules or are depleted."""
    return line_frequency.apply_rules(docs)


#: Documents of this similarity in percent, on word shingles, are near-duplicates.
NEAR_PERCENT = 80


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    return near_dedup.drop_duplicates(docs, near_dedup.Links.at(NEAR_PERCENT))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and secrets get pseudonyms; n_chars follows the text."""
    out = pseudonyms.pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document and what they decode to: (doc_id, tokens, decoded)."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("pii", pii),
    ("bpe", bpe_encoding),
]

#: Near-duplicate components and byte-pair merges can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed once the next one has written."""
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.forget(number)
    return docs
