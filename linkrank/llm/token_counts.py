"""Exact histogram of encoded lengths, with suffix sums that answer every context limit.

Documents are aggregated by their number of tokens. For each length L that occurs, the table has the number of
documents of that length, how many documents and tokens lie at L or above, and the totals of everything: with these,
the total, any quantile and the total after truncation to any limit follow without reading a document again.

The suffix sums run in two levels: inside blocks of ``BLOCK`` lengths, and over the blocks, so that no task holds the
whole histogram. Null and empty texts have length 0 and count as documents; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrank.llm.bpe import count_documents
from linkrank.llm.common import ensure_checkpoint_dir

#: Lengths in one block of the suffix sums.
BLOCK = 1024


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """(n_tokens, n_docs) of the documents."""
    return count_documents(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Columns of the module's text for a histogram (n_tokens, n_docs):

    n_tokens, n_docs; docs_at_least, tokens_at_least (of documents with n_tokens or more); truncated_tokens (the total
    if every document is cut to n_tokens); docs_at_most (documents that fit whole into n_tokens); total_docs,
    total_tokens.
    """
    ensure_checkpoint_dir(hist.sparkSession)
    # read twice below: written, so that the documents are encoded once
    h = hist.checkpoint().withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("bd"), F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("bt"), F.sum("bd").over(every).alias("total_docs"), F.sum("bt").over(every).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").select("n_tokens", "n_docs", (F.sum("n_docs").over(inside) + F.col("bd")).alias("docs_at_least"), (F.sum("t").over(inside) + F.col("bt")).alias("tokens_at_least"), "total_docs", "total_tokens")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        "total_docs",
        "total_tokens",
    )


def quantile(sums: DataFrame, p: float) -> DataFrame:
    """The smallest length at which a share ``p`` of the documents fits whole: (n_tokens)."""
    return sums.where(F.col("docs_at_most") >= F.ceil(F.lit(p) * F.col("total_docs"))).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left if every document is cut to ``limit``, which need not occur as a length: (truncated_tokens)."""
    above: Column = F.col("n_tokens") > limit
    cut = F.sum(F.when(above, F.col("n_docs")).otherwise(0)) * F.lit(limit)
    return sums.agg(F.coalesce(cut + F.sum(F.when(~above, F.col("n_docs") * F.col("n_tokens")).otherwise(0)), F.lit(0)).alias("truncated_tokens"))
