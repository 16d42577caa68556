"""The driver's tables in the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.functions import text as T


#: Tables of texts, on which most of the work of a query is done row by row.
TEXTS = ("documents", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One task reads a row group, so a table in fewer files than there are cores is dealt out; larger ones never are."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if name in TEXTS and len(table.inputFiles()) < cores else table


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: (path, title, basename, aliases, headings, tags, body); title and headings are the first words of lines."""
    d = read(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    first = lambda line, n: F.array_join(F.slice(T.tokens(line), 1, n), " ")
    headings = F.filter(F.transform(F.slice(lines, 2, 5), lambda x: first(x, 3)), lambda h: h != "")
    return d.select(
        "doc_id",
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        first(F.element_at(lines, 1), 4).alias("title"),
        F.col("doc_id").cast("string").alias("basename"),
        F.array(F.concat_ws(" ", "lang", F.col("doc_id").cast("string"))).alias("aliases"),
        headings.alias("headings"),
        F.array("lang", "source").alias("tags"),
        F.col("text").alias("body"),
    )


def note_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every hundredth document asks with the first two words of its first line, in the context of that line."""
    d = read(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    line = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    return d.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(T.tokens(line), 1, 2), " ").alias("anchor_text"), line.alias("context_text"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_path"), F.lit(6).alias("limit"), F.lit(0.5).alias("minimum_score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as passages of documents: the label is the document."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("document"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
