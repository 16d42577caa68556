"""Fusion of lexical and semantic rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEXICAL, SEMANTIC, SEMANTIC_ONLY = 0.75, 0.55, 0.7


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int = 6) -> DataFrame:
    """Outer merge on (query, path, heading).

    lexical: query_id, target_path, target_title, target_heading, score, match_kinds, preview; semantic: query_id,
    target_path, target_title, target_heading, similarity, preview, rank. A semantic hit counts by its place alone:
    1 for the first, 0 for the last of its query.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    s = semantic.withColumn("_r", F.when(n <= 1, F.lit(1.0)).otherwise(1.0 - (place - 1) / (n - 1)))
    s = s.select("query_id", F.col("target_path"), F.coalesce("target_heading", F.lit("")).alias("_h"), F.col("target_title").alias("_st"), F.col("preview").alias("_sp"), "_r")
    x = lexical.withColumn("_h", F.coalesce("target_heading", F.lit(""))).withColumnRenamed("score", "_s")
    both = x.join(s, ["query_id", "target_path", "_h"], "full_outer")
    score = F.when(F.col("_r").isNull(), LEXICAL * F.col("_s")).when(F.col("_s").isNull(), SEMANTIC_ONLY * F.col("_r")).otherwise(F.least(F.lit(1.0), LEXICAL * F.col("_s") + SEMANTIC * F.col("_r")))
    kinds = F.concat(F.coalesce("match_kinds", F.array().cast("array<string>")), F.when(F.col("_r").isNotNull(), F.array(F.lit("semantic"))).otherwise(F.array().cast("array<string>")))
    out = both.select("query_id", "target_path", F.coalesce("target_title", "_st").alias("target_title"), F.nullif("_h", F.lit("")).alias("target_heading"), score.alias("score"), F.array_distinct(kinds).alias("match_kinds"), F.coalesce(F.nullif("_sp", F.lit("")), "preview").alias("preview"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "target_title", "target_path", F.coalesce("target_heading", F.lit(""))))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)
