"""From a cursor in a text to ranked link targets: context, lexical search, semantic search, fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.functions import text as T
from linkrank.operators import chunker, context, embedding, hybrid, lexical, vectors
from linkrank.plans.catalogue import query
from linkrank.sources import tables
from linkrank.sources.snapshot import ensure_checkpoint_dir, hadoop

#: Ids of passages may be broadcast up to this number (8 bytes each).
MAX_BROADCAST_IDS = 1_000_000


def suggest(notes: DataFrame, positions: DataFrame, limit: int = 6, minimum: float = 0.55) -> DataFrame:
    """Ranked targets of each position (id, text, selection_from, selection_to, cursor).

    A position without an anchor gets none. The semantic half runs for contexts of 24 characters or five meaningful
    tokens; it looks at passages, of which the best of each note and heading counts.
    """
    ensure_checkpoint_dir(notes.sparkSession)
    # written once: both halves and the gate read the contexts
    found = context.contexts(positions).checkpoint()
    asked = found.select(F.col("id").alias("query_id"), "anchor_text", F.col("search_text").alias("context_text"), F.lit("").alias("source_path"), F.lit(limit).alias("limit"), F.lit(minimum).alias("minimum_score"))
    words = lexical.search(notes, asked)
    titled = notes.select("path", F.when(F.coalesce("title", F.lit("")) == "", F.col("basename")).otherwise(F.col("title")).alias("title"), "body")
    # written once: passages are embedded, and shown; compressed, since they hold all texts, and removed when they have served
    made = chunker.chunk_notes(titled).select(F.xxhash64("chunk_id").alias("chunk_id"), "path", F.try_element_at("heading_path", F.lit(-1)).alias("heading"), "embedding_text", "text_preview")
    folder = f"{notes.sparkSession.sparkContext.getCheckpointDir()}/passages-{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").parquet(folder)
    passages = notes.sparkSession.read.schema(made.schema).parquet(folder)
    asking = T.query_context("title-focus-neighbours", F.lit(""), F.col("sentence"), F.col("previous_sentence"), F.col("next_sentence"), F.col("sentence"), F.col("paragraph"))
    gate = (F.char_length(F.trim("search_text")) >= 24) | (F.size(T.meaningful_tokens(F.col("search_text"))) >= 5)
    queries = embedding.embed(found.where(gate).select(F.col("id").alias("query_id"), F.concat(F.lit("query: "), asking).alias("q")), "query_id", "q")
    near = vectors.top_k(embedding.embed(passages, "chunk_id", "embedding_text"), queries).checkpoint()
    ids = near.select("chunk_id").distinct()
    shown = passages.join(F.broadcast(ids) if near.count() <= MAX_BROADCAST_IDS else ids, "chunk_id", "left_semi")
    best = vectors.best_of_groups(near, shown.select("chunk_id", F.col("path").alias("target_path"), F.coalesce("heading", F.lit("")).alias("group_heading"), "text_preview"), ["target_path", "group_heading"], limit).checkpoint()
    files, at, _ = hadoop(notes.sparkSession, folder)
    files.delete(at, True)
    meaning = best.join(titled.select(F.col("path").alias("target_path"), F.col("title").alias("target_title")), "target_path")
    return hybrid.fuse(words, meaning.select("query_id", "target_path", "target_title", F.nullif("group_heading", F.lit("")).alias("target_heading"), F.col("score").alias("similarity"), F.col("text_preview").alias("preview"), "rank"), limit)


@query()
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the cursor in the middle of every hundredth document. Contexts are a fold, so tests hold it, not SQL."""
    d = tables.read(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    middle = F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    positions = d.select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("selection_from"), F.lit(0).alias("selection_to"), middle.alias("cursor"))
    return suggest(tables.notes(spark, sf_dir), positions)
