"""The persistent index under change: documents, their chunks and the chunks' vectors as three tables.

documents: path, id, chunk_ids; chunks: id, document_id and what a chunk holds; vectors: chunk_id, vector. Every change
is a join on one of these keys, so a change of any size costs one pass over what it touches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Index(NamedTuple):
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame


def _chunk_ids(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("chunk_ids").alias("chunk_id")).distinct()


def remove(index: Index, paths: DataFrame) -> Index:
    """The index without the documents of ``paths`` (path); their chunks and vectors go with them."""
    gone = _chunk_ids(index.documents.join(paths, "path", "left_semi"))
    return Index(
        index.documents.join(paths, "path", "left_anti"),
        index.chunks.join(gone, index.chunks["id"] == gone["chunk_id"], "left_anti"),
        index.vectors.join(gone, "chunk_id", "left_anti"),
    )


def replace(index: Index, documents: DataFrame, chunks: DataFrame) -> Index:
    """The index with documents written anew. Vectors of chunks that keep their id stay; those of other chunks go.

    A document takes the place of the one of its path, and of any other that has its id.
    """
    # path or id: two equi-joins instead of one on either
    old = index.documents.join(documents.select("path"), "path", "left_semi").unionByName(index.documents.join(documents.select("id"), "id", "left_semi").select(index.documents.columns))
    stale = _chunk_ids(old)
    fresh = chunks.select(F.col("id").alias("chunk_id"))
    kept = index.documents.join(documents.select("path"), "path", "left_anti").join(documents.select("id"), "id", "left_anti").select(index.documents.columns)
    return Index(
        kept.unionByName(documents),
        index.chunks.join(stale, index.chunks["id"] == stale["chunk_id"], "left_anti").unionByName(chunks),
        index.vectors.join(stale.join(fresh, "chunk_id", "left_anti"), "chunk_id", "left_anti"),
    )


def rename(documents: DataFrame, moves: DataFrame) -> DataFrame:
    """``documents`` after ``moves`` (old_path, new_path): a moved one keeps its id and is due to be read (modified_at -1); one that was at the new path gives way."""
    taken = moves.select(F.col("new_path").alias("path"))
    moved = documents.join(moves, documents["path"] == moves["old_path"])
    moved = moved.select(*[F.col("new_path").alias("path") if c == "path" else F.lit(-1).cast(documents.schema[c].dataType).alias(c) if c == "modified_at" else F.col(c) for c in documents.columns])
    stay = documents.join(moves.select(F.col("old_path").alias("path")), "path", "left_anti").join(taken, "path", "left_anti")
    return stay.unionByName(moved)


def current_vectors(vectors: DataFrame, model: dict, clear: bool = False) -> DataFrame:
    """Vectors that the model's descriptor still covers; those of another descriptor, or all on demand, are void."""
    same = F.lit(not clear)
    for name, value in model.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return vectors.where(same)


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector."""
    return chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def affected_paths(index: DataFrame, live: DataFrame, excluded: Column, embedded: DataFrame | None = None) -> DataFrame:
    """(path, cause) of documents that a reconciliation touches: deleted, excluded, changed, or embedded anew.

    index: path, modified_at; live: path, modified_at and what ``excluded`` reads; embedded: path. The first cause in this order is told.
    """
    rows = live.select("path", F.col("modified_at").alias("now"), F.coalesce(excluded, F.lit(False)).alias("off"), F.lit(True).alias("live"))
    both = rows.join(index.select("path", F.col("modified_at").alias("then"), F.lit(True).alias("known")), "path", "full_outer")
    if embedded is not None:
        both = both.join(embedded.select("path").distinct().withColumn("new", F.lit(True)), "path", "full_outer")
    else:
        both = both.withColumn("new", F.lit(None).cast("boolean"))
    cause = F.when(F.col("known") & F.col("live").isNull(), "deleted").when(F.col("off"), "excluded").when(F.col("live") & ~F.col("then").eqNullSafe(F.col("now")), "changed").when(F.col("new"), "embedded")
    return both.select("path", cause.alias("cause")).where("cause is not null")


def delta(paths: DataFrame, index: Index) -> DataFrame:
    """One row for each of ``paths``: (path, op, id, chunks), an upsert with what the index holds or a removal. Chunks are sorted by id,
    with their vector if there is one; a document that names a chunk which isn't there has it with a null document_id."""
    held = paths.select("path").distinct().join(index.documents, "path", "left")
    named = held.select("path", F.explode("chunk_ids").alias("chunk_id"))
    chunks = index.chunks.select(F.col("id").alias("chunk_id"), "document_id")
    full = named.join(chunks, "chunk_id", "left").join(index.vectors.select("chunk_id", "vector"), "chunk_id", "left")
    lists = full.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "document_id", "vector"))).alias("chunks"))
    out = held.select("path", "id").join(lists, "path", "left")
    return out.select("path", F.when(F.col("id").isNull(), "remove").otherwise("upsert").alias("op"), "id", F.coalesce("chunks", F.array().cast(lists.schema["chunks"].dataType)).alias("chunks"))


def output_mismatches(inputs: DataFrame, outputs: DataFrame, dimensions: int) -> DataFrame:
    """(id, problem) of model outputs (id, vector) against inputs (id): each id exactly once on both sides, vectors whole and finite."""
    asked = inputs.groupBy("id").agg(F.count("*").alias("asked"))
    finite = F.forall("vector", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    given = outputs.groupBy("id").agg(F.count("*").alias("given"), F.min((F.size("vector") == dimensions).cast("int")).alias("whole"), F.min(F.coalesce(finite, F.lit(False)).cast("int")).alias("finite"))
    x = asked.join(given, "id", "full_outer")
    problem = (
        F.when(F.col("asked").isNull(), "unexpected").when(F.col("id") == "", "empty id").when(F.col("asked") > 1, "repeated input").when(F.col("given").isNull(), "omitted").when(F.col("given") > 1, "repeated output")
        .when(F.col("whole") == 0, "wrong dimensions").when(F.col("finite") == 0, "not finite")
    )
    return x.select("id", problem.alias("problem")).where("problem is not null")


def unpack(matrix: DataFrame, dimensions: int) -> DataFrame:
    """(chunk_id, vector) of chunks (chunk_id, vector_row, matrix): a row's slice of the flat matrix; rows outside it have none."""
    start = F.col("vector_row") * dimensions + 1
    inside = (F.col("vector_row") >= 0) & (start + dimensions - 1 <= F.size("matrix"))
    return matrix.where(inside).select("chunk_id", F.slice("matrix", start.cast("int"), dimensions).alias("vector"))


def collated(df: DataFrame, *columns: str) -> list[Column]:
    """Sort keys in the order of the Unicode collation, ties in code-point order: for ``orderBy`` or a window."""
    return [key for c in columns for key in (F.collate(F.col(c), "UNICODE"), F.col(c))]


def served_order(requests: DataFrame, by: str = "lane") -> DataFrame:
    """``requests`` (lane, priority, position) with served: the order in which a lane works waiting requests off, by priority and then arrival."""
    return requests.withColumn("served", F.row_number().over(Window.partitionBy(by).orderBy("priority", "position")))
