"""Exact vector search: top-k by dot product for a batch of queries, grouped and filtered."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrank.sources.snapshot import ensure_checkpoint_dir

#: Neighbours before grouping.
TOP = 40
#: Queries are sent to the executors in blocks of at most this many bytes.
BLOCK_BYTES = 16 << 20
#: Scores that a task holds at once.
CELLS = 1 << 20
DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; negative infinity if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(float("-inf")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    size = l2_norm(v)
    return F.transform(v, lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def _block(part: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the queries of each length."""
    ids, values = part.column("query_id").to_numpy(), part.column("vector").combine_chunks()
    sizes = np.asarray(values.value_lengths())
    return {n: (ids[sizes == n], np.asarray(values.filter(pa.array(sizes == n)).flatten(), np.float64).reshape(-1, n)) for n in np.unique(sizes).tolist() if n}


def _best(vectors: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int, exclude_self: bool) -> DataFrame:
    """(query_id, chunk_id, score): the k best vectors of each partition for each query of a block."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: (np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)) for n, (ids, _) in shared.value.items()}
        for batch in batches:
            chunk, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for n, (ids, m) in shared.value.items():
                every, step = np.flatnonzero(sizes == n), max(k, CELLS // max(1, len(ids)))
                for fit in (every[at : at + step] for at in range(0, len(every), step)):
                    flat = values.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)
                    s = np.floor((m @ flat.T) * 10**DIGITS + 0.5) / 10**DIGITS
                    i = np.broadcast_to(chunk[fit], s.shape)
                    if exclude_self:
                        s = np.where(i == ids[:, None], -np.inf, s)
                    s, i = np.concatenate([best[n][0], s], axis=1), np.concatenate([best[n][1], i], axis=1)
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best[n] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        for n, (s, i) in best.items():
            if s.shape[1]:
                keep = np.isfinite(s).ravel()
                ids = np.repeat(shared.value[n][0], s.shape[1])
                yield pa.record_batch([pa.array(ids[keep], pa.int64()), pa.array(i.ravel()[keep], pa.int64()), pa.array(s.ravel()[keep], pa.float64())], ["query_id", "chunk_id", "score"])

    return vectors.select(F.col("chunk_id").cast("long"), "vector").mapInArrow(score, "query_id long, chunk_id long, score double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, exclude_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best vectors of each query; equal scores by id.

    Each partition scores its vectors against a block of queries in one matrix product and keeps k candidates a query;
    only these are shuffled and ranked. Queries are counted first. More than a block of them are worked off block by block, each
    written before the next is sent, so one block is held at a time.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("vector is not null")
    seen = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("wide")).first()
    blocks = max(1, -(-seen["n"] * 8 * max(1, seen["wide"] or 0) // BLOCK_BYTES))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    ranked = lambda part: part.withColumn("rank", rank).where(F.col("rank") <= k)
    if blocks == 1:
        return ranked(_best(vectors, _block(asked.toArrow()), k, exclude_self))
    ensure_checkpoint_dir(vectors.sparkSession)
    # hashed apart; a block may be somewhat larger than another
    own = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [ranked(_best(vectors, _block(asked.where(own == b).toArrow()), k, exclude_self)).checkpoint() for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, parts)


def best_of_groups(hits: DataFrame, passages: DataFrame, group: list[str], limit: int = 6) -> DataFrame:
    """The best hit of each group (document, heading) and its rank among the groups; hits without a passage are dropped."""
    joined = hits.join(passages, "chunk_id")
    first = F.row_number().over(Window.partitionBy("query_id", *group).orderBy("rank"))
    best = joined.withColumn("_n", first).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *group))
    return best.withColumn("rank", place).where(F.col("rank") <= limit)
