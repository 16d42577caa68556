"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order and ranked; a row's fractional rank is (rank - u) / rows of its
source, where u, from 0 to 1, is a seeded hash of the source. All rows sorted by fractional rank interleave the sources in proportion, so equal cuts of that order give
shards which all match the mixture: any stretch of the order has each source's share to within one row, and u spreads the
rows of many small sources. Shard sizes differ by one row at most (law ``rows``).

No task ever holds a whole source or the whole order: both ranks are found in buckets. Order keys are split into
``buckets`` ranges, rows are counted by bucket, and a row's rank is the rows of the buckets before it plus its rank in its own
bucket. A source that holds a third of all rows is spread over all buckets.

Results for odd input: a null source is a source of its own; a null text has size 1 and the crc32 of nothing (0). Rows
that are equal in id, text and source are interchangeable. The order of ties is (random key, id, text), then source.
With fewer rows than shards some shards stay empty. An empty table gives no rows. Other columns do not matter; of
:func:`write_shards`, columns named shard and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the order key that make a bucket: 4,096 buckets.
BUCKET_DIGITS = 3
SEED = "42"


def _ranked(rows: DataFrame, of: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Add ``name``, the rank from 1 within ``of`` by (bucket, order), and ``name``_total, the rows of each ``of``.

    Buckets are counted first; the running sums of the counts are as many rows as there are buckets.
    """
    counts = rows.groupBy(*of, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*of).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*of, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*of)).alias(f"{name}_total"))
    inside = Window.partitionBy(*of, bucket).orderBy(*order)
    return rows.join(counts, [*of, bucket]).withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_before", bucket)


def shard_rows(docs: DataFrame, shards: int = 8, seed: str = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, source, shard, slot) of every row of ``docs``; slots of a shard run from 0 without gaps."""
    text = docs["text"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")).alias("stratum"),
        F.md5(F.concat_ws("|", F.lit(seed), docs["doc_id"].cast("string")).cast("binary")).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    ranked = _ranked(rows, ["stratum"], "bucket", ["key", "doc_id", "text_crc32", "size"], "rank")
    # buckets by the leading part of the fraction, order by the double, ties by source and rank
    width = 16**BUCKET_DIGITS
    offset = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("source"), "stratum").cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    ranked = ranked.withColumn("fraction", (F.col("rank") - offset) / F.col("rank_total")).withColumn("all", F.lit(0)).withColumn("range", F.least(F.floor(F.col("fraction") * width), F.lit(width - 1)))
    placed = _ranked(ranked, ["all"], "range", ["fraction", "stratum", "rank"], "place")
    place = F.col("place") - 1
    # place p belongs to the shard s with floor(s * total / shards) <= p < floor((s + 1) * total / shards)
    shard = F.expr(f"CAST(((place - 1) * {shards} + {shards - 1}) DIV place_total AS INT)")
    start = F.expr(f"(CAST(((place - 1) * {shards} + {shards - 1}) DIV place_total AS BIGINT) * place_total) DIV {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.when(F.col("stratum") != "", F.expr("substring(stratum, 2)")).alias("source"), shard.alias("shard"), (place - start).alias("slot"))


def mixture(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of each source in each shard: (shard, source, rows, bytes)."""
    return sharded.groupBy("shard", "source").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: str = SEED) -> None:
    """Write the rows of ``docs`` to ``path``/shard=N, each in the order of its slots. Ids have to be unique."""
    places = shard_rows(docs, shards, seed).select(F.col("doc_id").alias("__shard_id"), "shard", "slot")
    rest = docs.drop("shard", "slot")
    out = rest.join(places, rest["doc_id"].cast("long") == places["__shard_id"]).drop("__shard_id")
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
