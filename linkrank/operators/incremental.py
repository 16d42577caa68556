"""Incremental maintenance: change detection, deltas, journal replay, snapshot differences and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrank.sources.snapshot import ensure_checkpoint_dir


def normal_path(path: Column) -> Column:
    """Forward slashes, none at the ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^/+|/+$", ""))


def excluded(notes: DataFrame, files: list[str] = (), folders: list[str] = (), tags: list[str] = ()) -> Column:
    """True for notes that an exclusion rule names: a file, anything in a folder, or a tag in full."""
    clean = lambda x: x.replace("\\", "/").strip("/").lower()
    path = normal_path(notes["path"])
    rule = path.isin([clean(f) for f in files]) if files else F.lit(False)
    for folder in filter(None, map(clean, folders)):
        rule = rule | (path == folder) | F.startswith(path, F.lit(folder + "/"))
    if tags:
        own = F.transform(notes["tags"], lambda t: F.lower(F.regexp_replace(t, "^#", "")))
        rule = rule | F.arrays_overlap(own, F.array(*[F.lit(t.lstrip("#").lower()) for t in tags]))
    return rule


def property_excluded(properties: Column, rules: list[str]) -> Column:
    """True if a map<string, array<string>> of front matter matches ``name`` or ``name=value``, without regard to case."""
    entries = F.map_entries(properties)

    def matches(name: str, value: str | None) -> Column:
        def entry(e: Column) -> Column:
            named = F.lower(F.trim(e["key"])) == name
            return named if value is None else named & F.exists(e["value"], lambda v: F.lower(F.trim(F.coalesce(v, F.lit("null")))) == value)

        return F.exists(entries, entry)

    out = F.lit(False)
    for rule in rules:
        name, equals, value = rule.partition("=")
        out = out | matches(name.strip().lower(), value.strip().lower() if equals else None)
    return F.coalesce(out, F.lit(False))


def deleted(index: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    return index.join(live.select(key), key, "left_anti")


def changes(index: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    """(key, change) of live files: new, touched (modification time differs), reusable (touched, same hash), unchanged."""
    old = index.select(key, F.col("modified_at").alias("_m"), F.col("content_hash").alias("_h"), F.lit(True).alias("_old"))
    x = live.join(old, key, "left")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_m").eqNullSafe(F.col("modified_at")), "unchanged").when(F.col("_h").eqNullSafe(F.col("content_hash")), "reusable").otherwise("changed")
    return x.select(key, change.alias("change"))


def dense_rows(df: DataFrame, order: list[str | Column], name: str = "row", partitions: int | None = None) -> DataFrame:
    """Number rows from 0 in ``order`` without bringing them together: ranges are counted, then numbered side by side.

    The ranges come from a sample that each evaluation draws anew, so the dealt rows are written once: counted and numbered are the same ranges.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    counts = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + inside - 1).drop("_p", "_before")


def valid_prefix(records: DataFrame, sequence: str = "sequence", valid: str = "valid") -> DataFrame:
    """Records before the first that is invalid, repeated or missing in the sequence 1, 2, 3, ..."""
    counted = records.groupBy(sequence).agg(F.min(F.col(valid).cast("int")).alias("ok"), F.count("*").alias("n"))
    bad = counted.where("ok = 0 or n > 1").select(F.col(sequence).alias("s"))
    follows = counted.select((F.col(sequence) + 1).alias("s"))
    gaps = follows.unionByName(records.sparkSession.range(1).select(F.lit(1).cast("long").alias("s"))).join(counted.select(F.col(sequence).alias("s")), "s", "left_anti")
    first = bad.unionByName(gaps).agg(F.min("s").alias("_stop"))
    return records.crossJoin(F.broadcast(first)).where(F.col(sequence) < F.col("_stop")).drop("_stop")


def replay(base: DataFrame, log: DataFrame, key: str = "path") -> DataFrame:
    """State after a log of (sequence, op, key, value), op being upsert or remove: the latest entry of a key wins; in one record removals come first."""
    order = F.struct("sequence", F.when(F.col("op") == "upsert", 1).otherwise(0))
    last = log.groupBy(key).agg(F.max_by(F.struct("op", "value"), order).alias("x"))
    kept = base.select(key, "value").join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("x.op = 'upsert'").select(key, F.col("x.value").alias("value")))


def snapshot_diff(previous: DataFrame, following: DataFrame) -> DataFrame:
    """(row, op, document, vector) between two snapshots of (row, document, vector), document -1 meaning free: upsert or remove."""
    p = previous.where("document >= 0").select("row", F.col("document").alias("pd"), F.col("vector").alias("pv"))
    n = following.where("document >= 0")
    x = n.join(p, "row", "full_outer")
    op = F.when(F.col("document").isNull(), "remove").when(F.col("pd").isNull() | (F.col("pd") != F.col("document")) | ~F.col("pv").eqNullSafe(F.col("vector")), "upsert")
    return x.select("row", op.alias("op"), "document", "vector").where("op is not null")


def snapshot_patch(previous: DataFrame, diff: DataFrame) -> DataFrame:
    """Live rows of the previous snapshot after a difference."""
    kept = previous.where("document >= 0").select("row", "document", "vector").join(diff.select("row"), "row", "left_anti")
    return kept.unionByName(diff.where("op = 'upsert'").select("row", "document", "vector"))


def violations(documents: DataFrame, chunks: DataFrame, dimensions: int) -> DataFrame:
    """(check, n) of broken rules of a snapshot.

    documents: id, path, chunk_ids; chunks: id, document_id, start_offset, end_offset, vector_row, vector.
    """
    named = documents.select("id", F.explode("chunk_ids").alias("chunk"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    twice = lambda df, key: df.groupBy(key).agg(F.count("*").alias("c")).where("c > 1")
    vectors = chunks.where("vector_row >= 0")
    parts = [
        count(twice(documents, "id"), "repeated document id"),
        count(twice(documents, "path"), "repeated path"),
        count(twice(chunks, "id"), "repeated chunk id"),
        count(chunks.where("start_offset < 0 or end_offset < start_offset"), "bad range"),
        count(twice(vectors, "vector_row"), "vector row used twice"),
        count(vectors.where(F.coalesce(F.size("vector"), F.lit(-1)) != dimensions), "wrong dimensions"),
        count(vectors.where(~F.forall("vector", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))), "not finite"),
        count(chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti"), "chunk without document"),
        count(named.join(chunks.select(F.col("id").alias("chunk")), "chunk", "left_anti"), "named chunk is missing"),
        count(chunks.join(named.select(F.col("chunk").alias("id"), F.col("id").alias("document_id")), ["id", "document_id"], "left_anti"), "chunk not named by its document"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
