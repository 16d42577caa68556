"""Length-bucketed batches for a model, thread tuning, and telemetry summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrank.functions import text as T

BUCKET_WIDTH, BATCH_SIZE = 32, 16
KEPT_SAMPLES = 2048
# Factors of the baseline that a candidate may reach, and the rules of stability.
QUERY_P50, QUERY_P95, BATCH_P50, BATCH_P95 = 1.05, 1.10, 1.10, 1.15
MIN_SAMPLES, MAX_RATIO, MIN_GAIN = 3, 2.5, 0.03


def bucket(tokens: Column, width: int = BUCKET_WIDTH) -> Column:
    return F.floor((tokens - 1) / width)


def batch_plan(inputs: DataFrame, width: int = BUCKET_WIDTH, size: int = BATCH_SIZE) -> DataFrame:
    """(bucket, batch, id, tokens): rows (id, tokens, position) of a bucket, shortest first, cut into batches.

    Ranks are found in sub-ranges of one token length each, so a bucket that holds most rows is not sorted in one task. Rows without a position come last.
    """
    # far above every other sub-range, since a null would meet nothing in the join
    x = inputs.withColumn("bucket", bucket(F.col("tokens"), width)).withColumn("piece", F.coalesce(F.floor(F.col("position") / 4096), F.lit(1 << 62)))
    counts = x.groupBy("bucket", "tokens", "piece").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("tokens", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("bucket", "tokens", "piece").orderBy(F.col("position").asc_nulls_last()))
    placed = x.join(counts.select("bucket", "tokens", "piece", before.alias("before")), ["bucket", "tokens", "piece"]).withColumn("place", F.col("before") + inside - 1)
    return placed.select("bucket", F.floor(F.col("place") / size).alias("batch"), "id", "tokens")


def checked_plan(inputs: DataFrame, width: int = BUCKET_WIDTH, size: int = BATCH_SIZE) -> DataFrame:
    """:func:`batch_plan`, where inputs without a sound estimate (null, not positive) count as one token."""
    return batch_plan(inputs.withColumn("tokens", F.when(F.col("tokens") >= 1, F.col("tokens")).otherwise(F.lit(1)).cast("long")), width, size)


def device_class(cores: Column) -> Column:
    """Devices by their number of cores; unknown without a finite one."""
    n = F.greatest(F.lit(1), F.floor(cores))
    known = F.when(n <= 2, "1-2").when(n <= 4, "3-4").when(n <= 8, "5-8").otherwise("9+")
    return F.when(cores.isNull() | F.isnan(cores) | (F.abs(cores) == float("inf")), "unknown").otherwise(known)


def thread_candidates(cores: Column) -> Column:
    """Numbers of threads to try, 0 meaning automatic: as many as the device has cores for."""
    sure = F.coalesce(~F.isnan(cores) & (F.abs(cores) < float("inf")), F.lit(False))
    return F.filter(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(4)), lambda t: (t <= 1) | (sure & (t <= F.floor(cores))))


def tuning_compatible(stored: dict[str, Column], current: dict[str, Column]) -> Column:
    """True if a stored choice of threads holds on: model, runtime and device class are the same. Null fits nothing."""
    out = F.lit(True)
    for name in ("model_revision", "runtime_version", "device_class"):
        out = out & F.coalesce(stored[name] == current[name], F.lit(False))
    return out


def batch_stats(plan: DataFrame) -> DataFrame:
    return plan.groupBy("bucket", "batch").agg(F.count("*").alias("inputs"), F.sum("tokens").alias("total_tokens"), F.max("tokens").alias("max_tokens"), (F.max("tokens") * F.count("*")).alias("padded_tokens"))


def distribution(samples: DataFrame) -> DataFrame:
    """(metric, count, min, max, mean, p50, p95, p99) of samples (metric, value), nearest rank, three digits."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    r = lambda c: T.round_half_up(c, 3)
    return samples.groupBy("metric").agg(F.count("*").alias("count"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), r(F.avg("value")).alias("mean"), r(p(0.5)).alias("p50"), r(p(0.95)).alias("p95"), r(p(0.99)).alias("p99"))


def recent_samples(samples: DataFrame, keep: int = KEPT_SAMPLES) -> DataFrame:
    """The latest ``keep`` samples (metric, id, ts, value) of each metric."""
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("ts").desc(), F.col("id").desc()))
    return samples.withColumn("_n", place).where(F.col("_n") <= keep).drop("_n")


def tuning_summary(samples: DataFrame) -> DataFrame:
    """(threads, q50, q95, b50, b95, stable) of samples (threads, kind, ms), kind being query or batch; only positive finite samples count."""
    good = samples.where("ms > 0 and not isnan(ms) and ms < double('inf')")
    p = lambda kind, q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms) FILTER (WHERE kind = '{kind}')")
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    s = good.groupBy("threads").agg(p("query", 0.5).alias("q50"), p("query", 0.95).alias("q95"), p("batch", 0.5).alias("b50"), p("batch", 0.95).alias("b95"), n("query").alias("qn"), n("batch").alias("bn"))
    stable = (F.col("qn") >= MIN_SAMPLES) & (F.col("bn") >= MIN_SAMPLES) & (F.col("q95") / F.col("q50") <= MAX_RATIO) & (F.col("b95") / F.col("b50") <= MAX_RATIO)
    return s.select("threads", "q50", "q95", "b50", "b95", F.coalesce(stable, F.lit(False)).alias("stable"))


def tuning_selection(summary: DataFrame) -> DataFrame:
    """One row (threads, reason): the best stable candidate, or 0 if none is better than the automatic baseline by 3 %."""
    base = summary.where("threads = 0 and stable").select(*[F.col(c).alias(f"{c}_0") for c in ("q50", "q95", "b50", "b95")])
    x = summary.where("threads <> 0 and stable").crossJoin(F.broadcast(base))
    fits = (F.col("q50") <= F.col("q50_0") * QUERY_P50) & (F.col("q95") <= F.col("q95_0") * QUERY_P95) & (F.col("b50") <= F.col("b50_0") * BATCH_P50) & (F.col("b95") <= F.col("b95_0") * BATCH_P95)
    score = F.col("q50") / F.col("q50_0") * 0.7 + F.col("b50") / F.col("b50_0") * 0.3
    best = x.where(fits).agg(F.min(F.struct(score.alias("score"), "threads")).alias("b"))
    won = F.col("b.score") <= 1 - MIN_GAIN
    reason = F.when(F.col("b").isNull(), "inconclusive").when(won, "improved").otherwise("automatic-within-noise")
    return best.select(F.when(F.coalesce(won, F.lit(False)), F.col("b.threads")).otherwise(F.lit(0)).cast("int").alias("threads"), reason.alias("reason"))
