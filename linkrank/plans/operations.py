"""Queries of batch planning, tuning, telemetry and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.functions import text as T
from linkrank.operators import planner
from linkrank.plans.catalogue import query
from linkrank.sources import tables
from linkrank.streaming import events as E

ESTIMATE = r"""est AS MATERIALIZED (SELECT doc_id, CAST(greatest(1, list_sum(list_concat([0], list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+'), lambda w: greatest(1, ceil(strlen(w) / 4)))))
  + len(regexp_extract_all(text, '[\p{P}\p{S}]')) + ceil(strlen(text) / 32)) AS BIGINT) AS tokens FROM documents)"""
PLAN = f"{ESTIMATE}, b AS (SELECT doc_id, tokens, (tokens - 1) // 32 AS bucket FROM est), p AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY tokens, doc_id) - 1) // 16 AS batch FROM b)"


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"), F.col("doc_id").alias("position"))


@query(f"WITH {ESTIMATE} SELECT doc_id AS id, tokens, (tokens - 1) // 32 AS bucket FROM est")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir).select("id", "tokens", planner.bucket(F.col("tokens")).alias("bucket"))


@query(f"WITH {PLAN} SELECT bucket, batch, doc_id AS id, tokens FROM p")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.batch_plan(_estimates(spark, sf_dir))


@query(
    f"""WITH {PLAN}, s AS (SELECT bucket, batch, sum(tokens) AS t, max(tokens) * count(*) AS padded FROM p GROUP BY ALL), fx AS (SELECT max(tokens) * count(*) AS padded FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS g FROM est) GROUP BY g)
    SELECT CAST((SELECT count(*) FROM est) AS BIGINT) AS inputs, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS batches, count(DISTINCT bucket) AS buckets, CAST(sum(padded) AS BIGINT) AS bucketed_padded, CAST((SELECT sum(padded) FROM fx) AS BIGINT) AS fixed_padded FROM s"""
)
def padding_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkrank.operators.incremental import dense_rows

    x = _estimates(spark, sf_dir)
    stats = planner.batch_stats(planner.batch_plan(x)).agg(F.coalesce(F.sum("inputs"), F.lit(0)).alias("inputs"), F.sum("total_tokens").alias("tokens"), F.count("*").alias("batches"), F.countDistinct("bucket").alias("buckets"), F.sum("padded_tokens").alias("bucketed_padded"))
    fixed = dense_rows(x, [F.col("position").asc_nulls_last()]).groupBy(F.floor(F.col("row") / planner.BATCH_SIZE)).agg((F.max("tokens") * F.count("*")).alias("p")).agg(F.sum("p").alias("fixed_padded"))
    return stats.crossJoin(F.broadcast(fixed))


TUNING = "s AS (SELECT CASE WHEN user_id % 4 = 3 THEN 4 ELSE user_id % 4 END AS threads, CASE WHEN event_id % 2 = 0 THEN 'query' ELSE 'batch' END AS kind, 100 + value / 10 - user_id % 4 AS ms FROM events)"


def _tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    threads = F.col("user_id") % 4
    return planner.tuning_summary(e.select(F.when(threads == 3, 4).otherwise(threads).alias("threads"), F.when(F.col("event_id") % 2 == 0, "query").otherwise("batch").alias("kind"), (100 + F.col("value") / 10 - threads).alias("ms")))


SUMMARY = f"""{TUNING}, u AS (SELECT threads, quantile_disc(ms, 0.5) FILTER (kind = 'query') AS q50, quantile_disc(ms, 0.95) FILTER (kind = 'query') AS q95, quantile_disc(ms, 0.5) FILTER (kind = 'batch') AS b50, quantile_disc(ms, 0.95) FILTER (kind = 'batch') AS b95,
  count(*) FILTER (kind = 'query') AS qn, count(*) FILTER (kind = 'batch') AS bn FROM s WHERE ms > 0 AND isfinite(ms) GROUP BY threads), w AS (SELECT *, coalesce(qn >= 3 AND bn >= 3 AND q95 / q50 <= 2.5 AND b95 / b50 <= 2.5, false) AS stable FROM u)"""


@query(f"WITH {SUMMARY} SELECT threads, floor(q50 * 1000 + 0.5) / 1000 AS q50, floor(q95 * 1000 + 0.5) / 1000 AS q95, floor(b50 * 1000 + 0.5) / 1000 AS b50, floor(b95 * 1000 + 0.5) / 1000 AS b95, stable FROM w")
def tuning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuning(spark, sf_dir).select("threads", *[T.round_half_up(F.col(c), 3).alias(c) for c in ("q50", "q95", "b50", "b95")], "stable")


@query(
    f"""WITH {SUMMARY}, z AS (SELECT * FROM w WHERE threads = 0 AND stable), c AS (SELECT w.threads, w.q50 / z.q50 * 0.7 + w.b50 / z.b50 * 0.3 AS score FROM w, z WHERE w.threads <> 0 AND w.stable AND w.q50 <= z.q50 * 1.05 AND w.q95 <= z.q95 * 1.10 AND w.b50 <= z.b50 * 1.10 AND w.b95 <= z.b95 * 1.15),
    b AS (SELECT min(score) AS score, arg_min(threads, (score, threads)) AS threads FROM c) SELECT CAST(CASE WHEN score <= 1 - 0.03 THEN threads ELSE 0 END AS INT) AS threads, CASE WHEN score IS NULL THEN 'inconclusive' WHEN score <= 1 - 0.03 THEN 'improved' ELSE 'automatic-within-noise' END AS reason FROM b"""
)
def tuning_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.tuning_selection(_tuning(spark, sf_dir))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("id"), "ts", "value")


R3 = "floor({} * 1000 + 0.5) / 1000"


@query(
    f"SELECT event_type AS metric, count(*) AS count, {R3.format('min(value)')} AS min, {R3.format('max(value)')} AS max, {R3.format('avg(value)')} AS mean, {R3.format('quantile_disc(value, 0.5)')} AS p50, {R3.format('quantile_disc(value, 0.95)')} AS p95, {R3.format('quantile_disc(value, 0.99)')} AS p99 FROM events GROUP BY event_type"
)
def latency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.distribution(_samples(spark, sf_dir))


@query("SELECT event_type AS metric, count(*) AS increments, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY event_type")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("increments"), T.round_half_up(F.sum("value"), 2).alias("total"))


@query("SELECT event_type AS metric, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).groupBy("metric").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


@query("SELECT event_type AS metric, event_id AS id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 2048")
def bounded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.recent_samples(_samples(spark, sf_dir)).select("metric", "id", "value")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, count(*) AS n_events, arg_max(event_id, (ts, event_id)) AS last_event, max(ts) AS last_ts FROM s GROUP BY user_id, k"""
)
def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.debounce(tables.read(spark, sf_dir, "events"), "user_id", "30 minutes")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def dedup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.without_repeats(tables.read(spark, sf_dir, "events"), "user_id", "event_type").select("event_id", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest(tables.read(spark, sf_dir, "events"), "user_id").select("user_id", "event_id")


@query("SELECT event_id, user_id, event_type FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events m WHERE m.event_type = 'error' AND m.user_id = e.user_id AND m.ts <= e.ts AND e.ts < m.ts + INTERVAL 1 HOUR)")
def suppressed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.outside_suppression(tables.read(spark, sf_dir, "events"), "user_id", "error", 3600).select("event_id", "user_id", "event_type")


@query(
    "SELECT user_id, event_id, floor(d * 1000 + 0.5) / 1000 AS delay_ms, d >= 50 AS long_task FROM (SELECT user_id, event_id, greatest(0.0, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0 - 250) AS d, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL"
)
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gaps(tables.read(spark, sf_dir, "events"), "user_id").withColumn("delay_ms", T.round_half_up(F.col("delay_ms"), 3))
