"""Queries of requests and their control: stale results, scope changes, compositions, queues, policies, selections, acceptance, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.functions import codec
from linkrank.operators import planner
from linkrank.plans.catalogue import query
from linkrank.sources import snapshot, tables
from linkrank.streaming import events as E


@query(
    """WITH r AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS latest, event_type AS k, arg_max(event_type, event_id) OVER (PARTITION BY user_id) AS lk FROM events)
    SELECT event_id, user_id FROM r WHERE event_id = latest AND k = lk AND k <> 'error' AND value < 60 AND NOT coalesce(value > 55, false)"""
)
def fresh_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's results, the one that may still be shown."""
    e = tables.read(spark, sf_dir, "events")
    last = E.latest_by_id(e, "user_id").select("user_id", F.col("event_id").alias("latest_request"), F.col("event_type").alias("latest_key"))
    r = e.join(last, "user_id").select(
        "event_id", "user_id", (F.col("event_type") == "error").alias("disposed"), (F.col("value") >= 60).alias("aborted"), F.col("event_id").alias("request"), "latest_request", F.col("event_type").alias("key"), "latest_key", F.col("event_type").alias("current_key"), F.lit(True).alias("pending"), (F.col("value") > 55).alias("suppressed"),
    )
    return E.fresh_results(r).select("event_id", "user_id")


@query(
    """WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), d AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM c WHERE was IS DISTINCT FROM event_type)
    SELECT user_id, ts FROM d WHERE nx IS NULL OR nx >= ts + INTERVAL 2 HOUR"""
)
def scope_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").withColumn("fingerprint", F.col("event_type"))
    return E.scope_rebuilds(e, "user_id", "2 hours")


@query(
    """SELECT event_id, user_id FROM (SELECT *, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM events)
    WHERE coalesce(turn, '') <> 'click' AND event_type NOT IN ('click', 'purchase')"""
)
def outside_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside of what a click begins and a purchase ends."""
    return E.outside_composition(tables.read(spark, sf_dir, "events"), "user_id", "event_type", "click", "purchase").select("event_id", "user_id")


@query(
    """WITH t AS (SELECT user_id, event_id, event_id AS arrival, 1 + event_id % 4000 AS took FROM events), s AS (SELECT *, sum(took) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM t)
    SELECT user_id, event_id, CAST(s + max(arrival - s + took) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS ended, CAST(s + max(arrival - s + took) OVER (PARTITION BY user_id ORDER BY event_id) - took AS BIGINT) AS started FROM s"""
)
def serial_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("long").alias("arrival"), (1 + F.col("event_id") % 4000).cast("long").alias("took"))
    return E.serial_queue(e, "user_id", "arrival", "took", ["event_id"]).select("user_id", "event_id", "ended", "started")


@query(
    """SELECT c_custkey, CASE WHEN l AND s THEN 'hybrid' WHEN l THEN 'lexical' WHEN s THEN 'semantic' ELSE 'none' END AS policy, CASE WHEN n > 0 THEN ((i + b) % n + n) % n ELSE -1 END AS selected
    FROM (SELECT c_custkey, c_custkey % 2 = 0 AS l, c_custkey % 3 = 0 AS s, CAST(c_custkey % 7 AS INT) AS i, CAST(c_nationkey - 12 AS INT) AS b, CAST(c_custkey % 5 AS INT) AS n FROM customer)"""
)
def policies_and_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select("c_custkey", E.matching_policy(key % 2 == 0, key % 3 == 0).alias("policy"), F.coalesce(E.selected((key % 7).cast("int"), (F.col("c_nationkey") - 12).cast("int"), (key % 5).cast("int")), F.lit(-1)).alias("selected"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, lang, source FROM documents),
    a AS (SELECT *, CASE lang WHEN 'fr' THEN -1 ELSE 2 END AS s, CASE lang WHEN 'de' THEN n + 5 ELSE 8 END AS e, CASE WHEN source = 'src3' THEN 'other' ELSE substr(t, 3, 6) END AS expected, source = 'src4' AS gone FROM d)
    SELECT doc_id, CASE WHEN s < 0 OR e <= s OR e > n THEN 'invalid-range' WHEN substr(t, s + 1, e - s) <> expected THEN 'changed-anchor' WHEN gone THEN 'target-not-found' ELSE 'ok' END AS code FROM a"""
)
def accepted_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an acceptance finds: a range that is no more, another text in it, a target that has gone, or all as it was."""
    d = tables.read(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    asked = d.select("doc_id", F.col("t").alias("text"), F.when(F.col("lang") == "fr", -1).otherwise(2).alias("anchor_start"), F.when(F.col("lang") == "de", F.char_length("t") + 5).otherwise(8).alias("anchor_end"), F.when(F.col("source") == "src3", "other").otherwise(F.substr("t", F.lit(3), F.lit(6))).alias("expected"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("target_path"))
    known = d.where("source is null or source <> 'src4'").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("target_path"))
    return E.acceptance(asked, known).select("doc_id", "code")


@query("SELECT page_id, md5(html) || md5(url) AS sha256, CAST(strlen(html) - 500 AS BIGINT) AS bytes, strlen(html) >= 500 AND NOT url LIKE '%#top' AS sound FROM pages")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a manifest, some with doubtful figures."""
    p = tables.read(spark, sf_dir, "pages")
    digest = F.concat(F.md5(F.col("html").cast("binary")), F.md5(F.col("url").cast("binary")))
    e = p.select("page_id", "url", digest.alias("sha256"), (F.octet_length("html") - 500).cast("long").alias("bytes"))
    doubtful = F.when(F.col("url").like("%#top"), F.upper(F.concat(F.lit("x"), "sha256"))).otherwise(F.col("sha256"))
    return e.select("page_id", "sha256", "bytes", snapshot.sound_entry(doubtful, F.col("bytes")).alias("sound"))


@query("SELECT vec_id, true AS finite, CAST(ceil(4 * len(embedding) / 3.0) AS BIGINT) AS least_chars FROM embeddings WHERE len(embedding) > 0")
def coded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through their text and back: finite where they are sampled, equal to what they were, and of the right length."""
    e = tables.read(spark, sf_dir, "embeddings").where("size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    x = e.withColumn("text", codec.encode_vector(F.col("v"))).where(codec.sound(F.col("text"))).withColumn("back", codec.decode_vector(F.col("text")))
    whole = F.ceil(F.size("back") * 4 / 3.0).cast("long")
    return x.where((F.col("back") == F.col("v")) & (F.char_length("text") >= whole)).select("vec_id", codec.finite_sample(F.col("back")).alias("finite"), whole.alias("least_chars"))


@query(
    """WITH i AS (SELECT event_id AS id, CASE WHEN event_type = 'error' OR value < 1 THEN 1 ELSE CAST(floor(value) AS BIGINT) END AS tokens, event_id AS position FROM events),
    p AS (SELECT *, CAST(floor((tokens - 1) / 32) AS BIGINT) AS bucket FROM i) SELECT id, bucket, tokens, CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY tokens, position) - 1) / 16) AS BIGINT) AS batch FROM p"""
)
def checked_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of inputs of which some have no estimate: these count as one token."""
    e = tables.read(spark, sf_dir, "events")
    estimate = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.floor("value")).cast("long")
    return planner.checked_plan(e.select(F.col("event_id").alias("id"), estimate.alias("tokens"), F.col("event_id").alias("position"))).select("id", "bucket", "tokens", "batch")
