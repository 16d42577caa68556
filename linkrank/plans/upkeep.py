"""Queries of links, index upkeep, deltas, diagnostics, device classes, request keys and the evaluation corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.functions import hashing
from linkrank.functions import text as T
from linkrank.operators import diagnostics, evaluation, incremental, lexical, links, planner, relevance, upkeep
from linkrank.plans.catalogue import query
from linkrank.plans.operations import R3
from linkrank.sources import tables

# --- links: notes in folders with recurring base names; link texts as base names, whole paths with and without extension, and in capitals
LINKED = """n AS (SELECT DISTINCT source || '/' || (doc_id % 97) || '.md' AS path FROM documents WHERE source IS NOT NULL),
l AS (SELECT doc_id, source || '/' || (doc_id % 97) || '.md' AS source_path, (doc_id * 13) % 120 AS t,
      CASE lang WHEN 'en' THEN CAST((doc_id * 13) % 120 AS VARCHAR) WHEN 'de' THEN 'src' || (doc_id % 23) || '/' || ((doc_id * 13) % 120) || '#Part' WHEN 'fr' THEN 'SRC' || (doc_id % 23) || '/' || ((doc_id * 13) % 120) || '.MD|alias' ELSE '/' || ((doc_id * 13) % 120) || '.md' END AS link
      FROM documents WHERE source IS NOT NULL),
k AS (SELECT *, regexp_replace(trim(regexp_replace(lower(regexp_replace(link, '[|#].*$', '')), '^/+|/+$', '', 'g')), '\\.md$', '') AS key, split_part(source_path, '/', 1) AS folder FROM l),
r AS (SELECT k.*, coalesce((SELECT min(path) FROM n WHERE regexp_replace(n.path, '\\.md$', '') = k.key), (SELECT min(path) FROM n WHERE n.path = k.folder || '/' || k.key || '.md'), (SELECT min(path) FROM n WHERE split_part(n.path, '/', 2) = k.key || '.md')) AS target_path FROM k)"""


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = tables.read(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", "lang", F.concat("source", F.lit("/"), (F.col("doc_id") % 97).cast("string"), F.lit(".md")).alias("path"))
    target, folder = ((F.col("doc_id") * 13) % 120).cast("string"), (F.col("doc_id") % 23).cast("string")
    text = F.when(F.col("lang") == "en", target).when(F.col("lang") == "de", F.concat(F.lit("src"), folder, F.lit("/"), target, F.lit("#Part"))).when(F.col("lang") == "fr", F.concat(F.lit("SRC"), folder, F.lit("/"), target, F.lit(".MD|alias"))).otherwise(F.concat(F.lit("/"), target, F.lit(".md")))
    return d.select("doc_id", F.col("path").alias("source_path"), text.alias("link")), d.select("path").distinct()


@query(f"WITH {LINKED} SELECT doc_id, link, target_path FROM r")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.resolve(*_links(spark, sf_dir)).select("doc_id", "link", "target_path")


@query(f"WITH {LINKED} SELECT source_path, array_to_string(list_sort(list_distinct(list(target_path))), ' ') AS targets FROM r WHERE target_path IS NOT NULL GROUP BY source_path")
def outgoing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.outgoing(*_links(spark, sf_dir)).select("source_path", F.array_join("targets", " ").alias("targets"))


@query(
    """WITH w AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, coalesce(list_filter(list_transform(string_split(text, chr(10))[1:3], lambda l: trim(l)), lambda h: h <> ''), []) AS hs FROM documents),
    a AS (SELECT doc_id, path, hs, CASE WHEN doc_id % 2 = 0 THEN '## ' || hs[len(hs)] ELSE hs[1] || ' x' END AS heading FROM w)
    SELECT doc_id, heading IS NULL OR list_contains(list_transform(hs, lambda h: regexp_replace(regexp_replace(h, '^#+', ''), '^ +| +$', '', 'g')), regexp_replace(regexp_replace(heading, '^#+', ''), '^ +| +$', '', 'g')) AS found FROM a WHERE path IS NOT NULL"""
)
def heading_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 3), F.trim), lambda h: h != "")
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), lines.alias("headings")).where("path is not null")
    asked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## "), F.element_at("headings", -1))).otherwise(F.concat(F.get("headings", F.lit(0)), F.lit(" x")))
    named = d.select("doc_id", F.col("path").alias("target_path"), F.when(F.size("headings") > 0, asked).alias("heading"))
    return links.with_heading(named, d).select("doc_id", "found")


# --- the index: documents with a chunk for each line, vectors of those that the embeddings table has
INDEX = """d AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, source, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, path, source, lang, doc_id || '-' || md5(line) AS id, min(n) AS n FROM (SELECT *, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d) GROUP BY ALL),
v AS (SELECT c.id AS chunk_id, c.doc_id FROM c WHERE c.n = 1 AND c.doc_id IN (SELECT vec_id FROM embeddings))"""


def _lines(d: DataFrame, text) -> DataFrame:
    made = F.transform(F.split(text, "\n"), lambda x: F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.md5(x.cast("binary"))))
    return d.select("doc_id", "path", "source", "lang", F.col("doc_id").cast("string").alias("id"), F.array_distinct(made).alias("chunk_ids"), F.get(made, F.lit(0)).alias("first"))


def _index(spark: SparkSession, sf_dir: str) -> upkeep.Index:
    d = tables.read(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    lines = _lines(d, F.coalesce("text", F.lit("")))
    e = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    chunks = lines.select(F.explode("chunk_ids").alias("id"), F.col("id").alias("document_id"))
    return upkeep.Index(lines.select("path", "id", "chunk_ids"), chunks, lines.select("doc_id", F.col("first").alias("chunk_id")).join(e, "doc_id").select("chunk_id", "vector"))


def _sizes(index: upkeep.Index, spark: SparkSession) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(index.documents, "documents").unionByName(count(index.chunks, "chunks")).unionByName(count(index.vectors, "vectors"))


@query(f"WITH {INDEX} SELECT 'documents' AS part, (SELECT count(*) FROM d WHERE source <> 'src1') AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM c WHERE source <> 'src1') UNION ALL SELECT 'vectors', (SELECT count(*) FROM v JOIN d USING (doc_id) WHERE source <> 'src1')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after one source has gone, chunks and vectors with it."""
    index = _index(spark, sf_dir)
    return _sizes(upkeep.remove(index, index.documents.where("path like 'src1/%'").select("path")), spark)


REPLACED = f"""{INDEX}, f AS (SELECT doc_id, source, replace(t, 'the', 'tho') AS t FROM d WHERE source = 'src2'),
fc AS (SELECT DISTINCT doc_id || '-' || md5(line) AS id FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM f)),
nc AS (SELECT id FROM c WHERE source <> 'src2' UNION ALL SELECT id FROM fc), nv AS (SELECT chunk_id FROM v JOIN d USING (doc_id) WHERE source <> 'src2' OR chunk_id IN (SELECT id FROM fc))"""


@query(f"WITH {REPLACED} SELECT 'documents' AS part, (SELECT count(*) FROM d) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM nc) UNION ALL SELECT 'vectors', (SELECT count(*) FROM nv)")
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after one source has been written anew; vectors of lines that stay are kept."""
    index = _index(spark, sf_dir)
    d = tables.read(spark, sf_dir, "documents").where("source = 'src2'").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    fresh = _lines(d, F.replace(F.coalesce("text", F.lit("")), F.lit("the"), F.lit("tho")))
    return _sizes(upkeep.replace(index, fresh.select("path", "id", "chunk_ids"), fresh.select(F.explode("chunk_ids").alias("id"), F.col("id").alias("document_id"))), spark)


@query(f"WITH {INDEX} SELECT c.id FROM c WHERE id NOT IN (SELECT chunk_id FROM v)")
def chunks_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return upkeep.missing(index.chunks, index.vectors).select("id")


@query(
    """SELECT CASE WHEN lang = 'fr' THEN 'archive/' || doc_id || '.md' ELSE source || '/' || doc_id || '.md' END AS path, doc_id AS id, CASE WHEN lang = 'fr' THEN -1 ELSE doc_id END AS modified_at FROM documents WHERE source IS NOT NULL"""
)
def renamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after those of one language have moved to a folder: ids stay, moved ones are due to be read."""
    d = tables.read(spark, sf_dir, "documents").where("source is not null").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("doc_id").alias("id"), F.col("doc_id").cast("long").alias("modified_at"), "lang")
    moves = d.where("lang = 'fr'").select(F.col("path").alias("old_path"), F.concat(F.lit("archive/"), F.col("id").cast("string"), F.lit(".md")).alias("new_path"))
    return upkeep.rename(d.drop("lang"), moves)


@query("SELECT vec_id, label FROM embeddings WHERE 'rev-' || (label % 2) = 'rev-1' AND len(embedding) = (SELECT max(len(embedding)) FROM embeddings)")
def current_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that survive a change of model: those of its revision and dimensions."""
    e = tables.read(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(F.lit("rev-"), (F.col("label") % 2).cast("string")).alias("revision"), F.size("embedding").alias("dimensions"))
    widest = e.agg(F.max("dimensions")).first()[0] or 0
    return upkeep.current_vectors(e, {"revision": "rev-1", "dimensions": widest}).select("vec_id", "label")


PATHS = """o AS (SELECT source || '/' || doc_id AS path, doc_id AS m FROM documents WHERE source <> 'src1'),
n AS (SELECT source || '/' || doc_id AS path, doc_id + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS m, source = 'src3' AS off FROM documents WHERE source <> 'src2'), e AS (SELECT source || '/' || doc_id AS path FROM documents WHERE lang = 'es' AND source <> 'src2'),
a AS (SELECT path, CASE WHEN NOT n_there THEN 'deleted' WHEN off THEN 'excluded' WHEN m2 IS DISTINCT FROM m1 THEN 'changed' WHEN fresh THEN 'embedded' END AS cause
      FROM (SELECT coalesce(o.path, n.path) AS path, n.path IS NOT NULL AS n_there, off, o.m AS m1, n.m AS m2, coalesce(o.path, n.path) IN (SELECT path FROM e) AS fresh FROM o FULL JOIN n USING (path)))"""


@query(f"WITH {PATHS} SELECT path, cause FROM a WHERE cause IS NOT NULL")
def affected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old state without one source, new state without another; a folder is excluded, a language touched, another embedded anew."""
    d = tables.read(spark, sf_dir, "documents").where("source is not null").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "source", "lang", F.col("doc_id").cast("long").alias("modified_at"))
    old, live = d.where("source <> 'src1'"), d.where("source <> 'src2'")
    live = live.withColumn("modified_at", F.col("modified_at") + F.when(F.col("lang") == "de", 1).otherwise(0))
    return upkeep.affected_paths(old, live, F.startswith("path", F.lit("src3/")), live.where("lang = 'es'").select("path"))


@query(
    f"""WITH {INDEX}, p AS (SELECT path FROM d WHERE lang = 'de' UNION SELECT 'gone/' || doc_id FROM d WHERE lang = 'es')
    SELECT p.path, CASE WHEN d.path IS NULL THEN 'remove' ELSE 'upsert' END AS op, coalesce((SELECT count(*) FROM c WHERE c.path = p.path), 0) AS chunks, coalesce((SELECT count(*) FROM v WHERE v.doc_id = d.doc_id), 0) AS vectors FROM p LEFT JOIN d ON d.path = p.path WHERE p.path IS NOT NULL"""
)
def journal_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log has to hold for the documents of two languages, of which one has gone: upserts with chunks and vectors, and removals."""
    index = _index(spark, sf_dir)
    d = tables.read(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")).where("path is not null")
    paths = d.where("lang = 'de'").select("path").unionByName(d.where("lang = 'es'").select(F.concat(F.lit("gone/"), "id").alias("path")))
    out = upkeep.delta(paths, index)
    return out.select("path", "op", F.size("chunks").cast("long").alias("chunks"), F.size(F.filter("chunks", lambda c: c["vector"].isNotNull())).cast("long").alias("vectors"))


@query(
    """WITH i AS (SELECT CASE WHEN label = 0 THEN 'x' ELSE CAST(vec_id AS VARCHAR) END AS id FROM embeddings WHERE label <> 1), o AS (SELECT CASE WHEN label = 2 THEN 'y' ELSE CAST(vec_id AS VARCHAR) END AS id, CASE WHEN label = 3 THEN 1 ELSE len(embedding) END AS n FROM embeddings),
    a AS (SELECT id, count(*) AS asked FROM i GROUP BY id), g AS (SELECT id, count(*) AS given, min(n) AS n FROM o GROUP BY id)
    SELECT id, problem FROM (SELECT coalesce(a.id, g.id) AS id, CASE WHEN asked IS NULL THEN 'unexpected' WHEN asked > 1 THEN 'repeated input' WHEN given IS NULL THEN 'omitted' WHEN given > 1 THEN 'repeated output' WHEN n <> (SELECT max(len(embedding)) FROM embeddings) THEN 'wrong dimensions' END AS problem FROM a FULL JOIN g ON a.id = g.id) WHERE problem IS NOT NULL"""
)
def output_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs with deliberate faults, by label: repeated inputs, unexpected, omitted and repeated outputs, wrong dimensions."""
    e = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", F.col("embedding").alias("vector"))
    wide = e.agg(F.max(F.size("vector"))).first()[0] or 0
    asked = e.where("label <> 1").select(F.when(F.col("label") == 0, "x").otherwise(F.col("id")).alias("id"))
    given = e.select(F.when(F.col("label") == 2, "y").otherwise(F.col("id")).alias("id"), F.when(F.col("label") == 3, F.slice("vector", 1, 1)).otherwise(F.col("vector")).alias("vector"))
    return upkeep.output_mismatches(asked, given, wide)


@query("SELECT vec_id, floor(CAST(embedding[1] AS DOUBLE) * 1000000 + 0.5) / 1000000 AS first, CAST(len(embedding) AS INT) AS dimensions FROM embeddings")
def unpacked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as the row of a flat matrix of three, cut out again."""
    e = tables.read(spark, sf_dir, "embeddings")
    wide = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    row = (F.col("vec_id") % 3).cast("int")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), wide)
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == row, F.col("embedding").cast("array<float>")).otherwise(zeros)))
    back = upkeep.unpack(e.select(F.col("vec_id").alias("chunk_id"), row.alias("vector_row"), flat.alias("matrix")), wide)
    return back.select(F.col("chunk_id").alias("vec_id"), T.round_half_up(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"), F.size("vector").alias("dimensions"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, event_id) AS served FROM events")
def served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries before background work, each in order of arrival."""
    r = tables.read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", 0).otherwise(1).alias("priority"), F.col("event_id").alias("position"))
    return upkeep.served_order(r, "user_id").select("user_id", "event_id", "served")


# --- device classes, request keys


@query(
    """SELECT c_custkey, CASE WHEN c <= 2 THEN '1-2' WHEN c <= 4 THEN '3-4' WHEN c <= 8 THEN '5-8' ELSE '9+' END AS device_class, CASE WHEN c >= 4 THEN '0,1,2,4' WHEN c >= 2 THEN '0,1,2' ELSE '0,1' END AS candidates,
    c_nationkey % 3 = 0 AS compatible FROM (SELECT *, c_custkey % 12 AS c FROM customer)"""
)
def thread_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer").withColumn("cores", (F.col("c_custkey") % 12).cast("double"))
    same = {"model_revision": F.lit("m"), "runtime_version": (F.col("c_nationkey") % 3).cast("string"), "device_class": planner.device_class(F.col("cores"))}
    return c.select("c_custkey", planner.device_class(F.col("cores")).alias("device_class"), F.array_join(F.transform(planner.thread_candidates(F.col("cores")), lambda t: t.cast("string")), ",").alias("candidates"), planner.tuning_compatible(same, same | {"runtime_version": F.lit("0")}).alias("compatible"))


@query(
    """SELECT conv_id, turn, '["' || conv_id || '.md",' || turn || ',0,' || n || ',"' || w || '","h",' || CASE WHEN role = 'user' THEN '"manual"' ELSE '"automatic"' END || ']' AS request_key, n > 0 AND NOT (role = 'assistant' AND turn > 2) AS valid
    FROM (SELECT *, length(w) AS n FROM (SELECT *, coalesce(regexp_extract(text, '[A-Za-z]+'), '') AS w FROM conversations))"""
)
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.coalesce(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(""))
    c = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", word.alias("w"))
    path, mode = F.concat(F.col("conv_id").cast("string"), F.lit(".md")), F.when(F.col("role") == "user", "manual").otherwise("automatic")
    parts = {"file_path": path, "document_version": F.col("turn"), "anchor_start": F.lit(0), "anchor_end": F.char_length("w"), "anchor_text": F.col("w"), "context_hash": F.lit("h"), "mode": mode}
    doubtful = parts | {"mode": F.when((F.col("role") == "assistant") & (F.col("turn") > 2), "other").otherwise(mode)}
    return c.select("conv_id", "turn", hashing.request_key(**parts).alias("request_key"), hashing.valid_request(**doubtful).alias("valid"))


# --- diagnostics

KEPT = "k AS (SELECT CASE WHEN event_type = 'error' THEN 'Bad Name' ELSE event_type END AS metric, value FROM events), s AS (SELECT * FROM k WHERE regexp_matches(metric, '^[a-z][a-z0-9_.-]*$') AND isfinite(value) AND value >= 0)"
TEXT3 = "CAST(floor({} * 1000 + 0.5) / 1000 AS DOUBLE)"


@query(f"WITH {KEPT} SELECT metric, count(*) AS n, {R3.format('max(value)')} AS largest FROM s GROUP BY metric")
def recorded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that a session keeps; one metric has a bad name."""
    e = tables.read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "Bad Name").otherwise(F.col("event_type")).alias("metric"), "value")
    return diagnostics.recorded(e).groupBy("metric").agg(F.count("*").alias("n"), T.round_half_up(F.max("value"), 3).alias("largest"))


@query("SELECT event_type AS metric, greatest(count(*) - 1000, 0) AS evicted, least(count(*), 1000) AS kept FROM events GROUP BY event_type")
def evicted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("id"), "ts", "value")
    kept, gone = diagnostics.bounded(e, 1000)
    return gone.join(kept.groupBy("metric").agg(F.count("*").alias("kept")), "metric").select("metric", "evicted", "kept")


@query("SELECT 'memory.n' || n_nationkey || '.heap_used_bytes' AS metric, CAST(n_regionkey AS DOUBLE) AS value FROM nation UNION ALL SELECT 'memory.n' || n_nationkey || '.heap_total_bytes', CAST(n_nationkey * 10 AS DOUBLE) FROM nation WHERE n_nationkey > 4")
def memory_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.read(spark, sf_dir, "nation")
    usage = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_regionkey").alias("heap_used"), F.when(F.col("n_nationkey") > 4, F.col("n_nationkey") * 10).otherwise(-1).alias("heap_total"))
    return diagnostics.memory_gauges(usage)


@query(
    """SELECT '{"schemaVersion":1,"samples":{},"counters":{' || string_agg('"' || metric || '":' || CAST(n AS DOUBLE), ',' ORDER BY metric) || '},"gauges":{' || string_agg('"' || metric || '":' || v, ',' ORDER BY metric)
    || '},"budgets":{"warmQueryP95Ms":200,"eventLoopDelayP95Ms":16,"longTaskMs":50,"backgroundSliceP95Ms":100,"checkpointP95Ms":250,"modelAndIndexMemoryMb":512}}' AS report
    FROM (SELECT event_type AS metric, count(*) AS n, CAST(max(event_id) % 1000 AS DOUBLE) AS v FROM events GROUP BY event_type)"""
)
def diagnostics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and gauges of the events in one JSON row; tests hold the distributions, whose numbers DuckDB writes differently."""
    e = tables.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), (F.max("event_id") % 1000).alias("v"))
    none = e.select("metric", F.lit(0.0).alias("value")).where("false")
    return diagnostics.report(none, e.select("metric", F.col("n").cast("double").alias("value")), e.select("metric", F.col("v").cast("double").alias("value")))


@query(
    f"""WITH s AS (SELECT event_type AS metric, {R3.format('quantile_disc(value, 0.95)')} AS p95 FROM events GROUP BY event_type)
    SELECT metric, p95, CASE metric WHEN 'click' THEN 50.0 WHEN 'view' THEN 1000.0 ELSE 10.0 END AS budget FROM s WHERE p95 > CASE metric WHEN 'click' THEN 50.0 WHEN 'view' THEN 1000.0 WHEN 'error' THEN 10.0 WHEN 'purchase' THEN 10.0 WHEN 'signup' THEN 10.0 END"""
)
def over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    return diagnostics.over_budget(planner.distribution(e), {"click": 50.0, "view": 1000.0, "error": 10.0, "purchase": 10.0, "signup": 10.0})


# --- evaluation: parts and nations as seeds

SEEDS = """seed AS (SELECT n_nationkey AS position, lower(replace(n_name, ' ', '-')) AS slug, n_name AS title, 'of ' || n_name AS alias, 'nation ' || n_nationkey AS second_title, 'region ' || n_regionkey AS heading, 'About ' || n_name AS body, 'second text' AS second_body,
 'meaning ' || n_regionkey AS meaning, 'second ' || n_nationkey AS second_meaning, 'mixed ' || n_name AS mixed, 'either ' || n_regionkey AS ambiguous FROM nation),
ring AS (SELECT *, coalesce(lead(slug) OVER (ORDER BY position), first_value(slug) OVER (ORDER BY position)) AS following FROM seed),
kinds(category, language, k) AS (VALUES ('exact-title', 'en', 1), ('alias', 'en', 2), ('heading', 'en', 3), ('semantic-only', 'en', 4), ('semantic-only', 'ar', 5), ('mixed-language', 'mixed', 6), ('ambiguous', 'en', 7))"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.read(spark, sf_dir, "nation")
    text = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    return n.select(
        F.col("n_nationkey").alias("position"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("slug"), F.col("n_name").alias("title"), text("of ", "n_name").alias("alias"), text("nation ", "n_nationkey").alias("second_title"), text("region ", "n_regionkey").alias("heading"),
        text("About ", "n_name").alias("body"), F.lit("second text").alias("second_body"), text("meaning ", "n_regionkey").alias("meaning"), text("second ", "n_nationkey").alias("second_meaning"), text("mixed ", "n_name").alias("mixed"), text("either ", "n_regionkey").alias("ambiguous"),
    )


@query(
    f"""WITH {SEEDS} SELECT slug || '-' || category || '-' || language AS id, category, language, CASE k WHEN 1 THEN title WHEN 2 THEN alias WHEN 3 THEN heading WHEN 4 THEN meaning WHEN 5 THEN second_meaning WHEN 6 THEN mixed ELSE ambiguous END AS anchor_text,
    'evaluation/' || slug || '.md' || CASE WHEN k = 7 THEN ' evaluation/' || following || '.md' ELSE '' END AS relevant, CASE WHEN k <= 3 THEN 'evaluation/' || slug || '.md' END AS exact_target FROM ring, kinds"""
)
def evaluation_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fixtures(_seeds(spark, sf_dir)).select("id", "category", "language", "anchor_text", F.array_join("relevant", " ").alias("relevant"), "exact_target")


@query(f"WITH {SEEDS} SELECT 'passage: ' || title || chr(10) || heading || chr(10) || body || chr(10) || second_body AS passage, 'query: ' || meaning AS query FROM seed")
def evaluation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _seeds(spark, sf_dir)
    notes = evaluation.documents(seeds)
    passages = notes.select("path", evaluation.passage_text(notes).alias("passage"))
    asked = evaluation.fixtures(seeds).where("category = 'semantic-only' and language = 'en'")
    return asked.select(F.get("relevant", F.lit(0)).alias("path"), evaluation.query_text(asked).alias("query")).join(passages, "path").select("passage", "query")


@query(
    f"""WITH {SEEDS}, f AS (SELECT *, 'evaluation/' || slug || '.md' AS own, 'evaluation/' || following || '.md' AS other FROM ring, kinds),
    r AS (SELECT f.*, x.path, x.rank FROM f, (SELECT 'evaluation/' || slug || '.md' AS path, row_number() OVER (ORDER BY slug) AS rank FROM seed QUALIFY rank <= 10) x),
    c AS (SELECT slug, category, language, k, own, max(CASE WHEN rank = 1 THEN path END) AS top, CASE WHEN k = 7 THEN 2 ELSE 1 END AS n, count(*) FILTER (rank <= 5 AND (path = own OR k = 7 AND path = other)) AS h5, count(*) FILTER (rank <= 10 AND (path = own OR k = 7 AND path = other)) AS h10,
          coalesce(1.0 / min(rank) FILTER (rank <= 5 AND (path = own OR k = 7 AND path = other)), 0.0) AS rr, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5 AND (path = own OR k = 7 AND path = other)), 0.0) / (CASE WHEN k = 7 THEN 1 + 1 / log2(3) ELSE 1 END) AS ndcg FROM r GROUP BY slug, category, language, k, own)
    SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(language) = 0 THEN 'language' ELSE 'total' END AS scope, coalesce(category, language, '') AS name, count(*) AS cases, floor(avg(h5 / n) * 10000 + 0.5) / 10000 AS recall_5, floor(avg(h10 / n) * 10000 + 0.5) / 10000 AS recall_10,
    floor(avg(rr) * 10000 + 0.5) / 10000 AS mrr_5, floor(avg(ndcg) * 10000 + 0.5) / 10000 AS ndcg_5, floor(coalesce(count(*) FILTER (k <= 3 AND top = own) / nullif(count(*) FILTER (k <= 3), 0), 1.0) * 10000 + 0.5) / 10000 AS exact_rate,
    floor(coalesce(count(*) FILTER (k IN (4, 5) AND h5 > 0) / nullif(count(*) FILTER (k IN (4, 5)), 0), 1.0) * 10000 + 0.5) / 10000 AS semantic_rate, floor(sum(5 - h5) / sum(5) * 10000 + 0.5) / 10000 AS irrelevant_rate FROM c GROUP BY GROUPING SETS ((), (category), (language))"""
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fixture gets the same ranking, the first ten documents by name, so that all rates differ from 0 and 1."""
    seeds = _seeds(spark, sf_dir)
    rows = evaluation.fixtures(seeds)
    first = evaluation.documents(seeds).select("path").orderBy("path").limit(10)
    ranked = incremental.dense_rows(first, ["path"], "rank", 1).select(F.col("path").alias("target"), (F.col("rank") + 1).alias("rank"))
    ranking = rows.select(F.col("id").alias("case_id")).crossJoin(F.broadcast(ranked))
    cases = rows.select(F.col("id").alias("case_id"), "category", "language", "exact_target")
    return relevance.report(relevance.case_metrics(cases, ranking, evaluation.relevant_targets(rows)), ["category", "language"])


@query()
def evaluation_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical search on the evaluation corpus; tests hold its exact cases."""
    seeds = _seeds(spark, sf_dir)
    rows = evaluation.fixtures(seeds)
    numbered = rows.withColumn("query_id", F.xxhash64("id"))
    asked = numbered.select("query_id", "anchor_text", "context_text", F.lit("evaluation/source.md").alias("source_path"), F.lit(10).alias("limit"), F.lit(0.45).alias("minimum_score"))
    found = lexical.search(evaluation.documents(seeds), asked)
    ranking = found.join(numbered.select("query_id", F.col("id").alias("case_id")), "query_id").select("case_id", F.col("target_path").alias("target"), "rank")
    cases = rows.select(F.col("id").alias("case_id"), "category", "language", "exact_target")
    return relevance.report(relevance.case_metrics(cases, ranking, evaluation.relevant_targets(rows)), ["category", "language"])


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_name), c_name) - 1 AS row FROM customer")
def collated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of the collation, which for these letters and digits is that of lower case; equal names by key, none last."""
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", F.collate("c_name", "UNICODE").alias("k"), "c_name")
    return incremental.dense_rows(c, [F.col("k").asc_nulls_last(), "c_name", "c_custkey"]).select("c_custkey", "row")
