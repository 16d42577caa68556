"""Queries of scans, scope, change detection, journal, snapshots and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.functions import hashing
from linkrank.functions import text as T
from linkrank.operators import chunker, incremental
from linkrank.plans.catalogue import query
from linkrank.plans.retrieval import NOTES
from linkrank.sources import tables


@query(f"WITH {NOTES} SELECT path, title, array_to_string(list_sort(list_distinct(tags)), ',') AS tags, array_to_string(headings, '|') AS headings, alias AS aliases FROM notes")
def note_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.notes(spark, sf_dir)
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, T.collapse), lambda x: x != ""))
    return n.select("path", "title", F.array_join(F.array_sort(clean(F.col("tags"))), ",").alias("tags"), F.array_join("headings", "|").alias("headings"), F.array_join(clean(F.col("aliases")), ",").alias("aliases"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), ' ') AS links, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS INT) AS n FROM pages")
def outgoing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
    return tables.read(spark, sf_dir, "pages").select("page_id", links.alias("l")).select("page_id", F.array_join("l", " ").alias("links"), F.size("l").alias("n"))


@query(f"WITH {NOTES} SELECT path, lower(path) = 'src0/0.md' OR starts_with(lower(path), 'src1/') OR starts_with(lower(path), 'src2/') OR list_contains(tags, 'fr') AS excluded FROM notes")
def excluded_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.notes(spark, sf_dir)
    return n.select("path", incremental.excluded(n, ["/src0\\0.md"], ["src1", "SRC2/", ""], ["#FR"]).alias("excluded"))


@query(f"WITH {NOTES} SELECT path FROM notes WHERE contains(lower(path), 'src1')")
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.notes(spark, sf_dir).select("path").where(F.contains(F.lower("path"), F.lit("SRC1".lower())))


@query(
    f"""WITH {NOTES}, l AS (SELECT path, 'src' || split_part(substr(path, 4), '/', 1) || '/' || doc_id AS target, headings[1] AS h, title FROM notes)
    SELECT path, '[[' || target || CASE WHEN h IS NULL THEN '' ELSE '#' || h END || CASE WHEN title = '' THEN '' ELSE '|' || title END || ']]' AS link FROM l"""
)
def render_wikilink(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.notes(spark, sf_dir)
    return n.select("path", T.wikilink(F.regexp_replace("path", "\\.md$", ""), F.get("headings", F.lit(0)), F.col("title")).alias("link"))


GENERATIONS = """o AS (SELECT doc_id, doc_id AS modified_at, md5(text) AS content_hash FROM documents WHERE coalesce(source, '') <> 'src1'),
n AS (SELECT doc_id, doc_id + CASE WHEN lang IN ('de', 'es') THEN 1 ELSE 0 END AS modified_at, md5(text || CASE WHEN lang = 'de' THEN 'x' ELSE '' END) AS content_hash FROM documents WHERE coalesce(source, '') <> 'src2')"""


def _generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old and a new state of the documents: a source has gone, another come; a language was touched, another changed."""
    d = tables.read(spark, sf_dir, "documents").withColumn("of", F.coalesce("source", F.lit("")))
    old = d.where("of <> 'src1'").select("doc_id", F.col("doc_id").alias("modified_at"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    touched, changed = F.col("lang").isin("de", "es"), F.col("lang") == "de"
    new = d.where("of <> 'src2'").select("doc_id", (F.col("doc_id") + F.when(touched, 1).otherwise(0)).alias("modified_at"), F.md5(F.concat("text", F.when(changed, "x").otherwise("")).cast("binary")).alias("content_hash"))
    return old, new


@query(f"WITH {GENERATIONS} SELECT doc_id FROM o ANTI JOIN n USING (doc_id)")
def reconcile_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.deleted(*_generations(spark, sf_dir), key="doc_id").select("doc_id")


@query(f"WITH {GENERATIONS} SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.modified_at = n.modified_at THEN 'unchanged' WHEN o.content_hash = n.content_hash THEN 'reusable' ELSE 'changed' END AS change FROM n LEFT JOIN o USING (doc_id)")
def reconcile_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(*_generations(spark, sf_dir), key="doc_id")


@query("SELECT doc_id, CAST(len(list_filter(list_distinct(string_split(text, chr(10))), lambda l: NOT list_contains(string_split(replace(text, 'the', 'THE'), chr(10)), l))) AS INT) AS removed FROM documents")
def removed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda c: F.split(c, "\n")
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.size(F.array_except(lines(F.col("text")), lines(F.replace("text", F.lit("the"), F.lit("THE"))))).alias("removed"))


@query("SELECT doc_id FROM documents ANTI JOIN embeddings ON doc_id = vec_id")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return tables.read(spark, sf_dir, "documents").join(v, "doc_id", "left_anti").select("doc_id")


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS row FROM embeddings")
def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id")
    return incremental.dense_rows(v, [F.col("vec_id").desc_nulls_last()]).select("vec_id", "row")


STATES = """p AS (SELECT vec_id AS row, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END AS document, embedding AS vector FROM embeddings WHERE vec_id % 11 <> 0),
n AS (SELECT vec_id AS row, CASE WHEN vec_id % 4 = 0 THEN -1 WHEN vec_id % 6 = 1 THEN label + 1 ELSE label END AS document, embedding AS vector FROM embeddings)"""
DIFF = f"""{STATES}, d AS (SELECT coalesce(a.row, b.row) AS row, CASE WHEN b.row IS NULL THEN 'remove' WHEN a.row IS NULL OR a.document <> b.document OR a.vector <> b.vector THEN 'upsert' END AS op, b.document
FROM (SELECT * FROM p WHERE document >= 0) a FULL JOIN (SELECT * FROM n WHERE document >= 0) b ON a.row = b.row)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "label", F.col("embedding").alias("vector"))
    row = F.col("row")
    before = e.where(row % 11 != 0).select("row", F.when(row % 9 == 0, -1).otherwise(F.col("label")).alias("document"), "vector")
    after = e.select("row", F.when(row % 4 == 0, -1).when(row % 6 == 1, F.col("label") + 1).otherwise(F.col("label")).alias("document"), "vector")
    return before, after


@query(f"WITH {DIFF} SELECT row, op, document FROM d WHERE op IS NOT NULL")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.snapshot_diff(*_states(spark, sf_dir)).select("row", "op", "document")


@query(f"WITH {STATES} SELECT row, document FROM n WHERE document >= 0")
def snapshot_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _states(spark, sf_dir)
    return incremental.snapshot_patch(before, incremental.snapshot_diff(before, after)).select("row", "document")


@query(
    """WITH base AS (SELECT c_custkey AS path, c_acctbal AS value FROM customer), l AS (SELECT user_id AS path, event_id, event_type <> 'error' AS up, value FROM events), last AS (SELECT path, arg_max(up, event_id) AS up, arg_max(value, event_id) AS value FROM l GROUP BY path)
    SELECT path, CAST(value AS DOUBLE) AS value FROM base ANTI JOIN last USING (path) UNION ALL SELECT path, value FROM last WHERE up"""
)
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_acctbal").cast("double").alias("value"))
    log = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("sequence"), F.when(F.col("event_type") != "error", "upsert").otherwise("remove").alias("op"), "value")
    return incremental.replay(base, log)


@query("SELECT event_id + 1 AS sequence FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE value > 30 AND event_type = 'error')")
def journal_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("sequence"), (~((F.col("value") > 30) & (F.col("event_type") == "error"))).alias("valid"))
    return incremental.valid_prefix(log).select("sequence")


@query(
    """WITH c AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_quantity AS q FROM lineitem)
    SELECT 'repeated document id' AS "check", 0 AS n UNION ALL SELECT 'repeated path', 0 UNION ALL SELECT 'repeated chunk id', (SELECT count(*) FROM (SELECT o, n FROM c GROUP BY o, n HAVING count(*) > 1))
    UNION ALL SELECT 'bad range', (SELECT count(*) FROM c WHERE q > 48) UNION ALL SELECT 'vector row used twice', (SELECT count(*) FROM (SELECT p FROM c GROUP BY p HAVING count(*) > 1)) UNION ALL SELECT 'wrong dimensions', (SELECT count(*) FROM c WHERE n = 7)
    UNION ALL SELECT 'not finite', 0 UNION ALL SELECT 'chunk without document', (SELECT count(*) FROM c WHERE o NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'named chunk is missing', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o FROM c WHERE n = 1))
    UNION ALL SELECT 'chunk not named by its document', (SELECT count(*) FROM c WHERE n > 1 OR o NOT IN (SELECT o_orderkey FROM orders))"""
)
def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as documents that name their first line, lineitem as chunks with deliberately doubtful fields."""
    name = lambda order, line: F.concat_ws("-", F.col(order).cast("string"), line)
    docs = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("path"), F.array(name("o_orderkey", F.lit("1"))).alias("chunk_ids"))
    c = tables.read(spark, sf_dir, "lineitem")
    dims = F.when(F.col("l_linenumber") == 7, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    chunks = c.select(name("l_orderkey", F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("document_id"), F.lit(0).alias("start_offset"), F.when(F.col("l_quantity") > 48, -1).otherwise(5).alias("end_offset"), F.col("l_partkey").alias("vector_row"), dims.alias("vector"))
    return incremental.violations(docs, chunks, 2)


def _lane_sql(x: str, seed: int, by: int) -> str:
    return f"list_reduce(list_prepend(CAST({seed} AS HUGEINT), list_transform(range(1, length({x}) + 1), lambda i: CAST(unicode(substr({x}, i, 1)) AS HUGEINT))), lambda h, u: (xor(h, u) * {by}) % 4294967296)"


@query(
    f"""WITH {NOTES}, h AS (SELECT path, {_lane_sql('lower(path)', *hashing.LANE_1)} AS a, {_lane_sql('lower(path)', *hashing.LANE_2)} AS b FROM notes)
    SELECT path, 'document-' || lpad(lower(to_hex(CAST(a AS BIGINT))), 8, '0') || lpad(lower(to_hex(CAST(b AS BIGINT))), 8, '0') AS document_id, lower(to_base(CAST(a AS BIGINT), 36)) AS context_hash FROM h"""
)
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.notes(spark, sf_dir).select("path", hashing.document_id(F.col("path")).alias("document_id"), hashing.context_hash(F.lower("path")).alias("context_hash"))


@query("SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes, md5(html) AS md5 FROM pages")
def file_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("html").cast("binary")
    return tables.read(spark, sf_dir, "pages").select("page_id", F.sha2(raw, 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"), F.md5(raw).alias("md5"))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of notes; no SQL can follow the fold, so tests hold it against known cases."""
    return chunker.chunk_notes(tables.notes(spark, sf_dir))


@query()
def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-around and back-references have no SQL counterpart; tests hold the rules against known cases."""
    return tables.read(spark, sf_dir, "documents").select("doc_id", T.strip_markdown(F.coalesce("text", F.lit(""))).alias("text"))
