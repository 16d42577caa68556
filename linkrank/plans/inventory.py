"""Queries of smaller operators: status, gates, segments, offsets, occurrences, ordinals, posting maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkrank.functions import text as T
from linkrank.operators import incremental, lexical
from linkrank.plans.catalogue import query
from linkrank.plans.retrieval import ASKED, LABELS, NOTES, flat, meaningful, tok
from linkrank.sources import tables


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents ANTI JOIN embeddings ON doc_id = vec_id) AS queued, (SELECT count(*) * max(len(embedding)) * 4 FROM embeddings) AS live_bytes")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, v = tables.read(spark, sf_dir, "documents").select("doc_id"), tables.read(spark, sf_dir, "embeddings")
    both = d.join(v.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")), "doc_id", "left").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).alias("queued"))
    stats = v.agg(F.count("*").alias("vectors"), (F.count("*") * F.max(F.size("embedding")) * 4).alias("live_bytes"))
    return both.crossJoin(F.broadcast(stats)).select("documents", "vectors", "queued", "live_bytes")


@query(f"SELECT conv_id, turn, length({flat('text')}) >= 24 OR len({meaningful('text', 24)}) >= 5 AS semantic FROM conversations")
def semantic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ((F.char_length(T.collapse(F.col("text"))) >= 24) | (F.size(T.meaningful_tokens(F.col("text"))) >= 5)).alias("semantic"))


@query(f"WITH {NOTES}, {ASKED}, {LABELS} SELECT query_id, anchor IN (SELECT norm FROM labels WHERE field <> 'heading') OR len({meaningful('anchor', 24)}) > 0 AS eligible FROM q")
def anchor_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.note_queries(spark, sf_dir)
    exact = lexical.exact_labels(tables.notes(spark, sf_dir), asked).distinct().withColumn("exact", F.lit(True))
    return lexical.live_queries(asked).join(exact, "query_id", "left").select("query_id", (F.col("exact").isNotNull() | (F.size(T.meaningful_tokens(F.col("anchor_text"))) > 0)).alias("eligible"))


SEGMENTS = r"regexp_extract_all(text, '[^.!?؟。！\n]+(?:[.!?؟。！]+|\n+|$)')"


@query(f"SELECT doc_id, CAST(len({SEGMENTS}) AS INT) AS segments, CAST(list_max(list_transform(list_concat([''], {SEGMENTS}), lambda s: length(s))) AS INT) AS longest, CAST(length(text) - length(replace(text, chr(10), '')) AS INT) AS newlines FROM documents")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select("doc_id", "text", T.sentence_segments(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("segments"), F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0)).alias("longest"), (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("newlines"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents)
    SELECT doc_id, number, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY number) - length(line) - 1 AS BIGINT) AS start FROM l"""
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of a document begins."""
    lines = tables.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    size = F.char_length("line").cast("long") + 1
    upto = F.sum(size).over(Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("number"), (upto - size).alias("start"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents)
    SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id, line ORDER BY number) - 1 AS occurrence FROM l"""
)
def chunk_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("line"), "line").orderBy("p"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("number"), (nth - 1).cast("long").alias("occurrence"))


@query("SELECT vec_id, label, CAST(dense_rank() OVER (ORDER BY f, label) - 1 AS INT) AS document FROM embeddings JOIN (SELECT label, min(vec_id) AS f FROM embeddings GROUP BY label) USING (label)")
def search_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the ordinal of their document, in the order in which documents first occur."""
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", "label")
    first = v.groupBy("label").agg(F.min("vec_id").alias("f"))
    ordinal = incremental.dense_rows(first, ["f", "label"], "document")
    return v.join(ordinal.select("label", "document"), "label").select("vec_id", "label", F.col("document").cast("int").alias("document"))


@query(
    f"""WITH o AS (SELECT DISTINCT doc_id, unnest({tok('text')}) AS term FROM documents WHERE coalesce(lang, '') NOT IN ('fr', 'de')), n AS (SELECT DISTINCT doc_id, unnest({tok("replace(text, 'the', 'tho')")}) AS term FROM documents WHERE lang = 'de'),
    p AS (SELECT * FROM o UNION ALL SELECT * FROM n) SELECT term, count(*) AS df FROM p GROUP BY term"""
)
def posting_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all documents after those of one language have gone and those of another been written anew; a removed term keeps no row."""
    d = tables.read(spark, sf_dir, "documents")
    terms = lambda df, text: df.select("doc_id", F.explode_outer(F.array_distinct(T.tokens(text))).alias("term")).where("term is not null")
    gone, fresh = d.where("lang = 'fr'").select("doc_id"), d.where("lang = 'de'")
    old = terms(d, F.col("text")).join(gone.unionByName(fresh.select("doc_id")), "doc_id", "left_anti")
    return old.unionByName(terms(fresh, F.replace("text", F.lit("the"), F.lit("tho")))).groupBy("term").agg(F.count("*").alias("df"))
