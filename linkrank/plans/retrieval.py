"""Queries of the lexical index, vector search, fusion and relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkrank.functions import text as T
from linkrank.operators import hybrid, lexical, relevance, vectors
from linkrank.plans.catalogue import query
from linkrank.sources import tables


def tok(x: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}]+')"


def norm(x: str) -> str:
    return f"array_to_string({tok(x)}, ' ')"


def grams(x: str, w: str) -> str:
    p = f"(' ' || {x} || ' ')"
    return f"CASE WHEN length({p}) <= {w} THEN [{p}] ELSE list_transform(range(1, length({p}) - {w} + 2), lambda i: substr({p}, i, {w})) END"


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def meaningful(x: str, n: int) -> str:
    # distinct values in the order in which they occur
    kept = f"list_filter({tok(x)}, lambda t: length(t) >= 3 AND t NOT IN ({STOP}))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)[1:{n}]"


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


NOTES = f"""
notes AS MATERIALIZED (
  SELECT doc_id, path, title, n_title, own, alias, headings, tags, body, {tok('body')}[1:5000] AS bt FROM (
    SELECT doc_id, source || '/' || doc_id || '.md' AS path, title, CASE WHEN title = '' THEN CAST(doc_id AS VARCHAR) ELSE title END AS n_title, {tok('title')} AS own,
           lang || ' ' || doc_id AS alias, headings, [lang, source] AS tags, text AS body
    FROM (SELECT *, array_to_string({tok("string_split(text, chr(10))[1]")}[1:4], ' ') AS title,
                 list_filter(list_transform(string_split(text, chr(10))[2:6], lambda l: array_to_string({tok('l')}[1:3], ' ')), lambda h: h <> '') AS headings
          FROM documents)))"""
ASKED = f"""
q AS MATERIALIZED (
  SELECT query_id, anchor, source_path, {distinct(tok('anchor'))} AS a, list_filter({meaningful('context', 16)}, lambda t: NOT list_contains({tok('anchor')}, t)) AS c
  FROM (SELECT doc_id AS query_id, source || '/' || doc_id || '.md' AS source_path, string_split(text, chr(10))[1] AS context,
               array_to_string({tok("string_split(text, chr(10))[1]")}[1:2], ' ') AS anchor FROM documents WHERE doc_id % 100 = 0) WHERE anchor <> ''),
terms AS (SELECT query_id, unnest(a) AS term, 2 AS weight FROM q UNION ALL SELECT query_id, unnest(c), 1 FROM q)"""
POSTINGS = f"""
flat AS (SELECT path, unnest(bt) AS term, 1 AS n FROM notes
         UNION ALL SELECT path, unnest(list_distinct(list_concat(own, {tok('alias')}, flatten(list_transform(headings, lambda h: {tok('h')})), flatten(list_transform(tags, lambda t: {tok('t')}))))), 0 FROM notes),
post AS MATERIALIZED (SELECT term, path, sum(n) AS tf FROM flat SEMI JOIN terms USING (term) GROUP BY term, path),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
BODY = """
weighed AS (SELECT terms.*, weight * (0.5 + coalesce(1.0 / sqrt(df), 1.0)) AS w FROM terms LEFT JOIN df USING (term)),
total AS (SELECT query_id, sum(w) AS total FROM weighed GROUP BY query_id),
met AS (SELECT query_id, path, sum(CASE WHEN tf > 0 THEN w * (1 + least(0.2, ln(1 + tf) * 0.06)) ELSE 0 END) AS matched, count(*) FILTER (tf > 0) AS n, count(*) FILTER (tf > 0 AND weight = 2) AS anchors
        FROM post JOIN weighed USING (term) GROUP BY query_id, path),
body AS MATERIALIZED (SELECT query_id, path, CASE WHEN n = 0 OR (anchors = 0 AND n < 2) THEN 0.0 ELSE 0.48 + least(0.25, 0.28 * matched / total) END AS body_score FROM met JOIN total USING (query_id))"""
LABELS = f"""
labels AS MATERIALIZED (SELECT path, 'title' AS field, 0 AS pos, n_title AS text, n_title AS norm FROM notes UNION ALL SELECT path, 'alias', 0, {norm('alias')}, {norm('alias')} FROM notes
          UNION ALL SELECT path, 'heading', unnest(range(len(headings))), unnest(headings), unnest(headings) FROM notes)"""
GRAM_CANDIDATES = f"""
ag AS (SELECT query_id, len(gs) AS n, unnest(gs) AS gram FROM (SELECT query_id, {grams('anchor', '(CASE WHEN length(anchor) < 5 THEN 2 ELSE 3 END)')} AS gs FROM q)),
lg AS (SELECT DISTINCT path, gram FROM (SELECT path, unnest({grams('norm', '(CASE WHEN length(norm) < 5 THEN 2 ELSE 3 END)')}) AS gram FROM labels WHERE norm <> '')),
gc AS (SELECT query_id, path FROM ag JOIN lg USING (gram) GROUP BY query_id, path, n HAVING count(*) >= greatest(1, floor(n * 0.25)))"""
SIMS = f"""
x AS (SELECT query_id, anchor, w, len(gs) AS s, unnest(gs) AS gram FROM (SELECT query_id, anchor, w, {grams('anchor', 'w')} AS gs FROM q, (VALUES (2), (3)) ws(w))),
y AS (SELECT norm, w, len(gs) AS s, unnest(gs) AS gram FROM (SELECT norm, w, {grams('norm', 'w')} AS gs FROM (SELECT DISTINCT norm FROM labels WHERE norm <> ''), (VALUES (2), (3)) ws(w))),
xc AS (SELECT query_id, anchor, w, s, gram, count(*) AS c FROM x GROUP BY ALL), yc AS (SELECT norm, w, s, gram, count(*) AS c FROM y GROUP BY ALL),
sims AS MATERIALIZED (SELECT query_id, norm, CASE WHEN anchor = norm THEN 1.0 ELSE 2.0 * sum(least(xc.c, yc.c)) / (xc.s + yc.s) END AS sim FROM xc JOIN yc USING (w, gram)
         WHERE w = CASE WHEN least(length(anchor), length(norm)) < 5 THEN 2 ELSE 3 END GROUP BY query_id, anchor, norm, xc.s, yc.s)"""
SEARCH = f"""
best AS (SELECT query_id, path, max(sim) FILTER (field = 'title') AS ts, max(sim) FILTER (field = 'alias') AS als, max(sim) FILTER (field = 'heading') AS hs, arg_max(text, sim * 1000000 - pos) FILTER (field = 'heading') AS ht
         FROM labels JOIN sims USING (norm) GROUP BY query_id, path),
pairs AS (SELECT query_id, path FROM body UNION SELECT query_id, path FROM gc UNION SELECT query_id, path FROM labels JOIN q ON norm = anchor WHERE field <> 'heading'),
f AS (SELECT *, {norm('alias')} AS n_alias, list_transform(tags, lambda t: {norm('t')}) AS n_tags,
             {distinct(tok('n_title'))} AS tt, {tok('alias')} AS atk, flatten(list_transform(tags, lambda t: {tok('t')})) AS gt FROM notes),
cov AS (SELECT *, len(list_filter(a, lambda t: list_contains(tt, t))) / greatest(len(a), 1) AS ct, len(list_filter(a, lambda t: list_contains(atk, t))) / greatest(len(a), 1) AS ca, len(list_filter(a, lambda t: list_contains(gt, t))) / greatest(len(a), 1) AS cg
        FROM pairs JOIN q USING (query_id) JOIN f USING (path) LEFT JOIN best USING (query_id, path) LEFT JOIN body USING (query_id, path) WHERE path <> source_path),
sig AS (SELECT *, CASE WHEN n_title = anchor THEN 1.0 ELSE 0 END AS s1, CASE WHEN n_alias = anchor THEN 0.99 ELSE 0 END AS s2, CASE WHEN list_contains(headings, anchor) THEN 0.96 ELSE 0 END AS s3,
               CASE WHEN list_contains(n_tags, anchor) THEN 0.82 ELSE 0 END AS s4, CASE WHEN length(anchor) >= 3 AND starts_with(n_title, anchor) THEN 0.91 ELSE 0 END AS s5,
               CASE WHEN length(anchor) >= 3 AND starts_with(n_alias, anchor) THEN 0.90 ELSE 0 END AS s6, CASE WHEN ts >= 0.55 THEN 0.56 + 0.34 * ts ELSE 0 END AS s7, CASE WHEN als >= 0.55 THEN 0.55 + 0.34 * als ELSE 0 END AS s8,
               CASE WHEN hs >= 0.58 THEN 0.54 + 0.34 * hs ELSE 0 END AS s9, CASE WHEN ct > 0 THEN 0.58 + 0.25 * ct ELSE 0 END AS s10, CASE WHEN ca > 0 THEN 0.57 + 0.24 * ca ELSE 0 END AS s11,
               CASE WHEN cg > 0 THEN 0.56 + 0.24 * cg ELSE 0 END AS s12, coalesce(body_score, 0) AS s13 FROM cov),
scored AS (SELECT *, least(1.0, floor(greatest(s1, s2, s3, s4, s5, s6, s7, s8, s9, s10, s11, s12, s13) * 1000 + 0.5) / 1000) AS score,
                  CASE WHEN s1 > 0 THEN 5 WHEN s2 > 0 THEN 4 WHEN s3 > 0 THEN 3 WHEN s4 > 0 THEN 2 ELSE 0 END AS exact_rank,
                  CASE WHEN s9 > 0 AND s9 >= greatest(s1, s2, s3, s4, s5, s6, s7, s8) - 0.03 THEN ht WHEN s3 > 0 THEN anchor END AS target_heading,
                  array_to_string(list_filter([CASE WHEN greatest(s1, s5, s7, s10) > 0 THEN 'title' END, CASE WHEN greatest(s2, s6, s8, s11) > 0 THEN 'alias' END, CASE WHEN greatest(s3, s9) > 0 THEN 'heading' END, CASE WHEN greatest(s4, s12) > 0 THEN 'tag' END, CASE WHEN s13 > 0 THEN 'body' END], lambda k: k IS NOT NULL), ',') AS kinds FROM sig),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, exact_rank DESC, n_title, path) AS rank FROM scored WHERE score >= 0.5),
lex AS (SELECT * FROM ranked WHERE rank <= 6)"""


def flat(body: str) -> str:
    return rf"trim(regexp_replace({body}, '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"


def preview_sql(body: str) -> str:
    return f"CASE WHEN {flat(body)} = '' THEN NULL WHEN length({flat(body)}) <= 180 THEN {flat(body)} ELSE rtrim(substr({flat(body)}, 1, 179)) || '…' END"


@query(f"WITH {NOTES} SELECT path, title, CAST(len(bt) AS BIGINT) AS n_tokens, CAST(len(list_distinct(bt)) AS BIGINT) AS n_terms FROM notes")
def lex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.slice(T.tokens(F.col("body")), 1, T.MAX_BODY_TOKENS)
    return tables.notes(spark, sf_dir).select("path", "title", body.alias("b")).select("path", "title", F.size("b").cast("long").alias("n_tokens"), F.size(F.array_distinct("b")).cast("long").alias("n_terms"))


@query(f"SELECT doc_id, array_to_string({meaningful('text', 24)}, ' ') AS terms FROM documents")
def lex_meaningful_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.meaningful_tokens(F.col("text")), " ").alias("terms"))


@query(f"WITH {NOTES}, t AS (SELECT path, unnest(bt) AS term FROM notes) SELECT path, term, count(*) AS tf FROM t GROUP BY path, term")
def lex_term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.body_terms(tables.notes(spark, sf_dir)).select("path", "term", "tf")


@query(f"WITH {NOTES}, {ASKED}, {POSTINGS.replace(' SEMI JOIN terms USING (term)', '')} SELECT term, df FROM df")
def lex_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(tables.notes(spark, sf_dir)))


@query(f"WITH {NOTES}, {LABELS} SELECT path, field, norm, array_to_string(list_sort(list_distinct({grams('norm', '(CASE WHEN length(norm) < 5 THEN 2 ELSE 3 END)')})), '|') AS grams FROM labels WHERE norm <> ''")
def lex_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lexical.labels_of(lexical.index_notes(tables.notes(spark, sf_dir)))
    return labels.where("norm <> ''").select("path", "field", "norm", F.array_join(F.array_sort(F.array_distinct(T.own_ngrams(F.col("norm")))), "|").alias("grams"))


@query(f"WITH {NOTES}, {ASKED}, {POSTINGS} SELECT DISTINCT query_id, path FROM post JOIN terms USING (term)")
def lex_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_pairs(tables.notes(spark, sf_dir), lexical.live_queries(tables.note_queries(spark, sf_dir)), scored=False).select("query_id", "path")


@query(f"WITH {NOTES}, {ASKED}, {LABELS} SELECT query_id FROM q WHERE anchor IN (SELECT norm FROM labels WHERE field <> 'heading')")
def lex_label_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.exact_labels(tables.notes(spark, sf_dir), tables.note_queries(spark, sf_dir))


@query(f"WITH {NOTES}, {ASKED}, {LABELS}, {GRAM_CANDIDATES} SELECT query_id, path FROM gc")
def lex_gram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lexical.labels_of(lexical.index_notes(tables.notes(spark, sf_dir)))
    return lexical.gram_candidates(labels, lexical.live_queries(tables.note_queries(spark, sf_dir)))


@query(f"WITH {NOTES}, {ASKED}, {LABELS}, {SIMS} SELECT query_id, norm, floor(sim * 1000000 + 0.5) / 1000000 AS sim FROM sims")
def lex_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lexical.labels_of(lexical.index_notes(tables.notes(spark, sf_dir)))
    return lexical.label_similarity(labels, lexical.live_queries(tables.note_queries(spark, sf_dir))).withColumn("sim", T.round_half_up(F.col("sim"), 6))


@query(f"WITH {NOTES}, {ASKED}, {POSTINGS}, {BODY} SELECT query_id, path, floor(body_score * 1000000 + 0.5) / 1000000 AS body_score FROM body")
def lex_body_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.term_pairs(tables.notes(spark, sf_dir), lexical.live_queries(tables.note_queries(spark, sf_dir)))
    return found.select("query_id", "path", T.round_half_up(F.col("body_score"), 6).alias("body_score"))


LEXICAL = f"WITH {NOTES}, {ASKED}, {POSTINGS}, {BODY}, {LABELS}, {GRAM_CANDIDATES}, {SIMS}, {SEARCH}"


@query(f"{LEXICAL} SELECT query_id, CAST(rank AS INT) AS rank, path AS target_path, n_title AS target_title, target_heading, score, kinds AS match_kinds, coalesce('Heading: ' || target_heading, {preview_sql('body')}) AS preview FROM lex")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(tables.notes(spark, sf_dir), tables.note_queries(spark, sf_dir))
    return found.withColumn("match_kinds", F.array_join("match_kinds", ","))


VECTOR_HITS = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
hits AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label, floor(list_dot_product(a.e, b.e) * 1000000000 + 0.5) / 1000000000 AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 40)"""
ROUNDED = "floor(score * 1000000 + 0.5) / 1000000 AS score"


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(tables.vectors(spark, sf_dir), tables.vector_queries(spark, sf_dir), exclude_self=True)


@query(f"WITH {VECTOR_HITS} SELECT query_id, chunk_id, {ROUNDED}, CAST(rank AS INT) AS rank FROM top")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).withColumn("score", T.round_half_up(F.col("score"), 6))


@query(
    f"""WITH {VECTOR_HITS}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM top QUALIFY n = 1)
    SELECT query_id, chunk_id, 'label-' || label AS document, {ROUNDED}, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'label-' || label) AS r FROM best) WHERE r <= 6"""
)
def vector_topk_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vectors.best_of_groups(_top(spark, sf_dir), tables.vectors(spark, sf_dir).select("chunk_id", "document"), ["document"])
    return best.select("query_id", "chunk_id", "document", T.round_half_up(F.col("score"), 6).alias("score"), "rank")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dimensions, floor(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 1000 + 0.5) / 1000 AS norm, true AS finite FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.size("embedding").alias("dimensions"), T.round_half_up(vectors.l2_norm(F.col("embedding")), 3).alias("norm"), vectors.finite(F.col("embedding")).alias("finite"))


@query(
    f"""{LEXICAL}, {VECTOR_HITS},
    sem AS (SELECT top.query_id, notes.path, n_title AS title, 1 - (row_number() OVER (PARTITION BY top.query_id ORDER BY rank) - 1) / greatest(count(*) OVER (PARTITION BY top.query_id) - 1, 1) AS r FROM top JOIN notes ON chunk_id = doc_id),
    fused AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.path, s.path) AS target_path, coalesce(l.n_title, s.title) AS target_title, l.target_heading,
              CASE WHEN r IS NULL THEN 0.75 * score WHEN score IS NULL THEN 0.7 * r ELSE least(1.0, 0.75 * score + 0.55 * r) END AS s, coalesce(kinds || CASE WHEN r IS NULL THEN '' ELSE ',semantic' END, 'semantic') AS match_kinds
              FROM lex l FULL JOIN sem s ON l.query_id = s.query_id AND l.path = s.path AND coalesce(l.target_heading, '') = '')
    SELECT query_id, target_path, target_title, target_heading, floor(s * 1000000 + 0.5) / 1000000 AS score, match_kinds, CAST(k AS INT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 1000000000 + 0.5) DESC, target_title, target_path, coalesce(target_heading, '')) AS k FROM fused) WHERE k <= 6"""
)
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = tables.notes(spark, sf_dir)
    found = lexical.search(notes, tables.note_queries(spark, sf_dir))
    passages = notes.select(F.col("doc_id").alias("chunk_id"), F.col("path").alias("target_path"), "title", "basename")
    semantic = _top(spark, sf_dir).join(passages, "chunk_id").select("query_id", "target_path", F.when(F.col("title") == "", F.col("basename")).otherwise(F.col("title")).alias("target_title"), F.lit(None).cast("string").alias("target_heading"), F.col("score").alias("similarity"), F.lit("").alias("preview"), "rank")
    return hybrid.fuse(found, semantic).select("query_id", "target_path", "target_title", "target_heading", T.round_half_up(F.col("score"), 6).alias("score"), F.array_join("match_kinds", ",").alias("match_kinds"), "rank")


@query(f"SELECT doc_id, {preview_sql('text')} AS preview FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, {flat('text')} AS f, {flat("coalesce(lag(text) OVER w, '')")} AS p, {flat("coalesce(lead(text) OVER w, '')")} AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN f = '' THEN '' ELSE 'Focus: ' || f END AS focus_only, 'Note: ' || role || CASE WHEN f = '' THEN '' ELSE chr(10) || 'Focus: ' || f END AS title_focus,
    'Note: ' || role || CASE WHEN p = '' THEN '' ELSE chr(10) || 'Previous: ' || p END || CASE WHEN f = '' THEN '' ELSE chr(10) || 'Focus: ' || f END || CASE WHEN n = '' THEN '' ELSE chr(10) || 'Next: ' || n END AS neighbours FROM c"""
)
def query_context_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("p"), F.lead("text").over(w).alias("n"))
    make = lambda v: T.query_context(v, F.col("role"), F.col("text"), F.col("p"), F.col("n"), F.col("text"), F.col("text"))
    return c.select("conv_id", "turn", make("focus-only").alias("focus_only"), make("title-focus").alias("title_focus"), make("title-focus-neighbours").alias("neighbours"))


@query(
    f"""WITH {VECTOR_HITS}, r AS (SELECT query_id, rank, label = q.l AS hit FROM top JOIN (SELECT vec_id, label AS l FROM embeddings) q ON q.vec_id = query_id),
    n AS (SELECT a.vec_id AS query_id, a.label, count(b.vec_id) AS relevant FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
    c AS (SELECT n.query_id, n.label, CASE WHEN relevant = 0 THEN 0.0 ELSE count(*) FILTER (hit AND rank <= 5) / relevant END AS r5, CASE WHEN relevant = 0 THEN 0.0 ELSE count(*) FILTER (hit AND rank <= 10) / relevant END AS r10,
                 coalesce(1.0 / min(rank) FILTER (hit AND rank <= 5), 0.0) AS rr, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 5), 0.0) AS dcg,
                 list_sum(list_transform(range(1, least(5, relevant) + 1), lambda i: 1 / log2(i + 1))) AS ideal, count(*) FILTER (NOT hit AND rank <= 5) AS wrong, count(*) FILTER (rank <= 5) AS shown
          FROM n LEFT JOIN r ON n.query_id = r.query_id GROUP BY n.query_id, n.label, relevant)
    SELECT CASE WHEN grouping(label) = 1 THEN 'total' ELSE 'label' END AS scope, CASE WHEN grouping(label) = 1 THEN '' ELSE CAST(label AS VARCHAR) END AS name, count(*) AS cases, floor(avg(r5) * 10000 + 0.5) / 10000 AS recall_5,
           floor(avg(r10) * 10000 + 0.5) / 10000 AS recall_10, floor(avg(rr) * 10000 + 0.5) / 10000 AS mrr_5, floor(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END) * 10000 + 0.5) / 10000 AS ndcg_5,
           floor(coalesce(sum(wrong) / nullif(sum(shown), 0), 0) * 10000 + 0.5) / 10000 AS irrelevant_rate FROM c GROUP BY GROUPING SETS ((), (label))"""
)
def relevance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("category"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("case_id"), "category")
    shown = _top(spark, sf_dir).select(F.col("query_id").alias("case_id"), "chunk_id", "rank")
    hits = shown.join(v.select(F.col("vec_id").alias("chunk_id"), F.col("category").alias("own")), "chunk_id").join(asked, "case_id")
    hits = hits.select("case_id", F.col("chunk_id").cast("string").alias("target"), "rank", (F.col("own") == F.col("category")).alias("relevant"))
    counts = asked.join(v.groupBy("category").agg((F.count("*") - 1).alias("relevant")), "category").select("case_id", "relevant")
    report = relevance.report(relevance.counted_metrics(asked, hits, counts), ["category"])
    return report.select(F.when(F.col("scope") == "category", "label").otherwise("total").alias("scope"), "name", "cases", "recall_5", "recall_10", "mrr_5", "ndcg_5", "irrelevant_rate")
