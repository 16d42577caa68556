"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import bpe, decontaminate, html_extract, language_id, line_frequency, mil_quality, near_dedup, pseudonyms, sharding, token_counts
from linkrank.llm.common import keyed_modulo, read_table

#: Shards that op9 fills.
SHARDS = 8


#: Key of op4's permutations; a real run is given a secret one.
PII_KEY = "change-me"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(language_id.training_rows(docs)))
    return found.select("doc_id", F.coalesce(keyed_modulo("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_frequency.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pseudonyms.pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), PII_KEY, found="n_found")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(read_table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_components(read_table(spark, sf_dir, "documents"))


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = mil_quality.score_documents(docs, mil_quality.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(keyed_modulo("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= mil_quality.THRESHOLD).cast("int").alias("predicted"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.train(pages))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(read_table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_line_frequency, op3_bpe, op4_pseudonyms, op5_token_counts, op6_near_dedup, op7_attention_quality, op8_html_extraction, op9_sharding, op10_decontamination)}


#: Words of op10 as a list, for a text column.
_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = rf"""
WITH dw AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS ws FROM documents),
     iw AS (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
     win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[p:p + 9], ' ') AS w
             FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS p FROM iw WHERE len(ws) > 0)),
     ks AS (SELECT DISTINCT k FROM win),
     occ AS (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS w
             FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM dw, ks WHERE len(ws) >= k)),
     hit AS (SELECT occ.doc_id, occ.p, occ.k, win.item_id FROM occ JOIN win ON occ.k = win.k AND occ.w = win.w),
     hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM hit) GROUP BY doc_id),
     hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
     raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
     keyed AS (SELECT *, length(k) AS chars FROM (SELECT doc_id, source, t, line, regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g') AS k FROM raw)),
     freq AS (SELECT source, k, min(doc_id) AS f FROM keyed WHERE k <> '' GROUP BY source, k HAVING count(DISTINCT t) >= 10),
     gone AS (SELECT doc_id, sum(chars) AS w, sum(CASE WHEN f = doc_id THEN chars ELSE 0 END) AS o
              FROM keyed JOIN freq ON keyed.source IS NOT DISTINCT FROM freq.source AND keyed.k = freq.k GROUP BY doc_id),
     ws AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
     win AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], chr(10)) AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS p FROM ws WHERE len(ws) >= 8)),
     rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
     nrep AS (SELECT doc_id, count(DISTINCT q) AS r FROM (SELECT doc_id, unnest(generate_series(p, p + 7)) AS q FROM rep) GROUP BY doc_id),
     lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
     base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                     CAST(length(array_to_string(ws, '')) - length(regexp_replace(array_to_string(ws, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(w, 0) AS BIGINT) AS removed_chars, coalesce(o, 0) AS own
              FROM ws LEFT JOIN lines USING (doc_id) LEFT JOIN nrep USING (doc_id) LEFT JOIN gone USING (doc_id)),
     failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT * EXCLUDE (own), NOT base_failed AND NOT (removed_chars > 0 AND own * 100 < removed_chars * 50 AND (word_chars - removed_chars < 50 OR (word_chars - removed_chars) * 100 < word_chars * 30)) AS kept FROM failed
"""


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[p:p + 4], ' ')) AS h
           FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS p FROM d WHERE len(ws) > 0)),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
     link AS MATERIALIZED (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
     reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
     comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id
"""


def _crc_table() -> str:
    """The 256 steps of crc32 for one byte, from its polynomial."""
    steps = range(256)
    for _ in range(8):
        steps = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in steps]
    return f"[{', '.join(map(str, steps))}]"


OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, coalesce('=' || source, '') AS stratum, md5(concat_ws('|', '{sharding.SEED}', CAST(doc_id AS VARCHAR))) AS key FROM documents),
     c AS (SELECT *, CAST(strlen(t) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                  lambda r, x: xor(r >> 8, CAST({_crc_table()}[(xor(r, x) & 255) + 1] AS BIGINT))), 4294967295) AS text_crc32 FROM d),
     r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) AS rank, count(*) OVER (PARTITION BY stratum) AS total,
                  (CAST(CAST('0x' || substr(md5('{sharding.SEED}|source|' || stratum), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS u FROM c),
     p AS (SELECT *, row_number() OVER (ORDER BY (rank - u) / total, stratum, rank) - 1 AS place, count(*) OVER () AS n FROM r),
     s AS (SELECT *, (place * {SHARDS} + {SHARDS - 1}) // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(place - (shard * n) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_dedup": OP6_SQL, "op9_sharding": OP9_SQL, "op2_line_frequency": OP2_SQL, "op10_decontamination": OP10_SQL}
