"""An evaluation corpus from seeds, and the evaluation of lexical, semantic and hybrid rankings on it.

A seed is a note in two languages with the ways in which it is asked for. It gives one document and seven fixtures: by
title, alias and heading, by meaning in both languages, in mixed language, and ambiguously, for which the next seed is
right as well (the last one's next is the first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a seed.
SEED = ("slug", "title", "alias", "second_title", "heading", "body", "second_body", "meaning", "second_meaning", "mixed", "ambiguous")
# Fixed values: (category, language, the seed's column that is asked, whether it is the context as well, whether the target must come first).
FIXTURES = (
    ("exact-title", "en", "title", False, True),
    ("alias", "en", "alias", False, True),
    ("heading", "en", "heading", False, True),
    ("semantic-only", "en", "meaning", True, False),
    ("semantic-only", "ar", "second_meaning", True, False),
    ("mixed-language", "mixed", "mixed", True, False),
    ("ambiguous", "en", "ambiguous", True, False),
)
FOLDER = "evaluation"
SEMANTIC_PREVIEW = 240


def _path(slug):
    return F.concat(F.lit(f"{FOLDER}/"), slug, F.lit(".md"))


def documents(seeds: DataFrame) -> DataFrame:
    """Notes (path, title, basename, aliases, headings, tags, body) of the seeds."""
    return seeds.select(_path(F.col("slug")).alias("path"), "title", F.col("title").alias("basename"), F.array("alias", "second_title").alias("aliases"), F.array("heading").alias("headings"), F.array().cast("array<string>").alias("tags"), F.concat("body", F.lit("\n"), "second_body").alias("body"))


def fixtures(seeds: DataFrame, order: str = "position") -> DataFrame:
    """(id, category, language, anchor_text, context_text, relevant, exact_target): seven rows for each seed.

    Seeds are a written list, so one window over them decides which is next.
    """
    every = Window.partitionBy(F.lit(0)).orderBy(order)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ringed = seeds.withColumn("following", F.coalesce(F.lead("slug").over(every), F.first("slug").over(whole)))
    made = [
        F.struct(
            F.concat_ws("-", "slug", F.lit(category), F.lit(language)).alias("id"), F.lit(category).alias("category"), F.lit(language).alias("language"), F.col(asked).alias("anchor_text"),
            (F.col(asked) if context else F.lit("")).alias("context_text"),
            (F.array(_path(F.col("slug")), _path(F.col("following"))) if category == "ambiguous" else F.array(_path(F.col("slug")))).alias("relevant"),
            F.when(F.lit(exact), _path(F.col("slug"))).alias("exact_target"),
        )
        for category, language, asked, context, exact in FIXTURES
    ]
    return ringed.select(F.explode(F.array(*made)).alias("f")).select("f.*")


def passage_text(notes: DataFrame):
    """What a model reads of a note: title, headings and body, one below the other; empty parts are left out."""
    return F.concat_ws("\n", F.concat(F.lit("passage: "), notes["title"]), F.nullif(F.array_join(notes["headings"], " > "), F.lit("")), F.nullif(notes["body"], F.lit("")))


def query_text(rows: DataFrame):
    """What a model reads of a fixture: its context, or its anchor if that is blank."""
    return F.concat(F.lit("query: "), F.coalesce(F.nullif(F.trim(rows["context_text"]), F.lit("")), rows["anchor_text"]))


def relevant_targets(rows: DataFrame) -> DataFrame:
    """(case_id, target, gain) of fixtures."""
    return rows.select(F.col("id").alias("case_id"), F.explode("relevant").alias("target"), F.lit(1.0).alias("gain"))
