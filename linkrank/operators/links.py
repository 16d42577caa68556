"""Links between notes: what a link text points at, and whether the heading that it names exists.

A link is resolved by equi-joins alone. Notes are first reduced to one row for each name, so that a name which a million
notes share joins as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrank.functions import text as T


def link_key(link: Column) -> Column:
    """The note's name in a link text: without alias, heading, outer slashes and extension, in lower case; null if nothing is left."""
    target = F.trim(F.regexp_replace(F.regexp_replace(link, "[|#].*$", ""), "\\\\", "/"))
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(target), "^/+|/+$", ""), "\\.md$", ""), F.lit(""))


def link_heading(link: Column) -> Column:
    """The heading in a link text, normalised; null if it names none."""
    return T.normalise_heading(F.nullif(F.regexp_extract(link, "#([^|]*)", 1), F.lit("")))


def _folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links`` (source_path, link, ...) with target_path, or null.

    A link that is a whole path, with or without extension, points at that note. Any other is a note's base name: the one in the
    folder of the source, else the least path of that name.
    """
    named = notes.select("path", link_key(F.col("path")).alias("key")).where("key is not null").groupBy("key").agg(F.min("path").alias("path"))
    asked = links.withColumn("__key", link_key(F.col("link"))).withColumn("__near", F.lower(_folder(F.col("source_path"))))
    whole = named.select(F.col("key").alias("__key"), F.col("path").alias("__whole"))
    near = named.groupBy(_base(F.col("key")).alias("__key"), _folder(F.col("key")).alias("__near")).agg(F.min("path").alias("__beside"))
    anywhere = named.groupBy(_base(F.col("key")).alias("__key")).agg(F.min("path").alias("__any"))
    found = asked.join(whole, "__key", "left").join(near, ["__key", "__near"], "left").join(anywhere, "__key", "left")
    return found.select(*links.columns, F.coalesce("__whole", "__beside", "__any").alias("target_path"))


def outgoing(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(source_path, targets): the distinct notes that each source points at, sorted."""
    return resolve(links, notes).where("target_path is not null").groupBy("source_path").agg(F.array_sort(F.collect_set("target_path")).alias("targets"))


def with_heading(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links`` (target_path, heading, ...) with found: true if the target exists and, where a heading is named, has it."""
    heads = notes.select(F.col("path").alias("target_path"), F.explode("headings").alias("h")).select("target_path", T.normalise_heading(F.col("h")).alias("__head")).where("__head is not null").distinct()
    there = notes.select(F.col("path").alias("target_path")).distinct().withColumn("__note", F.lit(True))
    asked = links.withColumn("__head", T.normalise_heading(F.col("heading")))
    out = asked.join(there, "target_path", "left").join(heads.withColumn("__has", F.lit(True)), ["target_path", "__head"], "left")
    return out.select(*links.columns, (F.col("__note").isNotNull() & (F.col("__head").isNull() | F.col("__has").isNotNull())).alias("found"))
