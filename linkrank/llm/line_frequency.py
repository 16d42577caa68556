"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Lines are normalised (lower case, digits to 0, without ASCII punctuation and white space) and hashed. For each host
and line the distinct documents are counted: documents of equal text count as one. A line that ``min_documents`` of them
have is boilerplate and is removed from every document. A document that is left with too small a share of its word characters, or
too few of them, is depleted and rejected. Texts that fail the base rules are rejected as well.

One depleted document of a group of near copies stays whole: lines that many near copies share are removed like any
other, so the copies are depleted, and with them the text would be gone altogether. A depleted document that is the
first of its host (by id) to have the lines which make up half of its removed characters, or more, is the original of what it says. It is kept with all
its lines.

Each line is written once, as hashes, and counted by two hash aggregations that combine on the map side, so a line or
a text that a third of all rows share costs no more than another. Frequent lines are joined back in two ways: the
``HOT_LINES`` most frequent ones, whose number is fixed, are broadcast; the others by a shuffle, in which no key can
have more than a ``HOT_LINES``-th of the rows. Counts are exact up to collisions of 64-bit hashes.

Results for odd input: a null text has no words and fails the base rules; a null host is a host of its own; repeated
rows are each judged and count once; rows without an id come after all others when the first document of a line is looked for, and
tie among themselves; a document without frequent lines is judged by the base rules alone; an empty table gives no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrank.llm.common import ensure_checkpoint_dir

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: So many of the most frequent lines are broadcast; each of the others has at most total / HOT_LINES documents.
HOT_LINES = 1000


@dataclass(frozen=True)
class Limits:
    """Limits of the rules. So many of a document's word characters have to be left."""

    min_documents: int = 10
    min_first_percent: int = 50
    min_left_percent: int = 30
    min_left_chars: int = 50
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_base(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with a text; null counts as empty.

    Repeated words: all windows of the text are hashed (``window`` is a power of two); hashes with their positions are sorted, so equal ones become
    neighbours; the start positions of windows with an equal neighbour, in order, tell the words that they cover. This
    is done for texts that have equal windows only.
    """
    kept, window = docs.columns, limits.window
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(*kept, t.alias("_t"), F.translate(t, SEPARATORS, "").alias("_bare"), words_of(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "").alias("_l"))
    step = step.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length("_bare").cast("long").alias("word_chars"),
        (F.char_length("_bare") - F.char_length(F.translate("_bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    names = [c for c in step.columns if c != "_h"]
    # hashes of 1, 2, 4, ... words: the hash of a run is that of its halves; a text without equal halves has no equal windows
    span = 1
    while span < window:
        last = span * 2 == window
        pairs = F.transform("_h", lambda h, i: F.xxhash64(h, F.get("_h", i + span)))
        if last:
            pairs = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.slice(pairs, 1, F.greatest(F.col("n_words") - (window - 1), F.lit(0)).cast("int"))).otherwise(F.array().cast("array<bigint>"))
        step = step.select(*names, pairs.alias("_h"))
        span *= 2
    placed = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select(*names, placed.alias("_p"))
    equal = F.filter("_p", lambda x, k: F.coalesce((k > 0) & (F.get("_p", k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("_p", k + 1)["h"] == x["h"], F.lit(False)))
    step = step.select(*names, F.sort_array(F.transform(equal, lambda x: x["i"])).alias("_s"))
    covered = F.aggregate(F.transform("_s", lambda x, k: F.least(F.lit(window), F.coalesce(F.get("_s", k + 1) - x, F.lit(window)))), F.lit(0), lambda acc, x: acc + x)
    step = step.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent)
    return step.withColumn("base_failed", failed)


def line_keys(text: Column) -> Column:
    """The normalised lines of a text: lower case, digits as 0, without ASCII punctuation and white space."""
    return F.split(F.translate(F.lower(text), string.digits + string.punctuation + SEPARATORS.replace("\n", ""), "0" * 10), "\n")


#: What tells rows apart; rows that agree in all three are judged alike.
KEY = ["__lf_id", "__lf_host", "__lf_text"]
#: Stands for a null id: larger than any other.
NO_ID = (1 << 63) - 1


def _marked(column: str) -> Column:
    """Hash of a value as text, apart from that of null."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")))


def with_key(docs: DataFrame) -> DataFrame:
    """Add the columns of ``KEY``: the id, and hashes of host and text."""
    return docs.select(*docs.columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(KEY[0]), _marked("source").alias(KEY[1]), _marked("text").alias(KEY[2]))


def lines_of(docs: DataFrame) -> DataFrame:
    """(*KEY, h, chars) for each line with a normalised form of each row: its hash and its length."""
    lines = F.transform(F.filter(line_keys(F.coalesce(F.col("text").cast("string"), F.lit(""))), lambda k: k != ""), lambda k: F.struct(F.xxhash64(k).alias("h"), F.char_length(k).alias("chars")))
    step = with_key(docs.select("doc_id", "source", "text")).select(*KEY, lines.alias("l"))
    # an outer explode: for an inner one, Spark would evaluate the array once more, in a filter
    step = step.select(*KEY, F.explode_outer("l").alias("x")).where(F.col("x").isNotNull())
    return step.select(*KEY, "x.h", "x.chars")


def frequent_lines(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, h, n, first) of lines above the limits: the number of distinct documents that have it, and the smallest id."""
    texts = lines.groupBy(KEY[1], "h", KEY[2]).agg(F.min(KEY[0]).alias("first"))
    counted = texts.groupBy(KEY[1], "h").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    return counted.where(F.col("n") >= limits.min_documents)


def removed_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(*KEY, h, chars, own) for each occurrence of a frequent line; own if no document of the host with it comes before."""
    ensure_checkpoint_dir(docs.sparkSession)
    lines = lines_of(docs).checkpoint()
    frequent = frequent_lines(lines, limits).checkpoint()
    host = KEY[1]
    hot = F.broadcast(frequent.orderBy(F.col("n").desc(), host, "h").limit(HOT_LINES).select(host, "h", F.col("first").alias("hot")))
    cold = frequent.join(hot, [host, "h"], "left_anti").select(host, F.col("h").alias("k"), F.col("first").alias("cold"))
    flagged = lines.join(hot, [host, "h"], "left")
    # a hot line's rows go anywhere in the second join, where they meet nothing
    flagged = flagged.withColumn("k", F.when(F.col("hot").isNotNull(), F.xxhash64(KEY[0], KEY[2], "h")).otherwise(F.col("h")))
    found = flagged.join(cold, [host, "k"], "left").withColumn("first", F.coalesce("hot", "cold")).where("first is not null")
    return found.select(*KEY, "h", "chars", (F.col("first") == F.col(KEY[0])).alias("own"))


def removals(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(*KEY, removed_chars, own_chars, removed) of rows with frequent lines, once for equal rows; removed has the lines' hashes."""
    # equal rows have equal lines: one of them counts
    copies = with_key(docs.select("doc_id", "source", "text")).groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1")
    own = F.when(F.col("own"), F.col("chars")).otherwise(0)
    sums = removed_lines(docs, limits).groupBy(*KEY).agg(F.sum("chars").alias("w"), F.sum(own).alias("o"), F.collect_set("h").alias("removed")).join(copies, KEY, "left")
    once = lambda c: (F.col(c) / F.coalesce("copies", F.lit(1))).cast("long")
    return sums.select(*KEY, once("w").alias("removed_chars"), once("o").alias("own_chars"), "removed")


def verdicts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, *KEY), the columns of :func:`with_base`, removed_chars, removed (hashes of the lines to remove) and kept, for every row."""
    base = with_base(with_key(docs.select("doc_id", "source", "text")), limits).drop("text", "source").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = base.join(removals(docs, limits), KEY, "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0).cast("long")))
    poor = depleted(F.col("word_chars"), F.col("removed_chars"), limits)
    original = F.coalesce(F.col("own_chars") * 100 >= F.col("removed_chars") * limits.min_first_percent, F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & (~poor | original)).withColumn("removed", F.when(~(poor & original), F.col("removed")))
    return out.drop("own_chars")


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the columns of :func:`with_base`, removed_chars and kept for every row."""
    return verdicts(docs, limits).drop(*KEY, "removed")


def depleted(chars: Column, removed: Column, limits: Limits) -> Column:
    left = chars - removed
    return (removed > 0) & ((left < limits.min_left_chars) | (left * 100 < chars * limits.min_left_percent))


def apply_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, without their frequent lines; the columns stay, n_chars follows the text if it is there."""
    names = docs.columns
    # written first: Spark would push the filter into the expressions of the rules and evaluate them many times
    judged = verdicts(docs, limits).select(*KEY, F.col("removed").alias("__lf_removed"), "kept").checkpoint()
    passed = judged.where("kept").select(*KEY).distinct()
    removed = judged.where("kept and __lf_removed is not null").drop("kept").distinct()
    out = with_key(docs).join(passed, KEY).join(removed, KEY, "left")
    lines = F.arrays_zip(F.split("text", "\n").alias("line"), line_keys(F.col("text")).alias("k"))
    left = F.array_join(F.transform(F.filter(lines, lambda x: ~F.array_contains("__lf_removed", F.xxhash64(x["k"]))), lambda x: x["line"]), "\n")
    text = F.when(F.col("__lf_removed").isNull(), F.col("text")).otherwise(left)
    out = out.select(*[text.alias(c) if c == "text" else F.col(c) for c in names])
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out
