"""Text functions as column expressions: normalisation, tokens, n-grams, similarity, Markdown stripping, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning as terms.
STOP_WORDS = (
    "and are but for from has have into not that the their then there these they this through was "
    "were what when where which while with would you your"
).split()

#: White space of the source format: ASCII, no-break and typographic spaces, line separators, byte order mark.
SPACE = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
MAX_BODY_TOKENS = 5000
PREVIEW_LENGTH = 180

# Fixed values: (pattern, replacement) of Markdown markup, in the order in which they apply. (?d) keeps line ends to LF.
MARKDOWN_RULES = (
    (r"(?d)^---[\t ]*\r?\n(?s:.*?)\r?\n(?:---|\.\.\.)[\t ]*(?:\r?\n|\z)", ""),
    (r"(?dm)^[\t ]{0,3}`{3,}[^\n]*\n(?s:.*?)^[\t ]{0,3}`{3,}[\t ]*$", " "),
    (r"(?dm)^[\t ]{0,3}~{3,}[^\n]*\n(?s:.*?)^[\t ]{0,3}~{3,}[\t ]*$", " "),
    (r"(?dm)^[\t ]{0,3}(?:`{3,}|~{3,})[^\n]*(?:\n(?s:.*))?$", " "),
    (r"<!--(?s:.*?)-->", " "),
    (r"(?dm)^\s*\$\$(?s:.*?)^\s*\$\$\s*$", " "),
    (
        r"(?iu)<(address|article|aside|blockquote|details|dialog|div|dl|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|iframe|main|menu|nav|object|ol|p|pre|script|section|style|summary|table|template|ul)(?![A-Za-z0-9_])[^>]*>(?s:.*?)</\1\s*>",
        " ",
    ),
    (r"`+[^\n]*?`+", " "),
    (r"(?dm)(^|[^\\$])\$(?!\$)[^\n$]+\$", "$1 "),
    (r"!\[\[[^\]\n]+\]\]", " "),
    (r"\[\[[^\]\n]+\]\]", " "),
    (r"!\[[^\]\n]*\]\([^)\n]+\)", " "),
    (r"\[([^\]\n]+)\]\([^)\n]+\)", "$1"),
    (r"(?i)(?<![A-Za-z0-9_])(?:https?://|www\.)[^\s<>()]+", " "),
    (r"<[^>]+>", " "),
    (r"(?dm)^\s{0,3}(?:#{1,6}|>|[-+*]|\d+[.)])\s+", " "),
    (r"[*_~^=|]", " "),
)


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalise(text: Column) -> Column:
    """Compatibility decomposition, lower case, no marks, one form of alef, letters and digits separated by single spaces."""
    given = F.coalesce(text, F.lit(""))
    parts = F.lower(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), given, F.lit(True)))
    bare = F.regexp_replace(F.regexp_replace(parts, "\\p{M}+", ""), "[ٱأإآ]", "ا")
    # nothing of this concerns ASCII, which a text of as many bytes as characters is
    plain = F.when(F.octet_length(given) == F.char_length(given), F.lower(given)).otherwise(bare)
    return F.trim(F.regexp_replace(plain, "[^\\p{L}\\p{N}]+", " "))


def words(normal: Column) -> Column:
    """Tokens of a normalised text."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def tokens(text: Column) -> Column:
    return words(normalise(text))


def meaningful_tokens(text: Column, limit: int = 24) -> Column:
    """First distinct tokens of three letters or more that are no stop words; a limit below 1 still leaves one."""
    kept = F.filter(tokens(text), lambda t: (F.char_length(t) >= 3) & ~t.isin(STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, max(1, limit))


def ngrams(normal: Column, width: Column | int) -> Column:
    """Overlapping pieces of a normalised text with a space on each side; a shorter text is one piece."""
    width = F.lit(width) if isinstance(width, int) else width
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    n = F.char_length(padded)
    return F.when(n <= width, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.substr(padded, i, width)))


def own_ngrams(normal: Column) -> Column:
    """N-grams in the width of the text itself: two below five letters, else three; none of an empty text."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(ngrams(normal, F.when(F.char_length(normal) < 5, F.lit(2)).otherwise(F.lit(3))))


def similarity(left: Column, right: Column) -> Column:
    """Soerensen-Dice coefficient of the n-gram multisets of two normalised texts."""
    width = F.when(F.least(F.char_length(left), F.char_length(right)) < 5, F.lit(2)).otherwise(F.lit(3))
    a, b = ngrams(left, width), ngrams(right, width)
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, g: acc + F.least(count(a, g), count(b, g)))
    return F.when(left == right, F.when(left == "", 0.0).otherwise(1.0)).when((left == "") | (right == ""), 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def strip_markdown(text: Column) -> Column:
    out = text
    for pattern, by in MARKDOWN_RULES:
        out = F.regexp_replace(out, pattern, by)
    return collapse(out)


def preview(text: Column, length: int = PREVIEW_LENGTH) -> Column:
    """The text in one line, cut to ``length`` characters with an ellipsis; null if nothing is left."""
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when(flat == "", F.lit(None)).when(F.char_length(flat) <= length, flat).otherwise(F.concat(F.rtrim(F.substr(flat, F.lit(1), F.lit(max(0, length - 1)))), F.lit("…")))


def canonical_space(text: Column) -> Column:
    """Canonical composition and single spaces."""
    return collapse(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False)))


def query_context(variant: str, title: Column, focus: Column, previous: Column, following: Column, sentence: Column, paragraph: Column) -> Column:
    """Labelled lines of one of four variants of a query's context; empty components are left out."""
    parts = {
        "legacy-title-sentence-paragraph": (("Note", title), ("Sentence", sentence), ("Paragraph", paragraph)),
        "focus-only": (("Focus", focus),),
        "title-focus": (("Note", title), ("Focus", focus)),
        "title-focus-neighbours": (("Note", title), ("Previous", previous), ("Focus", focus), ("Next", following)),
    }[variant]
    return F.concat_ws("\n", *[F.when(canonical_space(c) != "", F.concat(F.lit(f"{label}: "), canonical_space(c))) for label, c in parts])


def sentence_segments(text: Column) -> Column:
    """Sentences of a passage: up to a run of end marks, line feeds, or the end."""
    return F.regexp_extract_all(text, F.lit("[^.!?؟。！\\n]+(?:[.!?؟。！]+|\\n+|\\z)"), F.lit(0))


def normalise_heading(text: Column) -> Column:
    """Without leading # signs and outer spaces; null if empty."""
    return F.nullif(collapse(F.regexp_replace(collapse(text), "^#+", "")), F.lit(""))


def escape_alias(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\|\\]])", "\\\\$1")


def wikilink(target: Column, heading: Column, alias: Column) -> Column:
    """[[target#heading|alias]]; an alias that repeats the destination, or the base name of a link without heading, is left out."""
    head = normalise_heading(heading)
    destination = F.concat(target, F.when(head.isNotNull(), F.concat(F.lit("#"), head)).otherwise(F.lit("")))
    base = F.element_at(F.split(target, "/"), -1)
    plain = F.coalesce(collapse(alias), F.lit(""))
    bare = (plain == "") | (plain == destination) | (head.isNull() & (plain == base))
    return F.concat(F.lit("[["), destination, F.when(bare, F.lit("")).otherwise(F.concat(F.lit("|"), escape_alias(plain))), F.lit("]]"))


def delimited_list(text: Column) -> Column:
    """Distinct trimmed parts of a text split at commas and line feeds."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[\\n,]"), collapse), lambda x: x != ""))


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: a quarter of each word's bytes, each mark, and a thirty-second of all bytes; one at least."""
    found = F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}\\p{M}]+"), F.lit(0))
    of_words = F.aggregate(found, F.lit(0).cast("long"), lambda acc, w: acc + F.greatest(F.lit(1), F.ceil(F.octet_length(w) / 4)).cast("long"))
    return F.greatest(F.lit(1), of_words + F.size(F.regexp_extract_all(text, F.lit("[\\p{P}\\p{S}]"), F.lit(0))) + F.ceil(F.octet_length(text) / 32)).cast("long")


def round_half_up(value: Column, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n."""
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)
