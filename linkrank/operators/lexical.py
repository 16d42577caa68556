"""Lexical search of a batch of queries over notes.

A query meets a note through a term, an exact primary label, or enough label n-grams. Queries are a stated set, held by each task
as inverted indexes of terms and n-grams, in blocks; notes are met with them where they are, and what leaves a task is the pairs that
were asked for, or the winners of each query. No pair is shuffled for its score.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrank.functions import text as T
from linkrank.operators import matching as M
from linkrank.sources.snapshot import ensure_checkpoint_dir

#: Kinds of a match, with the signals that make it.
BY_KIND = {"title": (1, 5, 7, 10), "alias": (2, 6, 8, 11), "heading": (3, 9), "tag": (4, 12), "body": (13,)}
CONTEXT_TERMS = 16
#: The least similarity of a label that counts (headings need a little more).
LEAST_SIMILARITY = 0.55
MAX_BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast a side that is counted to be small; leave the choice to the optimizer otherwise."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def index_notes(notes: DataFrame) -> DataFrame:
    """Normalised fields and token sets of each note."""
    label = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.col("basename")).otherwise(F.col("title"))
    clean = lambda xs: F.array_distinct(F.filter(F.transform(xs, T.normalise), lambda x: x != ""))
    return notes.select(
        "path",
        label.alias("title"),
        T.normalise(label).alias("n_title"),
        T.words(T.normalise(F.coalesce("title", F.lit("")))).alias("own_title_terms"),
        clean(F.col("aliases")).alias("n_aliases"),
        F.filter(F.transform("headings", lambda h: F.struct(F.trim(h).alias("text"), T.normalise(h).alias("norm"))), lambda h: h["norm"] != "").alias("headings"),
        clean(F.transform("tags", lambda t: F.regexp_replace(t, "^#", ""))).alias("n_tags"),
        F.col("body"),
    )


def _terms(xs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(xs, T.words)))


def with_token_sets(index: DataFrame) -> DataFrame:
    return index.select("*", F.array_distinct(T.words(F.col("n_title"))).alias("title_terms"), _terms(F.col("n_aliases")).alias("alias_terms"), _terms(F.col("n_tags")).alias("tag_terms"), F.array_distinct(F.flatten(F.transform("headings", lambda h: T.words(h["norm"])))).alias("heading_terms"))


def body_terms(notes: DataFrame) -> DataFrame:
    """(path, term, tf) over the first 5,000 body tokens."""
    return notes.select("path", F.explode(F.slice(T.tokens(F.col("body")), 1, T.MAX_BODY_TOKENS)).alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"))


def _note_terms(notes: DataFrame, *more: str) -> DataFrame:
    """(path, ..., body, labels): the first 5,000 body tokens, and the distinct tokens of all labels."""
    fields = with_token_sets(index_notes(notes))
    labels = F.array_union(F.array_union(F.array_distinct("own_title_terms"), F.col("alias_terms")), F.array_union(F.col("heading_terms"), F.col("tag_terms")))
    return fields.select("path", *more, F.slice(T.tokens(F.col("body")), 1, T.MAX_BODY_TOKENS).alias("body"), labels.alias("labels"))


def postings(notes: DataFrame) -> DataFrame:
    """(term, path, tf, least) of terms of any field; tf counts the body, least is 0 for a term of a label."""
    marked = lambda c, n: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(n).alias("n")))
    flat = _note_terms(notes).select("path", F.explode_outer(F.concat(marked("body", 1), marked("labels", 0))).alias("x")).select("path", "x.term", "x.n").where("term is not null")
    return flat.groupBy("term", "path").agg(F.sum("n").alias("tf"), F.min("n").alias("least"))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count("*").alias("df"))


def asked_terms(queries: DataFrame, *more: str | Column) -> pa.Table:
    """(query_id, anchors, context, ...): anchor tokens weigh 2; the first 16 meaningful context tokens that are none of them weigh 1."""
    anchor = F.array_distinct(T.tokens(F.col("anchor_text")))
    context = F.array_except(T.meaningful_tokens(F.col("context_text"), CONTEXT_TERMS), anchor)
    return queries.select(F.col("query_id").cast("long"), anchor.alias("anchors"), F.coalesce(context, F.array().cast("array<string>")).alias("context"), *more).toArrow()


def live_queries(queries: DataFrame) -> DataFrame:
    """Queries with an anchor and a positive limit, with the normalised anchor."""
    return queries.withColumn("anchor", T.normalise(F.col("anchor_text"))).where("anchor <> '' and `limit` > 0")


def labels_of(index: DataFrame) -> DataFrame:
    """(path, field, pos, text, norm) of titles, aliases and headings."""
    title = F.array(F.struct(F.lit("title").alias("field"), F.lit(0).alias("pos"), F.col("title").alias("text"), F.col("n_title").alias("norm")))
    alias = F.transform("n_aliases", lambda a, i: F.struct(F.lit("alias").alias("field"), i.alias("pos"), a.alias("text"), a.alias("norm")))
    heading = F.transform("headings", lambda h, i: F.struct(F.lit("heading").alias("field"), i.alias("pos"), h["text"].alias("text"), h["norm"].alias("norm")))
    # an outer explode, since for an inner one Spark evaluates the array once more in a filter below it
    return index.select("path", F.explode_outer(F.concat(title, alias, heading)).alias("x")).select("path", "x.*")


def _grams(norm: str, width: int) -> list[str]:
    """:func:`linkrank.functions.text.ngrams` of one text."""
    padded = f" {norm} "
    return [padded[i : i + width] for i in range(max(1, len(padded) - width + 1))]


def _brief(norm: str) -> bool:
    return len(norm) < 5


def _own_grams(norm: str) -> list[str]:
    return _grams(norm, 2 if _brief(norm) else 3) if norm else []


def _tokens(lists: list[list[str]]) -> M.Tokens:
    """Tokens by the queries that have them, each with how often."""
    sizes = [len(x) for x in lists]
    flat = pa.array([g for x in lists for g in x], pa.string())
    words = pc.unique(flat)
    ids = pc.index_in(flat, value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
    item, token, count = M.counted(np.repeat(np.arange(len(lists)), sizes), ids, len(words))
    return M.Tokens(words.take(pa.array(token)), item, count)


def _lists(values: list[list[str]]) -> pa.ListArray:
    return pa.array(values, pa.list_(pa.string()))


class _Candidates:
    """Anchors by the n-grams in their own width."""

    def __init__(self, anchors: list[str]):
        own = [_own_grams(a) for a in anchors]
        self.tokens, self.width = _tokens(own), len(own)
        self.need = np.maximum(1, np.floor(np.array([len(g) for g in own], float) * 0.25))

    def of(self, norms: list[list[str]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, stop, rows by anchors): whether the distinct grams of a row's labels hold a quarter of an anchor's."""
        row, token = self.tokens.find(_lists([list({g for x in labels for g in _own_grams(x)}) for labels in norms]))
        for start, stop in M.pieces(self.tokens.work(row, token, len(norms)), self.width):
            lo, hi = np.searchsorted(row, (start, stop))
            which, place = self.tokens.spread(token[lo:hi])
            yield start, stop, M.table(row[lo:hi][which] - start, self.tokens.item[place], self.tokens.number[place], stop - start, self.width) >= self.need


class _Similarity:
    """Anchors by the n-grams in the widths in which labels are compared: two letters if one of both is short, else three."""

    def __init__(self, anchors: list[str]):
        self.width = len(anchors)
        two, three = [_grams(a, 2) for a in anchors], [_grams(a, 3) for a in anchors]
        self.brief = np.array([_brief(a) for a in anchors], bool)
        # grams of two and of three letters are told apart by their length
        self.of_brief, self.of_long = _tokens(two), _tokens([b if s else c for b, c, s in zip(two, three, self.brief)])
        self.two, self.three = np.array([len(g) for g in two], float), np.array([len(g) for g in three], float)

    def of(self, norms: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(label, anchor, similarity) of those that share an n-gram and reach ``least``."""
        some = bool(self.brief.any())
        for short, tokens in ((True, self.of_brief), (False, self.of_long)):
            own = [i for i, x in enumerate(norms) if x and _brief(x) == short]
            if not own or not self.width:
                continue
            grams = [_grams(norms[i], 2) if short else (_grams(norms[i], 2) if some else []) + _grams(norms[i], 3) for i in own]
            label = np.array(own)
            # as many grams of three letters as letters, and one more of two
            base, own_size = np.where(short | self.brief, self.two + 1, self.three), np.array([len(norms[i]) for i in own], float)
            row, token, count = M.counted(*tokens.find(_lists(grams)), len(tokens.words))
            for start, stop in M.pieces(tokens.work(row, token, len(own)), self.width):
                lo, hi = np.searchsorted(row, (start, stop))
                which, place = tokens.spread(token[lo:hi])
                common = M.table(row[lo:hi][which] - start, tokens.item[place], np.minimum(count[lo:hi][which], tokens.number[place]), stop - start, self.width)
                # most pairs are far below a bound; the few beside it are told apart by their quotient
                r, q = np.nonzero(common > (np.add.outer(own_size[start:stop], base) * (least / 2 - 1e-9) if least else 0))
                sim = 2.0 * common[r, q] / (own_size[start + r] + base[q])
                keep = sim >= least
                yield label[start + r[keep]], q[keep], sim[keep]


def _column(part: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = part.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def gram_candidates(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, path) whose label grams hold at least a quarter of the anchor's grams; repeated anchor grams count."""
    norms = labels.groupBy("path").agg(F.collect_set("norm").alias("norms"))

    def build(part: pa.Table) -> tuple:
        return _column(part, "query_id"), _Candidates(_column(part, "anchor").to_pylist())

    def match(index: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, candidates = index
        for batch in batches:
            for start, stop, met in candidates.of(batch.column(1).to_pylist()):
                r, q = np.nonzero(met)
                yield pa.record_batch([batch.column(0).slice(start, stop - start), *_listed(r, stop - start, ids.take(pa.array(q)))], ["path", "ids"])

    # a task hands on a path with a list of its queries, so that it is not repeated for each of them
    found = M.map_blocks(norms, queries.select(F.col("query_id").cast("long"), "anchor").toArrow(), build, match, "path string, ids array<long>")
    return found.select(F.explode("ids").alias("query_id"), "path")


def label_similarity(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, norm, sim) of distinct labels that share an n-gram with the anchor; multisets of n-grams by width."""
    norms = labels.select("norm").distinct().where("norm <> ''")

    def build(part: pa.Table) -> tuple:
        return _column(part, "query_id"), _Similarity(_column(part, "anchor").to_pylist())

    def match(index: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, similarity = index
        for batch in batches:
            for label, q, sim in similarity.of(batch.column(0).to_pylist(), 0.0):
                yield pa.record_batch([ids.take(pa.array(q)), batch.column(0).take(pa.array(label)), pa.array(sim)], ["query_id", "norm", "sim"])

    return M.map_blocks(norms, queries.select(F.col("query_id").cast("long"), "anchor").toArrow(), build, match, "query_id long, norm string, sim double")


def repeated_paths(notes: DataFrame) -> DataFrame:
    """(path) that more than one note has."""
    return notes.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")


def note_codes(notes: DataFrame, asked: pa.Table, *more: str) -> tuple[DataFrame, DataFrame]:
    """(path, ..., codes) of notes, and of each path once: what they have of the queries' terms (:func:`linkrank.operators.matching.packed`).

    Written once, where the notes are read. Only notes that share their path are brought together; they have the codes of all.
    With ``more`` columns of the index every note stays, otherwise a path with terms is one row.
    """
    ensure_checkpoint_dir(notes.sparkSession)
    shared = notes.sparkSession.sparkContext.broadcast(_words(asked))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = M.Tokens(shared.value, np.arange(len(shared.value)), np.ones(len(shared.value)))
        n = max(len(index.words), 1)
        for batch in M.parts(batches):
            (body_row, body), (row, label) = (index.find(batch.column(c)) for c in (0, 1))
            key, place = np.unique(np.concatenate([body_row, row]) * n + np.concatenate([body, label]), return_inverse=True)
            tf = np.bincount(place[: len(body)], minlength=len(key))
            codes = M.packed(key // n, key % n, tf, batch.num_rows)
            once = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1), pa.int32()), codes)
            found = pa.RecordBatch.from_arrays([*batch.columns[2:], once], [*batch.schema.names[2:], "codes"])
            yield found if more else found.filter(pc.greater(pc.binary_length(codes), 0))

    fields = _note_terms(notes, *more)
    kept = fields.drop("body", "labels")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    coded = fields.select("body", "labels", *kept.columns).mapInArrow(encode, f"{schema}, codes array<binary>").checkpoint()
    again = repeated_paths(coded).select(F.col("path").alias("again"), F.lit(True).alias("shared"))
    if again.isEmpty():
        return coded, coded
    marked = coded.join(again, F.col("path").eqNullSafe(F.col("again")), "left").drop("again")
    whole = marked.where("shared").groupBy("path").agg(F.flatten(F.collect_list("codes")).alias("codes"))
    once = marked.where("shared is null").select("path", "codes").unionByName(whole)
    if not more:
        return once, once
    every = marked.join(whole.select(F.col("path").alias("own"), F.col("codes").alias("all")), F.col("path").eqNullSafe(F.col("own")), "left")
    return every.select("path", *more, F.coalesce("all", "codes").alias("codes")), once


class _Terms:
    """Queries by their terms; with the terms' frequencies, what a term weighs."""

    def __init__(self, part: pa.Table, words: pa.Array, frequency: np.ndarray | None):
        lists = [_column(part, c) for c in ("anchors", "context")]
        item = np.concatenate([np.repeat(np.arange(part.num_rows), M.lengths(x)) for x in lists])
        number = np.repeat([2, 1], [len(x.flatten()) for x in lists])
        ids = pc.index_in(pa.concat_arrays([x.flatten() for x in lists]), value_set=words)
        self.ids, self.width, self.n = _column(part, "query_id"), part.num_rows, len(words)
        self.tokens = M.Tokens(ids, item, number)
        df = np.zeros(self.n) if frequency is None else frequency
        with np.errstate(divide="ignore"):
            rarity = np.where(df > 0, 1.0 / np.sqrt(df), 1.0)
        self.weight = self.tokens.number * (0.5 + rarity[self.tokens.words.to_numpy(zero_copy_only=False)][self.tokens.token])
        self.total = np.bincount(self.tokens.item, self.weight, self.width)

    def _asked(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms a query of this block has, and their tokens."""
        token = pc.index_in(pa.array(term, pa.int32()), value_set=self.tokens.words)
        return token.is_valid().to_numpy(zero_copy_only=False), token.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)

    def met(self, row: np.ndarray, term: np.ndarray, rows: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, stop, cells): cells of rows and queries that meet by a term, of distinct terms of rows, by row."""
        known, token = self._asked(term)
        row = row[known]
        for start, stop in M.pieces(self.tokens.work(row, token, rows), self.width):
            lo, hi = np.searchsorted(row, (start, stop))
            which, at = self.tokens.spread(token[lo:hi])
            cell = (row[lo:hi][which] - start) * self.width + self.tokens.item[at]
            yield start, stop, np.flatnonzero(np.bincount(cell, minlength=(stop - start) * self.width))

    def of(self, codes: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, cells, score): cells of rows and queries that meet by a term of any field, and the body's score of each."""
        rows = len(codes)
        row, term, tf = M.unpacked(codes)
        known, token = self._asked(term)
        row, tf = row[known], tf[known]
        boost = np.where(tf > 0, 1.0 + np.minimum(0.2, np.log1p(tf) * 0.06), 0.0)
        for start, stop in M.pieces(self.tokens.work(row, token, rows), self.width):
            lo, hi = np.searchsorted(row, (start, stop))
            which, at = self.tokens.spread(token[lo:hi])
            cell = (row[lo:hi][which] - start) * self.width + self.tokens.item[at]
            hit = tf[lo:hi][which] > 0
            size = (stop - start) * self.width
            # three counts in one sum: terms, terms of the body, terms of the body and the anchor
            counts = np.bincount(cell, 1.0 + hit * 2.0**17 + (hit & (self.tokens.number[at] == 2)) * 2.0**34, size)
            matched = np.bincount(cell, self.weight[at] * boost[lo:hi][which], size)
            cells = np.flatnonzero(counts)
            n, anchors = counts[cells].astype(np.int64) >> 17 & (1 << 17) - 1, counts[cells].astype(np.int64) >> 34
            score = np.where((n == 0) | ((anchors == 0) & (n < 2)), 0.0, 0.48 + np.minimum(0.25, 0.28 * matched[cells] / self.total[cells % self.width]))
            yield start, stop, cells, score


def _words(asked: pa.Table) -> pa.Array:
    return pc.unique(pa.concat_arrays([_column(asked, c).flatten() for c in ("anchors", "context")]))


def frequencies(coded: DataFrame, words: pa.Array) -> np.ndarray:
    """In how many notes each of the queries' terms occurs, in any field; notes of one path count as one."""
    n = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in M.parts(batches):
            total += np.bincount(M.unpacked(batch.column(0))[1], minlength=n)
        term = np.flatnonzero(total)
        yield pa.record_batch([pa.array(term, pa.int64()), pa.array(total[term])], ["t", "n"])

    counts = coded.select("codes").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n)
    out[counts.column("t").to_numpy()] = counts.column("n").to_numpy()
    return out


def _listed(row: np.ndarray, rows: int, *values: pa.Array) -> list[pa.ListArray]:
    """Values of rows, in their order, as a list for each row."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32())
    return [pa.ListArray.from_arrays(ends, x) for x in values]


def term_pairs(notes: DataFrame, queries: DataFrame, scored: bool = True) -> DataFrame:
    """(query_id, path, body_score) of every note that has a term of the query in any field; unless ``scored``, the pairs alone count."""
    asked = asked_terms(queries)
    words = _words(asked)
    if not scored and asked.num_rows <= M.TOGETHER * M.BLOCK_QUERIES and not _shuffled(notes) and repeated_paths(notes).isEmpty():
        return _pairs_of_notes(notes, asked, words)
    _, coded = note_codes(notes, asked)
    df = frequencies(coded, words) if scored else None

    def match(terms: _Terms, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, cells, score in terms.of(batch.column(1)):
                found = [terms.ids.take(pa.array(cells % terms.width)), *([pa.array(score)] if scored else [])]
                yield pa.record_batch([batch.column(0).slice(start, stop - start), *_listed(cells // terms.width, stop - start, *found)], ["path", "ids", "scores"][: 1 + len(found)])

    # a task hands on a path with a list of its queries, so that it is not repeated for each of them
    found = M.map_blocks(coded, asked, lambda part: _Terms(part, words, df), match, "path string, ids array<long>" + ", scores array<double>" * scored)
    if not scored:
        return found.select(F.explode("ids").alias("query_id"), "path")
    return found.select("path", "scores", F.posexplode("ids").alias("at", "query_id")).select("query_id", "path", F.get("scores", "at").alias("body_score"))


def _shuffled(notes: DataFrame) -> bool:
    """Whether notes are dealt out before they come, as those of small tables are."""
    return "Exchange" in notes._jdf.queryExecution().executedPlan().toString()


def _pairs_of_notes(notes: DataFrame, asked: pa.Table, words: pa.Array) -> DataFrame:
    """(query_id, path) of notes, each with a path of its own, and queries that share a term, in one pass over the notes where they are read: no text or term is written."""
    n = max(len(words), 1)

    def match(blocks: list[_Terms], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = M.Tokens(words, np.arange(len(words)), np.ones(len(words)))
        for batch in batches:
            found = [index.find(batch.column(c)) for c in (0, 1)]
            key = np.unique(np.concatenate([row * n + term for row, term in found]))
            for terms in blocks:
                for start, stop, cells in terms.met(key // n, key % n, batch.num_rows):
                    ids = terms.ids.take(pa.array(cells % terms.width))
                    yield pa.record_batch([batch.column(2).slice(start, stop - start), *_listed(cells // terms.width, stop - start, ids)], ["path", "ids"])

    found = M.map_blocks(_note_terms(notes).select("body", "labels", "path"), asked, lambda part: _Terms(part, words, None), match, "path string, ids array<long>", True)
    return found.select(F.explode("ids").alias("query_id"), "path")


class _Search:
    """A block of queries, met with notes: every signal of every pair of a piece of notes, and the winners of a task."""

    def __init__(self, part: pa.Table, words: pa.Array, frequency: np.ndarray):
        self.anchors, self.width = _column(part, "anchor").to_pylist(), part.num_rows
        self.terms, self.near, self.similar = _Terms(part, words, frequency), _Candidates(self.anchors), _Similarity(self.anchors)
        once = np.arange(self.width)
        self.whole = M.Tokens(_column(part, "anchor"), once, np.ones(self.width))
        self.source = M.Tokens(_column(part, "source_path"), once, np.ones(self.width))
        tokens = _column(part, "anchors").to_pylist()
        self.cover, self.size = _tokens(tokens), np.maximum(1, [len(x) for x in tokens])
        self.limit = _column(part, "limit").to_numpy(zero_copy_only=False).astype(np.int64)
        self.minimum = _column(part, "minimum_score").to_numpy(zero_copy_only=False).astype(float)
        self.begins: dict[int, dict[str, list[int]]] = {}
        for q, a in enumerate(self.anchors):
            if len(a) >= 3:
                self.begins.setdefault(len(a), {}).setdefault(a, []).append(q)

    def _count(self, tokens: M.Tokens, lists: pa.ListArray) -> np.ndarray:
        row, token = tokens.find(lists)
        out = np.zeros((len(lists), self.width))
        for start, stop in M.pieces(tokens.work(row, token, len(lists)), self.width):
            lo, hi = np.searchsorted(row, (start, stop))
            which, place = tokens.spread(token[lo:hi])
            out[start:stop] = M.table(row[lo:hi][which] - start, tokens.item[place], None, stop - start, self.width)
        return out

    def _begun(self, lists: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(lists), self.width), bool)
        for row, labels in enumerate(lists):
            for label in labels:
                for n, anchors in self.begins.items():
                    if n <= len(label) and (found := anchors.get(label[:n])):
                        out[row, found] = True
        return out

    def _best_label(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The best similarity of a row's labels that counts, and the first label that has it."""
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        place = np.concatenate([np.arange(len(x)) for x in lists]) if len(row) else row
        best, first = np.zeros((len(lists), self.width)), np.zeros((len(lists), self.width), np.int32)
        found = list(self.similar.of([x for labels in lists for x in labels], LEAST_SIMILARITY))
        if found:
            label, q, sim = (np.concatenate(x) for x in zip(*found))
            # the last one written stays: the most similar, and of these the first
            order = np.lexsort((-place[label], sim))
            label, q, sim = label[order], q[order], sim[order]
            best[row[label], q], first[row[label], q] = sim, place[label]
        return best, first

    def signals(self, notes: dict[str, list], codes: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(candidates, s1 to s13, first label of the best heading) by rows and queries."""
        titles, aliases = [[x] if x else [] for x in notes["n_title"]], notes["n_aliases"]
        headings = [[h["norm"] for h in x] for x in notes["headings"]]
        met, body = np.zeros((len(titles), self.width), bool), np.zeros((len(titles), self.width))
        for start, _, cells, score in self.terms.of(codes):
            met.reshape(-1)[start * self.width + cells], body.reshape(-1)[start * self.width + cells] = True, score
        for start, stop, close in self.near.of([t + a + h for t, a, h in zip(titles, aliases, headings)]):
            met[start:stop] |= close
        same = [self._count(self.whole, _lists(x)) > 0 for x in (titles, aliases, headings, notes["n_tags"])]
        met |= same[0] | same[1]
        met &= self._count(self.source, _lists([[x] for x in notes["path"]])) == 0
        (title, _), (alias, _), (heading, first) = (self._best_label(x) for x in (titles, aliases, headings))
        covered = [self._count(self.cover, _lists(notes[c])) / self.size for c in ("title_terms", "alias_terms", "tag_terms")]
        when = lambda cond, value: np.where(cond, value, 0.0)
        return met, [
            *(when(c, value) for c, value in zip(same, (1.0, 0.99, 0.96, 0.82))),
            when(self._begun(titles), 0.91),
            when(self._begun(aliases), 0.90),
            when(title >= LEAST_SIMILARITY, 0.56 + 0.34 * title),
            when(alias >= LEAST_SIMILARITY, 0.55 + 0.34 * alias),
            when(heading >= 0.58, 0.54 + 0.34 * heading),
            *(when(c > 0, base + share * c) for c, base, share in zip(covered, (0.58, 0.57, 0.56), (0.25, 0.24, 0.24))),
            body,
        ], first

    def winners(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best notes of each query among a task's: by score, rank of an exact hit, title, path."""
        best: list[list[tuple]] = [[] for _ in range(self.width)]
        # what a note must have to be among them: the least score, then a higher key than the last one's, or its key and a place before it
        lowest = np.maximum(1, np.searchsorted(np.arange(1001) / 1000, self.minimum))
        least, before = np.where(self.limit > 0, lowest * 8 - 1, 1 << 30), np.zeros(self.width, np.int64)
        rows = max(1, (M.CELLS >> 2) // max(1, self.width))
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, sort_keys=[("title", "ascending"), ("path", "ascending")], null_placement="at_start"))
            notes = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "codes"}
            places = [(t is not None, t or "", p) for t, p in zip(notes["title"], notes["path"])]
            for q, own in enumerate(best):
                before[q] = bisect.bisect_left(places, own[-1][1]) if len(own) == self.limit[q] else 0
            for start in range(0, batch.num_rows, rows):
                piece = {c: x[start : start + rows] for c, x in notes.items()}
                met, s, first = self.signals(piece, batch.column("codes").slice(start, rows))
                key = np.minimum(1000, np.floor(np.maximum.reduce(s) * 1000 + 0.5)).astype(np.int64) * 8
                for rank, signal in ((2, s[3]), (3, s[2]), (4, s[1]), (5, s[0])):
                    same = signal > 0
                    key[same] = key[same] & ~7 | rank
                place = start + np.arange(len(key))[:, None]
                r, q = np.nonzero(met & (key + (place < before) > least))
                order = np.lexsort((r, -key[r, q], q))
                r, q = r[order], q[order]
                within = np.arange(len(q)) - np.searchsorted(q, q) < self.limit[q]
                r, q = r[within], q[within]
                of = [x[r, q] for x in s]
                so_far = np.maximum.reduce(of[:8])
                named = (of[8] > 0) & (of[8] >= so_far - 0.03)
                kinds = [np.maximum.reduce([of[i - 1] for i in signals]) > 0 for signals in BY_KIND.values()]
                for n, (i, j) in enumerate(zip(r.tolist(), q.tolist())):
                    heads = piece["headings"][i]
                    text = heads[first[i, j]]["text"] if named[n] else next((h["text"] for h in heads if h["norm"] == self.anchors[j]), None)
                    best[j].append((-int(key[i, j]), places[start + i], [k for k, has in zip(BY_KIND, kinds) if has[n]], text))
                for j in np.unique(q).tolist():
                    best[j] = sorted(best[j], key=lambda x: x[:2])[: self.limit[j]]
                    if len(best[j]) == self.limit[j]:
                        least[j], before[j] = -best[j][-1][0], bisect.bisect_left(places, best[j][-1][1])
        out = [(q, *x) for q, own in enumerate(best) for x in own]
        if out:
            q, key, place, kinds, text = zip(*out)
            yield pa.record_batch(
                [
                    self.terms.ids.take(pa.array(q, pa.int64())), pa.array(self.limit[list(q)], pa.int64()), pa.array([p for _, _, p in place], pa.string()), pa.array([t if known else None for known, t, _ in place], pa.string()),
                    pa.array([-k // 8 / 1000 for k in key], pa.float64()), pa.array([-k % 8 for k in key], pa.int32()), pa.array(kinds, pa.list_(pa.string())), pa.array(text, pa.string()),
                ],
                ["query_id", "limit", "path", "title", "score", "exact_rank", "match_kinds", "target_heading"],
            )


def search(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """Ranked notes of each query: query_id, rank, target_path, target_title, target_heading, score, match_kinds, preview."""
    ensure_checkpoint_dir(notes.sparkSession)
    live = live_queries(queries).where("source_path is not null")
    asked = asked_terms(live, "anchor", "source_path", "limit", F.col("minimum_score").cast("double"))
    words = _words(asked)
    # written once, where the notes are read: terms are counted, then weighed
    every, once = note_codes(notes, asked, "title", "n_title", "n_aliases", "headings", "n_tags", "title_terms", "alias_terms", "tag_terms")
    df = frequencies(once, words)
    rows = every.where("path is not null")
    if every is not once and asked.num_rows > M.BLOCK_QUERIES:
        rows = rows.checkpoint()
    schema = "query_id long, limit long, path string, title string, score double, exact_rank int, match_kinds array<string>, target_heading string"
    found = M.map_blocks(rows, asked, lambda part: _Search(part, words, df), _Search.winners, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("exact_rank").desc(), "title", "path"))
    # previews are made for the winners alone
    top = found.withColumn("rank", rank).where(F.col("rank") <= F.col("limit")).checkpoint()
    bodies = notes.select("path", "body").join(small(top.select("path").distinct()), "path", "left_semi")
    shown = top.join(bodies.select("path", T.preview(F.col("body")).alias("body_preview")), "path", "left")
    return shown.select("query_id", "rank", F.col("path").alias("target_path"), F.col("title").alias("target_title"), "target_heading", "score", "match_kinds", F.coalesce(F.concat(F.lit("Heading: "), F.col("target_heading")), F.col("body_preview")).alias("preview"))


def exact_labels(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries whose anchor is a title or alias of some note (left semi join): (query_id)."""
    labels = labels_of(index_notes(notes)).where("field <> 'heading'").select(F.col("norm").alias("anchor")).distinct()
    return live_queries(queries).join(labels, "anchor", "left_semi").select("query_id")
