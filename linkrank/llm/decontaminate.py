"""Benchmark decontamination with one Aho-Corasick automaton.

A-Z are lower-cased and words are runs of digits, letters a-z and characters beyond ASCII. Every run of ``WINDOW``
words of a benchmark item (or the whole of a shorter one) is a pattern; all patterns go into one automaton, which scans
each text once and reports every occurrence, overlapping ones included. Word positions lead back to offsets in the
original text.

Words are numbered, and a word is two letters of alphabets of their own in the automaton, so its size follows the number of
words in the windows, not their lengths. The benchmark is read one item after the other and worked off in blocks of windows with
``MAX_NODES`` nodes at most (a long item is cut into pieces that overlap by a window); a block is what the driver and a
worker hold at a time. A node takes about 45 bytes, so an automaton takes at most 200 MB of a Python worker, whatever
the size of the benchmark: 1 MB of text is one block, 32 MB are about 30. Each block scans all documents, and
what the blocks find is united for each document.

Null and empty texts have no words and are never hit; a null item, or one without words, matches nothing; items with
equal windows are all reported; a repeated item id is named once. Long texts are scanned whole; repeated rows are hit
alike; an empty benchmark hits nothing. Columns other than doc_id and text play no part and stay.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrank.llm.common import bound_batches, map_arrow

#: Most nodes of an automaton, and most words in a piece of an item.
MAX_NODES, PIECE_WORDS = 4_000_000, 100_000
#: Words in a window.
WINDOW = 10
_words = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """The normalised words, in UTF-8: there, lower-casing bytes touches A-Z alone and other alphabets are bytes from 0x80."""
    return _words.findall(text.encode().lower()) if text else []


def windows_of(words: list[bytes]) -> Iterator[list[bytes]]:
    for start in range(max(1, len(words) - WINDOW + 1) if words else 0):
        yield words[start : start + WINDOW]


class WindowAutomaton:
    """All windows of the items in one automaton; each pattern knows its number of words and its items."""

    def __init__(self, items: list[tuple[str, str | None]]):
        split = [(item, words_of(text)) for item, text in items]
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        known = dict.fromkeys(w for _, words in split for w in words)
        side = max(1, int(np.ceil(np.sqrt(len(known)))))
        # two alphabets: a match can't begin between the letters of a word
        self.letters = {w: chr(0x100 + k // side) + chr(0x2000 + k % side) for k, w in enumerate(known)}
        patterns: dict[str, tuple[int, set[int]]] = {}
        for item, words in split:
            for window in windows_of(words):
                patterns.setdefault("".join([self.letters[w] for w in window]), (len(window), set()))[1].add(number[item])
        self.machine = ahocorasick.Automaton()
        for pattern, (n, of) in patterns.items():
            self.machine.add_word(pattern, (n, tuple(sorted(of))))
        self.empty = not patterns
        if patterns:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, a flag for each word that lies in an occurrence, numbers of the items that occur."""
        words = words_of(text)
        n, items = len(words), set()
        step = np.zeros(n + 1, np.int64)
        if n and not self.empty:
            get = self.letters.get
            for at, (length, of) in self.machine.iter("".join([get(w, "  ") for w in words])):
                last = at // 2
                step[last - length + 1] += 1
                step[last + 1] -= 1
                items.update(of)
        return n, np.cumsum(step[:-1]) > 0, items

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end, in characters of the original text, of each run of hit words."""
        n, hit, _ = self.scan(text)
        if not hit.any():
            return []
        raw = text.encode()
        at = [m.span() for m in _words.finditer(raw.lower())]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
        return [(len(raw[: at[a][0]].decode()), len(raw[: at[b - 1][1]].decode())) for a, b in edges.tolist()]


def item_blocks(benchmark: DataFrame, most: int = MAX_NODES) -> Iterator[list[tuple[str, str]]]:
    """Items, read one after the other, in blocks whose windows have at most ``most`` nodes together (a larger piece stands alone)."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        for start in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS):
            piece = words[start : start + PIECE_WORDS + WINDOW - 1]
            nodes = 2 * min(len(piece), WINDOW) * max(1, len(piece) - WINDOW + 1)
            if not piece:
                continue
            if block and size + nodes > most:
                yield block
                block, size = [], 0
            block.append((item, b" ".join(piece).decode()))
            size += nodes
    if block:
        yield block


def _key() -> Column:
    """A hash pair of id and text; rows that agree in both are hit alike."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", "text")]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit("second"), *marked).alias("b"))


_machines: dict[str, WindowAutomaton] = {}


def _machine(name: str, items: list[tuple[str, str]]) -> WindowAutomaton:
    """The automaton of a block, made once in a worker process; only the latest one is kept."""
    if name not in _machines:
        _machines.clear()
        _machines[name] = WindowAutomaton(items)
    return _machines[name]


def _scan_block(docs: DataFrame, items: list[tuple[str, str]], out: str) -> DataFrame:
    """For every row: (doc_id, n_words, n_hit, items); or (doc_id, spans); or (key, hits, items) of rows that are hit, hits being word positions."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def build():
        machine = _machine(name, shared.value)
        names = lambda of: sorted([machine.ids[i] for i in of])

        def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [machine.scan(t) for t in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([int(h.sum()) for _, h, _ in rows], pa.int64()), pa.array([names(of) for _, _, of in rows], pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

        def positions(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [machine.scan(t) for t in batch.column(1).to_pylist()]
            some = pa.array([bool(of) for _, _, of in rows], pa.bool_())
            full = [(h, of) for _, h, of in rows if of]
            return pa.record_batch([batch.column(0).filter(some), pa.array([np.flatnonzero(h) for h, _ in full], pa.list_(pa.int32())), pa.array([names(of) for _, of in full], pa.list_(pa.string()))], ["key", "hits", "items"])

        def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [machine.spans(t) for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.record_batch([batch.column(0), pa.array([[{"start": a, "end": b} for a, b in s] for s in got], kind)], ["doc_id", "spans"])

        return {"digest": digest, "positions": positions, "spans": spans}[out]

    schema = {"digest": "doc_id long, n_words long, n_hit long, items array<string>", "positions": "key struct<a:long,b:long>, hits array<int>, items array<string>", "spans": "doc_id long, spans array<struct<start:long,end:long>>"}[out]
    first = _key().alias("key") if out == "positions" else F.col("doc_id").cast("long").alias("doc_id")
    return map_arrow(docs.select(first, F.col("text").cast("string").alias("text")), build, schema, rows=500)


def _few(blocks: Iterator[list[tuple[str, str]]]) -> tuple[list[tuple[str, str]], Iterator[list[tuple[str, str]]] | None]:
    """The first block, and all blocks if there are more."""
    first = next(blocks, [])
    second = next(blocks, None)
    return first, None if second is None else itertools.chain([first, second], blocks)


def _united(docs: DataFrame, blocks: Iterator[list[tuple[str, str]]]) -> DataFrame:
    """(key, n_hit, items) of the rows that any block hits, once for equal rows."""
    found = [_scan_block(docs, block, "positions").withColumn("block", F.lit(k)) for k, block in enumerate(blocks)]
    # equal rows first fall together, so a document's group is as long as there are blocks
    once = functools.reduce(DataFrame.unionByName, found).groupBy("key", "block").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))
    every = once.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return every.select("key", F.size(F.array_distinct("hits")).cast("long").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")).cast("long")


def find_hits(docs: DataFrame, benchmark: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row of ``docs``; ``items`` are the ids, sorted as strings."""
    first, more = _few(item_blocks(benchmark, most))
    if more is None:
        return _scan_block(docs, first, "digest")
    plain = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), n_words(plain).alias("n_words"))
    out = rows.join(_united(docs, more), "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_spans(docs: DataFrame, benchmark: DataFrame) -> Iterator[DataFrame]:
    """For each block of items, (doc_id, spans): where hit words lie in the original text."""
    return (_scan_block(docs, block, "spans") for block in item_blocks(benchmark))


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, as they are."""
    first, more = _few(item_blocks(benchmark, most))
    if more is not None:
        gone = _united(docs, more).select(F.col("key").alias("__hit"))
        return docs.join(gone, _key() == gone["__hit"], "left_anti")
    bound_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(first), uuid.uuid4().hex

    def clean(batches, at=docs.columns.index("text")):
        machine = _machine(name, shared.value)
        for batch in batches:
            yield batch.filter(pa.array([not machine.scan(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
