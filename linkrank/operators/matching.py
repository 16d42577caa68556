"""Rows met with a set of queries inside the task that holds them, so that no pair of a row and a query is shuffled.

The queries are an inverted index (token to queries) that each task holds, in blocks of at most ``BLOCK_QUERIES``. A row's tokens are
spread over the queries that have them and summed in a table of rows and queries, a piece of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Queries whose index a task holds at once.
BLOCK_QUERIES = 8192
#: Blocks that a task may hold together, to look at its rows only once.
TOGETHER = 8
#: Cells of a table of rows and queries, and matches of tokens, that are held at once.
CELLS, MATCHES = 1 << 20, 1 << 21
#: Rows that are looked at together, which bounds what a worker holds of their tokens.
ROWS = 2000


class Tokens:
    """Tokens of queries, by token: which queries have it, and with what number."""

    def __init__(self, tokens: pa.Array, items: np.ndarray, numbers: np.ndarray):
        self.words = pc.unique(tokens)
        ids = pc.index_in(tokens, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(self.words)))])
        self.item, self.number, self.token = np.asarray(items, np.int64)[order], np.asarray(numbers)[order], ids[order]

    def find(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, token) of the tokens in lists of words that a query has."""
        row = np.repeat(np.arange(len(lists)), lengths(lists))
        ids = pc.index_in(lists.flatten(), value_set=self.words) if len(self.words) else pa.nulls(len(row), pa.int32())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return row[known], ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)

    def work(self, row: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
        """Matches of each row."""
        return np.bincount(row, self.start[token + 1] - self.start[token], rows)

    def spread(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, place): each of ``token`` repeated for the queries that have it, with their place in ``item`` and ``number``."""
        n = self.start[token + 1] - self.start[token]
        which = np.repeat(np.arange(len(token)), n)
        return which, np.arange(len(which)) + np.repeat(self.start[token] - np.cumsum(n) + n, n)


def lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def counted(row: np.ndarray, token: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, count) of distinct pairs, by row."""
    key, count = np.unique(row * max(tokens, 1) + token, return_counts=True)
    return key // max(tokens, 1), key % max(tokens, 1), count


def packed(row: np.ndarray, token: np.ndarray, count: np.ndarray, rows: int) -> pa.Array:
    """Tokens of each row and their counts, in few bytes; by row, and by token inside a row. A row without tokens has no bytes.

    Of each token, the distance from the one before and the count, both in groups of seven bits, of which the last is below 128.
    """
    first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    value = np.empty(2 * len(row), np.int64)
    value[::2], value[1::2] = np.where(first, token, np.diff(token, prepend=0)), count
    groups = 1 + sum((value >> 7 * k > 0).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(groups)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(groups.max()) if len(groups) else 0):
        has = groups > k
        out[(ends - groups + k)[has]] = (value[has] >> 7 * k & 127) | np.where(groups[has] > k + 1, 128, 0)
    size = np.bincount(row, groups.reshape(-1, 2).sum(axis=1), rows).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, count) of rows with lists of what :func:`packed` gives, by row and token; what the items of a list share is summed."""
    items = lists.flatten()
    size = pc.binary_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(items.to_pylist()), np.uint8)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    begin = np.flatnonzero(np.concatenate([[True], data[:-1] < 128]))
    place = np.arange(len(data)) - np.repeat(begin, np.diff(begin, append=len(data)))
    value = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin)
    step, count = value[::2], value[1::2]
    # the item of each token, and its first token
    item = np.searchsorted(np.cumsum(size), begin[::2], "right")
    total = np.cumsum(step)
    first = np.concatenate([[True], item[1:] != item[:-1]])
    token = total - np.repeat((total - step)[first], np.diff(np.flatnonzero(first), append=len(item)))
    row = np.repeat(np.arange(len(lists)), lengths(lists))[item]
    if lengths(lists).max() <= 1:
        return row, token, count
    wide = int(token.max()) + 1
    key, at = np.unique(row * wide + token, return_inverse=True)
    return key // wide, key % wide, np.bincount(at, count, len(key)).astype(np.int64)


def pieces(work: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``CELLS`` cells and, unless it is one row, ``MATCHES`` matches."""
    done, start = np.concatenate([[0], np.cumsum(work)]), 0
    while start < len(work):
        stop = min(start + max(1, CELLS // max(width, 1)), int(np.searchsorted(done, done[start] + MATCHES, "right")) - 1, len(work))
        yield start, max(start + 1, stop)
        start = max(start + 1, stop)


def table(row: np.ndarray, item: np.ndarray, weights: np.ndarray | None, rows: int, width: int) -> np.ndarray:
    """Sums of weights, or counts, by row and query."""
    return np.bincount(row * width + item, weights, rows * width).reshape(rows, width)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def blocks(queries: pa.Table) -> Iterator[pa.Table]:
    for start in range(0, max(queries.num_rows, 1), BLOCK_QUERIES):
        yield queries.slice(start, BLOCK_QUERIES).combine_chunks()


def map_blocks(df: DataFrame, queries: pa.Table, build: Callable[[pa.Table], object], match: Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, together: bool = False) -> DataFrame:
    """``match`` of a task's batches of ``df`` with what ``build`` makes of a block of queries, or of each in a list if they are held ``together``; all blocks' rows together."""
    out = None
    for made in [[build(part) for part in blocks(queries)]] if together else map(build, blocks(queries)):
        shared = df.sparkSession.sparkContext.broadcast(made)
        found = df.mapInArrow(lambda batches, shared=shared: match(shared.value, parts(batches)), schema)
        out = found if out is None else out.unionByName(found)
    return out
