"""Stateful control of background work, with an injected clock: batch size, coalesced checkpoints, cache, request ids.

The states are small and per stream; ``batch_sizes`` and ``checkpoint_each`` bind them to a query.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Batch sizes, idle time and slice budget in milliseconds, growth rule.
SMALLEST, LARGEST, IDLE_MS, SLICE_MS, FAST_TO_GROW, STEP, FAST_SHARE = 4, 16, 2000, 150, 2, 2, 0.75
CHECKPOINT_CHANGES, CHECKPOINT_IDLE_MS = 64, 2000
MEMORY_LIMIT = 0.85
CACHED_QUERIES = 48


def clamp_size(value: float, low: int = SMALLEST, high: int = LARGEST) -> int:
    return low if not math.isfinite(value) else int(min(high, max(low, math.floor(value + 0.5))))


class Event(NamedTuple):
    """Something that happened at ``at``: ``active`` (the writer did something), ``ask`` (a batch is wanted, of ``most`` at most),
    ``done`` (``done`` of ``asked`` took ``took`` milliseconds) or ``failed``. ``pending``: a query waits; ``memory``: share in use."""

    kind: str
    at: float = 0.0
    asked: int = 0
    done: int = 0
    took: float = 0.0
    pending: bool = False
    memory: float = 0.0
    most: int = LARGEST


class Pace(NamedTuple):
    """Size of the next batch, the largest size known to be quick enough, quick slices in a row, and the writer's last activity."""

    size: int = SMALLEST
    learned: int = SMALLEST
    quick: int = 0
    active_at: float = 0.0


def held_back(pace: Pace, event: Event) -> bool:
    return event.pending or event.memory >= MEMORY_LIMIT or event.at - pace.active_at < IDLE_MS


#: What an event makes of the pace: the first row whose kind and condition hold. No row: it stays.
TRANSITIONS: tuple[tuple[str, Callable[[Pace, Event], bool], Callable[[Pace, Event], Pace]], ...] = (
    ("active", lambda p, e: math.isfinite(e.at), lambda p, e: Pace(learned=p.learned, active_at=e.at)),
    ("failed", lambda p, e: True, lambda p, e: Pace(active_at=p.active_at)),
    ("ask", held_back, lambda p, e: p._replace(size=SMALLEST, quick=0)),
    ("ask", lambda p, e: p.size < p.learned, lambda p, e: p._replace(size=min(LARGEST, p.learned, p.size + 2 * STEP))),
    ("done", held_back, lambda p, e: p._replace(size=SMALLEST, quick=0)),
    ("done", lambda p, e: e.took > SLICE_MS, lambda p, e: (lambda half: p._replace(size=half, learned=clamp_size(half), quick=0))(max(SMALLEST, min(p.size, e.asked) // 2))),
    ("done", lambda p, e: e.done < e.asked, lambda p, e: p._replace(quick=0)),
    ("done", lambda p, e: e.took > FAST_SHARE * SLICE_MS, lambda p, e: _known(p, e)._replace(quick=0)),
    ("done", lambda p, e: p.quick + 1 < FAST_TO_GROW, lambda p, e: _known(p, e)._replace(quick=p.quick + 1)),
    ("done", lambda p, e: True, lambda p, e: _known(p, e)._replace(quick=0, size=min(LARGEST, max(p.size, e.asked) + STEP))),
)


def _known(pace: Pace, event: Event) -> Pace:
    return pace._replace(learned=max(pace.learned, clamp_size(event.asked)))


def after(pace: Pace, event: Event) -> Pace:
    return next((then(pace, event) for kind, when, then in TRANSITIONS if kind == event.kind and when(pace, event)), pace)


def allowed(pace: Pace, event: Event) -> int:
    """The size that an ``ask`` gets, given the pace after it."""
    return min(pace.size, max(1, event.most))


def batch_sizes(events: DataFrame, start: Pace = Pace()) -> DataFrame:
    """(stream, at, position, kind, size) of every event of (stream, position, *Event fields), folded by stream in order of (at, position).

    A batch query sees each stream's events at once. A streaming query keeps the pace of each stream between its batches, and takes
    events in the order in which batches bring them.
    """
    names = [f for f in Event._fields]
    schema = "stream string, at double, position long, kind string, size int"

    def fold(key, rows: pd.DataFrame, pace: Pace) -> tuple[pd.DataFrame, Pace]:
        rows = rows.sort_values(["at", "position"], kind="stable")
        sizes = []
        for values in rows[names].itertuples(index=False):
            event = Event(*values)
            pace = after(pace, event)
            sizes.append(allowed(pace, event))
        return pd.DataFrame({"stream": key[0], "at": rows["at"], "position": rows["position"], "kind": rows["kind"], "size": pd.Series(sizes, index=rows.index, dtype="int32")}), pace

    grouped = events.select(F.col("stream").cast("string"), F.col("position").cast("long"), *names).groupBy("stream")
    if not events.isStreaming:
        return grouped.applyInPandas(lambda key, rows: fold(key, rows, start)[0], schema)

    def keep(key, parts, state):
        pace = Pace(*state.get) if state.exists else start
        rows, pace = fold(key, pd.concat(list(parts)), pace)
        state.update(tuple(pace))
        yield rows

    return grouped.applyInPandasWithState(keep, schema, "size int, learned int, quick int, active_at double", "append", "NoTimeout")


@dataclass
class Checkpoint:
    """Counts changes; tells how long to wait until they are written. A failed write keeps them."""

    pending: int = 0
    running: bool = False

    def dirty(self, changes: int = 1) -> int:
        if changes < 1:
            raise ValueError("a change count is positive")
        self.pending += changes
        return 0 if self.pending >= CHECKPOINT_CHANGES else CHECKPOINT_IDLE_MS

    def begin(self) -> bool:
        start = self.pending > 0 and not self.running
        self.running = self.running or start
        return start

    def end(self, written: bool) -> None:
        if not self.running:
            raise RuntimeError("no checkpoint is running")
        self.running = False
        if written:
            self.pending = 0


@dataclass
class Requests:
    """The newest request of each key counts; repeats of a scheduled, pending or finished one are dropped."""

    newest: dict[str, int] = field(default_factory=dict)
    keys: dict[str, object] = field(default_factory=dict)

    def schedule(self, who: str, key: object) -> int | None:
        if self.keys.get(who) == key:
            return None
        self.keys[who] = key
        self.newest[who] = self.newest.get(who, 0) + 1
        return self.newest[who]

    def accepts(self, who: str, number: int, key: object) -> bool:
        return self.newest.get(who) == number and self.keys.get(who) == key


class QueryCache:
    """Least recently used values, bounded."""

    def __init__(self, size: int = CACHED_QUERIES):
        self.size, self.values = size, OrderedDict()

    def get(self, key, make: Callable[[], object]):
        if key in self.values:
            self.values.move_to_end(key)
        else:
            self.values[key] = make()
            if len(self.values) > self.size:
                self.values.popitem(last=False)
        return self.values[key]


def checkpoint_each(write: Callable[[DataFrame, int], None], state: Checkpoint) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes once enough changes have come; the rest waits for the next batch."""
    waiting: list[DataFrame] = []

    def batch(df: DataFrame, number: int) -> None:
        n = df.count()
        if n:
            waiting.append(df.persist())
            due = state.dirty(n) == 0
            if due and state.begin():
                done = False
                try:
                    every = waiting[0]
                    for more in waiting[1:]:
                        every = every.unionByName(more)
                    write(every, number)
                    done = True
                finally:
                    state.end(done)
                    if done:
                        for x in waiting:
                            x.unpersist()
                        waiting.clear()

    return batch
