"""Event-time operators on change events, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """The last event of each burst: events of a key less than ``gap`` apart are one. With a watermark, also on streams."""
    x = events.withWatermark("ts", watermark) if watermark else events
    return x.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n_events"), F.max(F.struct("ts", "event_id")).alias("x")).select(key, "n_events", F.col("x.event_id").alias("last_event"), F.col("x.ts").alias("last_ts"))


def without_repeats(events: DataFrame, key: str, value: str) -> DataFrame:
    """Events whose value differs from the one before of the same key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")


def without_repeats_stream(events: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def latest(events: DataFrame, key: str) -> DataFrame:
    """The newest event of each key; whatever finishes for an older one is stale."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id")).alias("x")).select(key, F.col("x.event_id").alias("event_id"), F.col("x.ts").alias("ts"))


def outside_suppression(events: DataFrame, key: str, marker: str, seconds: float) -> DataFrame:
    """Events that do not follow a marker event of their key within ``seconds``; the latest marker before an event decides."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    last = F.max(F.when(F.col("event_type") == marker, micros)).over(Window.partitionBy(key).orderBy(micros).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("_m", last).where((F.col("event_type") != marker) & (F.col("_m").isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_m") >= int(seconds * 1e6)))).drop("_m")


def gaps(events: DataFrame, key: str, expected_ms: int = 250, long_ms: int = 50) -> DataFrame:
    """Delay of each event against the expected tick after the one before, in ms, and whether it is a long one."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    delay = F.greatest(F.lit(0.0), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000.0 - expected_ms)
    delay = F.when(before.isNotNull(), delay)
    return events.select(key, "event_id", delay.alias("delay_ms")).where("delay_ms is not null").withColumn("long_task", F.col("delay_ms") >= long_ms)


def fresh_results(results: DataFrame) -> DataFrame:
    """Results that may still be shown: of a live view and request, the newest request of its view, for the key that was asked last and
    is asked now, awaited and not suppressed.

    results: disposed, aborted, request, latest_request, key, latest_key, current_key, pending, suppressed. A null decides against the result.
    """
    ok = ~F.col("disposed") & ~F.col("aborted") & (F.col("request") == F.col("latest_request")) & (F.col("key") == F.col("latest_key")) & (F.col("key") == F.col("current_key")) & F.col("pending") & ~F.col("suppressed")
    return results.where(F.coalesce(ok, F.lit(False)))


def scope_rebuilds(settings: DataFrame, key: str, gap: str = "500 milliseconds", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, ts) of the rebuilds that changes of scope cause: only a new fingerprint counts, and one rebuild follows the last of a quick run of them.

    settings: key, ts, event_id, fingerprint.
    """
    w = Window.partitionBy(key).orderBy(ts, order)
    changed = settings.withColumn("__was", F.lag("fingerprint").over(w)).where(~F.col("__was").eqNullSafe(F.col("fingerprint")))
    following = F.lead(ts).over(w)
    return changed.withColumn("__next", following).where(F.col("__next").isNull() | (F.col("__next") >= F.col(ts) + F.expr(f"INTERVAL {gap}"))).select(key, ts)


def outside_composition(events: DataFrame, key: str, kind: str, begins: str, ends: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events that no composition encloses: the latest begin or end before them is an end, or there is none."""
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col(kind).isin(begins, ends), F.col(kind))
    return events.withColumn("__turn", F.last(turn, ignorenulls=True).over(w)).where(~F.coalesce(F.col("__turn") == begins, F.lit(False)) & ~F.col(kind).isin(begins, ends)).drop("__turn")


def serial_queue(tasks: DataFrame, queue: str, arrival: str, took: str, order: list[str]) -> DataFrame:
    """``tasks`` with started and ended if each queue works on one at a time, in ``order``.

    The end of a task is the largest, over the tasks j up to it, of arrival(j) plus the work from j on; with running sums S of the
    work that is S(i) + max(arrival(j) - S(j - 1)).
    """
    w = Window.partitionBy(queue).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = tasks.withColumn("__s", F.sum(took).over(w))
    ended = F.col("__s") + F.max(F.col(arrival) - F.col("__s") + F.col(took)).over(w)
    return summed.withColumn("ended", ended).withColumn("started", F.col("ended") - F.col(took)).drop("__s")


def matching_policy(lexical: Column, semantic: Column) -> Column:
    """What a request runs: both, one alone, or nothing."""
    return F.when(lexical & semantic, "hybrid").when(lexical, "lexical").when(semantic, "semantic").otherwise("none")


def selected(index: Column, by: Column, n: Column) -> Column:
    """The entry of a list of ``n`` that is selected after moving ``by`` places, around its ends; null for an empty list."""
    return F.when(n > 0, F.pmod(index + by, n))


def latest_by_id(events: DataFrame, key: str, order: str = "event_id") -> DataFrame:
    """The whole row of each key's newest event, by its number."""
    rest = [c for c in events.columns if c not in (key, order)]
    return events.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, "x.*")


def acceptance(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """``asked`` with code: what an accepted suggestion meets when it is to be inserted.

    asked: text, anchor_start, anchor_end, expected, target_path; notes: target_path of notes that exist and are not excluded. The first
    fault is told: invalid-range, changed-anchor, target-not-found; else ok. Markup around the anchor is told by the writing contexts.
    """
    start, end = F.col("anchor_start"), F.col("anchor_end")
    valid = (start >= 0) & (end > start) & (end <= F.char_length("text"))
    same = F.substr(F.col("text"), start + 1, end - start) == F.col("expected")
    out = asked.join(notes.select("target_path").distinct().withColumn("__there", F.lit(True)), "target_path", "left")
    code = F.when(~F.coalesce(valid, F.lit(False)), "invalid-range").when(~F.coalesce(same, F.lit(False)), "changed-anchor").when(F.col("target_path").isNotNull() & F.col("__there").isNull(), "target-not-found").otherwise("ok")
    return out.withColumn("code", code).drop("__there")
