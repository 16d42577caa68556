"""Diagnostics of a run: measurements that count, a report of distributions, counters and gauges, and its budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrank.functions import text as T
from linkrank.operators import planner

SCHEMA_VERSION = 1
# Names of metrics, and the most that a figure of a report may be.
NAME = "^[a-z][a-z0-9_.-]*$"
BUDGETS = {
    "warmQueryP95Ms": 200.0,
    "eventLoopDelayP95Ms": 16.0,
    "longTaskMs": 50.0,
    "backgroundSliceP95Ms": 100.0,
    "checkpointP95Ms": 250.0,
    "modelAndIndexMemoryMb": 512.0,
}


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME), F.lit(False))


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def recorded(samples: DataFrame) -> DataFrame:
    """Samples (metric, value, ...) that a session keeps: of a valid name, finite and not negative."""
    return samples.where(valid_name(F.col("metric")) & finite(F.col("value")) & (F.col("value") >= 0))


def bounded(samples: DataFrame, keep: int = planner.KEPT_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """The latest samples of each metric, and (metric, evicted): how many gave way."""
    counts = samples.groupBy("metric").agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("evicted"))
    return planner.recent_samples(samples, keep), counts


def memory_gauges(usage: DataFrame) -> DataFrame:
    """(metric, value) of memory readings (label, one column for each kind, in bytes); kinds without a sound reading are left out."""
    kinds = [c for c in usage.columns if c != "label"]
    rows = usage.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("double").alias("value")) for c in kinds])).alias("x"))
    named = rows.select(F.concat(F.lit("memory."), "label", F.lit("."), "x.kind", F.lit("_bytes")).alias("metric"), "x.value")
    return named.where(finite(F.col("value")) & (F.col("value") >= 0))


def report(samples: DataFrame, counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """One JSON row: distributions, counters and gauges by metric in order, rounded to three digits, and the budgets.

    samples: metric, value; counters and gauges: metric, value. There is one entry for each metric, of which there are few; the samples
    themselves are aggregated first.
    """
    shape = ("count", "min", "max", "mean", "p50", "p95", "p99")
    entry = lambda part, value: F.struct(F.lit(part).alias("part"), F.col("metric"), value.alias("json"))
    rounded = T.round_half_up(F.col("value"), 3)
    spread = planner.distribution(samples).select(entry("samples", F.to_json(F.struct(*shape))).alias("x"))
    single = lambda df, part: df.select(entry(part, rounded.cast("string")).alias("x"))
    every = spread.unionByName(single(counters, "counters")).unionByName(single(gauges, "gauges"))
    member = lambda e: F.concat(F.lit('"'), e["metric"], F.lit('":'), e["json"])
    gathered = every.agg(F.array_sort(F.collect_list("x")).alias("xs"))
    part = lambda name: F.concat(F.lit(f'"{name}":{{'), F.array_join(F.transform(F.filter("xs", lambda e: e["part"] == name), member), ","), F.lit("}"))
    budgets = ",".join(f'"{k}":{v:g}' for k, v in BUDGETS.items())
    return gathered.select(F.concat(F.lit(f'{{"schemaVersion":{SCHEMA_VERSION},'), part("samples"), F.lit(","), part("counters"), F.lit(","), part("gauges"), F.lit(f',"budgets":{{{budgets}}}}}')).alias("report"))


def over_budget(distributions: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(metric, p95, budget) of metrics whose p95 exceeds its limit."""
    budget = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("metric")]
    return distributions.select("metric", "p95", budget.alias("budget")).where(F.col("p95") > F.col("budget"))
