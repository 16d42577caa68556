"""Relevance of rankings: recall, reciprocal rank, nDCG, and reports by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrank.functions import text as T


def case_metrics(cases: DataFrame, ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """``cases`` with the metrics of each case.

    cases: case_id and any grouping columns, exact_target and category if :func:`report` is to tell their rates; ranking: case_id, target, rank from 1;
    relevant: case_id, target, gain. A case without relevant targets, or without a ranking, has zeros.
    """
    ideal_rank = F.expr("row_number() OVER (PARTITION BY case_id ORDER BY gain DESC)")
    ideal = relevant.withColumn("i", ideal_rank).where("i <= 5").groupBy("case_id").agg(F.sum(F.col("gain") / F.log2(F.col("i") + 1)).alias("ideal"))
    total = relevant.groupBy("case_id").agg(F.countDistinct("target").alias("relevant"))
    marked = ranking.join(relevant.groupBy("case_id", "target").agg(F.max("gain").alias("gain")), ["case_id", "target"], "left")
    hit = F.col("gain").isNotNull()
    per = marked.groupBy("case_id").agg(
        F.countDistinct(F.when(hit & (F.col("rank") <= 5), F.col("target"))).alias("hits_5"),
        F.countDistinct(F.when(hit & (F.col("rank") <= 10), F.col("target"))).alias("hits_10"),
        F.min(F.when(hit & (F.col("rank") <= 5), F.col("rank"))).alias("first"),
        F.sum(F.when(hit & (F.col("rank") <= 5), F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(~hit & (F.col("rank") <= 5), 1).otherwise(0)).alias("wrong"),
        F.sum(F.when(F.col("rank") <= 5, 1).otherwise(0)).alias("shown"),
        F.max(F.when(F.col("rank") == 1, F.col("target"))).alias("top"),
    )
    x = cases.join(total, "case_id", "left").join(ideal, "case_id", "left").join(per, "case_id", "left")
    of = lambda name: F.coalesce(F.col(name), F.lit(0))
    share = lambda part, whole: F.when(of(whole) == 0, 0.0).otherwise(of(part) / F.col(whole))
    out = x.select(*cases.columns, share("hits_5", "relevant").alias("r5"), share("hits_10", "relevant").alias("r10"), F.when(F.col("first").isNull(), 0.0).otherwise(1.0 / F.col("first")).alias("rr"), share("dcg", "ideal").alias("ndcg"), of("wrong").alias("wrong"), of("shown").alias("shown"), "top")
    return out


def counted_metrics(cases: DataFrame, hits: DataFrame, counts: DataFrame) -> DataFrame:
    """:func:`case_metrics` of equal gains, without a row for each relevant target.

    hits: case_id, target, rank from 1, relevant (boolean), each target once a case; counts: case_id, relevant (how many targets would be right).
    """
    good = F.col("relevant") & (F.col("rank") <= 5)
    discount = 1.0 / F.log2(F.col("rank") + 1)
    per = hits.groupBy("case_id").agg(
        F.count(F.when(good, 1)).alias("hits_5"), F.count(F.when(F.col("relevant") & (F.col("rank") <= 10), 1)).alias("hits_10"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(F.when(good, discount).otherwise(0.0)).alias("dcg"),
        F.count(F.when(~F.col("relevant") & (F.col("rank") <= 5), 1)).alias("wrong"), F.count(F.when(F.col("rank") <= 5, 1)).alias("shown"), F.max(F.when(F.col("rank") == 1, F.col("target"))).alias("top"),
    )
    x = cases.join(counts.select("case_id", F.col("relevant").alias("__n")), "case_id", "left").join(per, "case_id", "left")
    n = F.coalesce("__n", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(0.0), lambda acc, i: acc + F.when(i <= n, 1.0 / F.log2(i + 1)).otherwise(0.0))
    share = lambda part, whole: F.when(whole > 0, F.coalesce(part, F.lit(0)) / whole).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select(*cases.columns, share(F.col("hits_5"), n).alias("r5"), share(F.col("hits_10"), n).alias("r10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), share(F.col("dcg"), ideal).alias("ndcg"), zero("wrong").alias("wrong"), zero("shown").alias("shown"), "top")


def report(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Macro means in total and by each grouping column: (scope, name, cases, recall_5, recall_10, mrr_5, ndcg_5, exact_rate, semantic_rate, irrelevant_rate).

    exact_rate: of cases with an exact target, those that have it first; semantic_rate: of the category semantic-only, those with a
    relevant target among five; both are 1 without such cases. The rate of irrelevant suggestions is pooled over all suggestions. Figures have four digits.
    """
    has = lambda c: F.col(c) if c in metrics.columns else F.lit(None).cast("string")
    exact, semantic = has("exact_target").isNotNull(), has("category") == "semantic-only"
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    rate = lambda part, whole, none: F.coalesce(F.try_divide(part, whole), F.lit(none))
    figures = {
        "recall_5": F.avg("r5"), "recall_10": F.avg("r10"), "mrr_5": F.avg("rr"), "ndcg_5": F.avg("ndcg"),
        "exact_rate": rate(count(exact & (F.col("top") == has("exact_target"))), count(exact), 1.0),
        "semantic_rate": rate(count(semantic & (F.col("r5") > 0)), count(semantic), 1.0),
        "irrelevant_rate": rate(F.sum("wrong"), F.sum("shown"), 0.0),
    }
    keys = [F.col(c) for c in by]
    told = F.lit("total")
    name = F.lit("")
    for c in by:
        told = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(told)
        name = F.when(F.grouping(c) == 0, F.col(c).cast("string")).otherwise(name)
    sums = metrics.groupingSets([[], *[[k] for k in keys]], *keys).agg(told.alias("scope"), name.alias("name"), F.count("*").alias("cases"), *[f.alias(k) for k, f in figures.items()])
    return sums.select("scope", "name", "cases", *[T.round_half_up(F.col(c), 4).alias(c) for c in figures])
