"""Vector search, fusion, relevance, planning, tuning and telemetry on known cases."""

import math

import pytest
from pyspark.sql import functions as F

from linkrank.operators import hybrid, incremental, planner, relevance, vectors


def test_vector_top_k(spark):
    v = spark.createDataFrame([(1, [0.1, 0.9]), (2, [0.9, 0.1]), (3, [0.5, 0.5]), (4, [1.0]), (5, None)], "chunk_id long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    got = vectors.top_k(v, q, k=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 3] and got[0]["rank"] == 1
    assert vectors.top_k(v, q.where("false")).count() == 0
    one = spark.range(1).select(vectors.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("x"), vectors.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), vectors.finite(F.array(F.lit(float("nan")))).alias("f")).first()
    assert one["x"] == -math.inf and one["u"] == [0.6, 0.8] and one["f"] is False
    passages = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "chunk_id long, document string")
    best = vectors.best_of_groups(vectors.top_k(v, q), passages, ["document"]).orderBy("rank").collect()
    assert [(r["document"], r["chunk_id"]) for r in best] == [("A", 2), ("B", 3)]


LEXICAL = "query_id long, target_path string, target_title string, target_heading string, score double, match_kinds array<string>, preview string"
SEMANTIC = "query_id long, target_path string, target_title string, target_heading string, similarity double, preview string, rank int"


def test_fusion(spark):
    hit = [(1, "Water.md", "Water", None, 0.9, "s", 1)]
    only = hybrid.fuse(spark.createDataFrame([], LEXICAL), spark.createDataFrame(hit, SEMANTIC)).first()
    assert only["score"] == pytest.approx(0.7) and only["match_kinds"] == ["semantic"]
    both = hybrid.fuse(spark.createDataFrame([(1, "Water.md", "Water", None, 0.7, ["title"], "l")], LEXICAL), spark.createDataFrame(hit, SEMANTIC)).collect()
    assert len(both) == 1 and both[0]["score"] == 1.0 and both[0]["match_kinds"] == ["title", "semantic"] and both[0]["preview"] == "s"
    apart = hybrid.fuse(spark.createDataFrame([(1, "Water.md", "Water", "Sea", 0.8, ["heading"], "l")], LEXICAL), spark.createDataFrame(hit + [(1, "Z.md", "Z", None, 0.1, "", 2)], SEMANTIC)).orderBy("rank").collect()
    assert [(r["target_path"], r["target_heading"]) for r in apart] == [("Water.md", None), ("Water.md", "Sea"), ("Z.md", None)] or apart[0]["score"] >= apart[1]["score"]
    assert apart[-1]["score"] == 0.0


def test_relevance(spark):
    cases = spark.createDataFrame([(1, "semantic-only", "ar"), (2, "alias", "en")], "case_id long, category string, language string")
    ranking = spark.createDataFrame([(1, t, i) for i, t in enumerate(["irrelevant", "target", "other"], 1)] + [(2, "x", 1)], "case_id long, target string, rank int")
    relevant = spark.createDataFrame([(1, "target", 1.0), (2, "x", 1.0)], "case_id long, target string, gain double")
    m = {r["case_id"]: r for r in relevance.case_metrics(cases, ranking, relevant).collect()}
    assert (m[1]["r5"], m[1]["rr"]) == (1.0, 0.5) and m[1]["ndcg"] == pytest.approx(1 / math.log2(3))
    total = {(r["scope"], r["name"]): r for r in relevance.report(relevance.case_metrics(cases, ranking, relevant), ["category", "language"]).collect()}
    assert total["total", ""]["cases"] == 2 and total["total", ""]["mrr_5"] == 0.75 and total["language", "ar"]["cases"] == 1


def test_batches_and_telemetry(spark):
    x = spark.createDataFrame([("long-a", 100, 0), ("short-a", 4, 1), ("medium", 90, 2), ("short-b", 6, 3)], "id string, tokens long, position long")
    plan = planner.batch_plan(x, 16, 2)
    got = {}
    for r in plan.orderBy("bucket", "batch", "tokens").collect():
        got.setdefault((r["bucket"], r["batch"]), []).append(r["id"])
    assert list(got.values()) == [["short-a", "short-b"], ["medium"], ["long-a"]]
    first = planner.batch_stats(plan).orderBy("bucket").first()
    assert (first["total_tokens"], first["padded_tokens"]) == (10, 12)
    d = planner.distribution(spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4, 100)], "metric string, value double")).first()
    assert (d["count"], d["min"], d["max"], d["mean"], d["p50"], d["p95"], d["p99"]) == (5, 1, 100, 22, 3, 100, 100)
    recent = planner.recent_samples(spark.createDataFrame([("m", i, i, float(i)) for i in range(5)], "metric string, id long, ts long, value double"), 2)
    assert {r["id"] for r in recent.collect()} == {3, 4}


def test_tuning(spark):
    def pick(times):
        rows = [(t, kind, float(ms)) for t, ms in times for kind in ("query", "batch") for _ in range(3)]
        return planner.tuning_selection(planner.tuning_summary(spark.createDataFrame(rows, "threads int, kind string, ms double"))).first()

    assert pick([(0, 100), (2, 90), (4, 80)])[:] == (4, "improved")
    assert pick([(0, 100), (2, 99)])[:] == (0, "automatic-within-noise")
    assert pick([(0, 100), (2, 200)])[:] == (0, "inconclusive") and pick([(2, 50)])[:] == (0, "inconclusive")


def test_snapshots(spark):
    rows = "row int, document int, vector array<float>"
    frame = lambda x: spark.createDataFrame(x, rows)
    a, b, free = (0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, -1, [0.0, 0.0])
    for before, after, ups, gone in (([a], [a, b], 1, 0), ([a, b], [a, (1, 2, [0.5, 0.5])], 1, 0), ([a, b], [a, free], 0, 1), ([a, b], [a, b], 0, 0), ([a], [a, free, (2, 3, [0.0, 1.0])], 1, 0)):
        diff = incremental.snapshot_diff(frame(before), frame(after))
        ops = [r["op"] for r in diff.collect()]
        assert (ops.count("upsert"), ops.count("remove")) == (ups, gone)
        live = {r["row"]: r["document"] for r in incremental.snapshot_patch(frame(before), diff).collect()}
        assert live == {r: d for r, d, _ in after if d >= 0}


def test_dense_rows_of_sampled_ranges(spark):
    # more rows than a sample of the ranges holds, and a column that only the numbered side reads
    x = spark.range(0, 20000, 1, 2).select((F.col("id") * 7919 % 20000).alias("k"), F.col("id").cast("string").alias("more"))
    got = incremental.dense_rows(x, ["k"], partitions=4).collect()
    assert len(got) == 20000 and all(r["row"] == r["k"] for r in got)
    down = incremental.dense_rows(x.unionByName(spark.sql("select cast(null as long) k, 'none' more")), [F.col("k").desc_nulls_last()], partitions=4).collect()
    assert all(r["row"] == (20000 if r["k"] is None else 19999 - r["k"]) for r in down)


def test_dense_rows_and_scope(spark):
    got = incremental.dense_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], partitions=7).collect()
    assert all(r["row"] == r["k"] for r in got)
    notes = spark.createDataFrame([("A/b.md", ["#X"]), ("a/c/d.md", []), ("ab.md", ["x/y"]), ("E.md", [])], "path string, tags array<string>")
    out = {r["path"] for r in notes.where(incremental.excluded(notes, ["e.md"], ["A\\c", ""], ["x"])).collect()}
    assert out == {"A/b.md", "a/c/d.md", "E.md"}
    props = spark.createDataFrame([(1, {"Status": ["Draft"]}), (2, {"x": []}), (3, None)], "id int, p map<string, array<string>>")
    assert [r["id"] for r in props.where(incremental.property_excluded(F.col("p"), ["status = draft"])).collect()] == [1]
    assert [r["id"] for r in props.where(incremental.property_excluded(F.col("p"), ["X"])).collect()] == [2]
