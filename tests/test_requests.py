"""Request control and vector texts on known cases."""

import numpy as np
from pyspark.sql import functions as F

from linkrank.functions import codec
from linkrank.streaming import events as E


def test_fresh_results(spark):
    good = (False, False, 2, 2, "k", "k", "k", True, False)
    rows = [good] + [good[:i] + (bad,) + good[i + 1 :] for i, bad in enumerate((True, True, 1, 3, "o", "o", "o", False, True))] + [good[:4] + (None,) + good[5:]]
    schema = "disposed boolean, aborted boolean, request int, latest_request int, key string, latest_key string, current_key string, pending boolean, suppressed boolean"
    assert E.fresh_results(spark.createDataFrame(rows, schema)).count() == 1


def test_scope_and_composition(spark):
    at = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    rows = [("u", i, at(s), f) for i, (s, f) in enumerate([(0, "a"), (0.2, "b"), (0.4, "b"), (0.6, "c"), (2, "c"), (5, "d")])]
    settings = spark.createDataFrame(rows, "user string, event_id int, ts string, fingerprint string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [str(r["ts"])[17:21] for r in E.scope_rebuilds(settings, "user").orderBy("ts").collect()] == ["00.6", "05"]
    typed = spark.createDataFrame([("u", i, i, k) for i, k in enumerate(["x", "begin", "x", "end", "x", "begin"])], "user string, event_id int, ts int, kind string")
    assert [r["event_id"] for r in E.outside_composition(typed, "user", "kind", "begin", "end").orderBy("event_id").collect()] == [0, 4]


def test_serial_queue(spark):
    rng = np.random.default_rng(5)
    rows, end, want = [], 0, {}
    for i, (arrival, took) in enumerate(zip(np.cumsum(rng.integers(0, 9, 60)).tolist(), rng.integers(1, 9, 60).tolist())):
        rows.append(("q", i, arrival, took))
        begin = max(end, arrival)
        end = begin + took
        want[i] = (begin, end)
    got = E.serial_queue(spark.createDataFrame(rows, "q string, i int, arrival long, took long"), "q", "arrival", "took", ["i"]).collect()
    assert {r["i"]: (r["started"], r["ended"]) for r in got} == want


def test_policy_selection_acceptance(spark):
    row = spark.range(1).select(E.matching_policy(F.lit(True), F.lit(False)).alias("p"), E.selected(F.lit(0), F.lit(-1), F.lit(4)).alias("up"), E.selected(F.lit(3), F.lit(1), F.lit(4)).alias("down"), E.selected(F.lit(0), F.lit(1), F.lit(0)).alias("none")).first()
    assert tuple(row) == ("lexical", 3, 0, None)
    asked = [(1, "some text", 5, 9, "text", "t"), (2, "some text", 5, 10, "text", "t"), (3, "some", -1, 2, "x", "t"), (4, "some text", 0, 4, "text", "t"), (5, "some text", 5, 9, "text", "gone"), (6, None, 0, 1, "x", "t")]
    table = spark.createDataFrame(asked, "id int, text string, anchor_start int, anchor_end int, expected string, target_path string")
    codes = {r["id"]: r["code"] for r in E.acceptance(table, spark.createDataFrame([("t",)], "target_path string")).collect()}
    assert codes == {1: "ok", 2: "invalid-range", 3: "invalid-range", 4: "changed-anchor", 5: "target-not-found", 6: "invalid-range"}


def test_vector_texts(spark):
    rows = [(1, [1.5, -2.25]), (2, []), (3, None), (4, [float("nan")] + [0.0] * 40), (5, [0.0] * 20 + [float("inf")] + [0.0] * 20)]
    x = spark.createDataFrame(rows, "id int, v array<float>").withColumn("t", codec.encode_vector(F.col("v")))
    got = {r["id"]: r for r in x.select("id", "v", "t", codec.decode_vector(F.col("t")).alias("back"), codec.sound(F.col("t")).alias("ok"), codec.finite_sample(F.col("v")).alias("f")).collect()}
    assert got[1]["back"] == [1.5, -2.25] and got[1]["t"] == "AADAPwAAEMA=" and got[2]["back"] == [] and got[3]["back"] is None
    assert [got[i]["ok"] for i in (1, 2, 3)] == [True, True, False] and not got[4]["f"] and got[1]["f"] and got[2]["f"]
    bad = spark.createDataFrame([("AAA=",), ("%%",)], "t string").select(codec.sound(F.col("t")).alias("ok")).collect()
    assert [r["ok"] for r in bad] == [False, False]
