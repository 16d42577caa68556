"""Links, index upkeep, files, log, diagnostics, evaluation."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrank.functions import hashing
from linkrank.operators import diagnostics, evaluation, links, planner, relevance, upkeep, vectors
from linkrank.sources import files, snapshot


def test_links(spark):
    notes = spark.createDataFrame([("a/One.md", ["Part", "# Two "]), ("b/one.md", []), ("b/c/Deep.md", ["x"]), ("top.md", [])], "path string, headings array<string>")
    asked = [("b/x.md", "one"), ("a/x.md", "One#Part|shown"), ("z.md", "ONE.md"), ("z.md", "b/c/deep"), ("z.md", "/top.md"), ("z.md", "none"), ("z.md", "c/deep"), ("z.md", "#here"), ("z.md", None)]
    got = {(r["source_path"], r["link"]): r["target_path"] for r in links.resolve(spark.createDataFrame(asked, "source_path string, link string"), notes).collect()}
    assert list(got[a] for a in asked) == ["b/one.md", "a/One.md", "a/One.md", "b/c/Deep.md", "top.md", None, None, None, None]
    named = spark.createDataFrame([(1, "a/One.md", "part"), (2, "a/One.md", "## Two"), (3, "a/One.md", None), (4, "gone.md", None), (5, "b/one.md", "Part"), (6, "a/One.md", "Part")], "id int, target_path string, heading string")
    assert {r["id"]: r["found"] for r in links.with_heading(named, notes).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True}
    row = spark.range(1).select(links.link_heading(F.lit("n#Part|s")).alias("h"), links.link_heading(F.lit("n|s")).alias("n")).first()
    assert (row["h"], row["n"]) == ("Part", None)


@pytest.fixture
def index(spark):
    documents = spark.createDataFrame([("a", "A", ["a1", "a2"]), ("b", "B", ["b1"]), ("c", "C", [])], "path string, id string, chunk_ids array<string>")
    chunks = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B")], "id string, document_id string")
    return upkeep.Index(documents, chunks, spark.createDataFrame([("a1", [1.0]), ("b1", [2.0])], "chunk_id string, vector array<float>"))


def keys(index):
    return tuple(sorted(r[0] for r in df.select(c).collect()) for df, c in zip(index, ("path", "id", "chunk_id")))


def test_upkeep(spark, index):
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    assert keys(upkeep.remove(index, paths("a", "z"))) == (["b", "c"], ["b1"], ["b1"])
    # the same path with another id, and another path with an id that is in use
    fresh = spark.createDataFrame([("a", "A2", ["a1", "n"]), ("d", "B", ["d1"])], index.documents.schema)
    new = upkeep.replace(index, fresh, spark.createDataFrame([("a1", "A2"), ("n", "A2"), ("d1", "B")], index.chunks.schema))
    assert keys(new) == (["a", "c", "d"], ["a1", "d1", "n"], ["a1"])
    assert [r["id"] for r in upkeep.missing(new.chunks, new.vectors).orderBy("id").collect()] == ["d1", "n"]
    rows = {r["path"]: r for r in upkeep.delta(paths("a", "gone", "c"), index).collect()}
    assert rows["gone"]["op"] == "remove" and rows["c"]["chunks"] == [] and [(c["chunk_id"], c["vector"]) for c in rows["a"]["chunks"]] == [("a1", [1.0]), ("a2", None)]
    held = spark.createDataFrame([("a", "A", 5), ("b", "B", 6)], "path string, id string, modified_at long")
    moved = upkeep.rename(held, spark.createDataFrame([("a", "b"), ("z", "y")], "old_path string, new_path string"))
    assert [tuple(r) for r in moved.collect()] == [("b", "A", -1)]
    live = spark.createDataFrame([("a", 5), ("b", 7), ("n", 1), ("x", 1)], "path string, modified_at long")
    got = upkeep.affected_paths(held.unionByName(spark.createDataFrame([("g", "G", 1)], held.schema)), live, F.col("path") == "x", paths("a", "b"))
    assert {r["path"]: r["cause"] for r in got.collect()} == {"a": "embedded", "b": "changed", "n": "changed", "x": "excluded", "g": "deleted"}


def test_model_outputs(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("",), ("e",), ("f",)], "id string")
    given = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("",  [1.0, 2.0]), ("d", [1.0, 2.0]), ("e", [1.0]), ("f", [1.0, float("nan")])], "id string, vector array<double>")
    assert {r["id"]: r["problem"] for r in upkeep.output_mismatches(asked, given, 2).collect()} == {"b": "repeated input", "c": "omitted", "": "empty id", "d": "unexpected", "e": "wrong dimensions", "f": "not finite"}
    current = upkeep.current_vectors(spark.createDataFrame([(1, "r", 2), (2, "s", 2), (3, None, 2)], "id int, revision string, dimensions int"), {"revision": "r", "dimensions": 2})
    assert [r["id"] for r in current.collect()] == [1]


def test_orders(spark):
    names = spark.createDataFrame([("é",), ("B",), ("a",), ("b",), ("f",)], "x string")
    assert [r["x"] for r in names.orderBy(*upkeep.collated(names, "x")).collect()] == ["a", "b", "B", "é", "f"]
    waiting = spark.createDataFrame([("l", 1, 0), ("l", 0, 2), ("l", 0, 1)], "lane string, priority int, position int")
    assert [(r["priority"], r["position"]) for r in upkeep.served_order(waiting).orderBy("served").collect()] == [(0, 1), (0, 2), (1, 0)]


def test_many_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [1.0]), (61, None)], "chunk_id long, vector array<float>")
    q = v.withColumnRenamed("chunk_id", "query_id")
    whole = {tuple(r) for r in vectors.top_k(v, q, 3, exclude_self=True).collect()}
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 8 * 11)
    assert {tuple(r) for r in vectors.top_k(v, q, 3, exclude_self=True).collect()} == whole and len(whole) == 180


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text('---\ntitle: "The A"\naliases: [x, "y"]\ntags:\n  - one\n  - "#two"\nstatus: Done\n---\n# Head ##\ntext #three\n```\n# no\n#four\n```\n')
    (tmp_path / "sub" / "B.MD").write_text("plain")
    (tmp_path / "sub" / "skip.md").write_text("x")
    (tmp_path / "c.txt").write_text("no note")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xff")
    got = {r["path"]: r for r in files.read_notes(spark, str(tmp_path), files=["sub/skip.md"]).collect()}
    assert set(got) == {"a.md", "sub/B.MD", "bad.md"} and not got["bad.md"]["readable"] and got["sub/B.MD"]["title"] == "B"
    a = got["a.md"]
    assert (a["title"], a["aliases"], a["tags"], a["headings"]) == ("The A", ["x", "y"], ["one", "three", "two"], ["Head"]) and a["body"].startswith("# Head")
    assert {r["path"] for r in files.read_notes(spark, str(tmp_path), folders=["SUB"], tags=["two"]).collect()} == {"bad.md"}
    assert "a.md" not in {r["path"] for r in files.read_notes(spark, str(tmp_path), rules=["status=done"]).collect()}


def test_log_folder(spark, tmp_path):
    root, who = str(tmp_path / "log"), {"model": "m", "generation": 1}
    change = lambda *gone: {"removals": list(gone), "upserts": []}
    assert snapshot.append_log(spark, root, who, 0, change()) == 0 and snapshot.log_identity(spark, root) is None
    assert [snapshot.append_log(spark, root, who, 0, change(x)) for x in "abc"] == [1, 2, 3]
    records, dropped = snapshot.open_log(spark, root, who)
    assert (records.count(), dropped) == (3, 0)
    path = tmp_path / "log" / "record-00000002.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | {"checksum": "0"}))
    (tmp_path / "log" / ".record-00000002.json.crc").unlink(missing_ok=True)
    records, dropped = snapshot.open_log(spark, root, who)
    assert ([r["sequence"] for r in records.collect()], dropped) == ([1], 2) and snapshot.append_log(spark, root, who, 0, change("d")) == 2
    assert snapshot.open_log(spark, root, {"model": "other"})[0].count() == 0 and snapshot.log_identity(spark, root) is None


def test_diagnostics(spark):
    samples = spark.createDataFrame([("b.ms", 1.0), ("a.ms", 2.0), ("a.ms", 4.0), ("Bad", 1.0), ("a.ms", -1.0), ("a.ms", float("nan"))], "metric string, value double")
    kept = diagnostics.recorded(samples)
    assert kept.count() == 3
    one = spark.createDataFrame([("n", 2.0)], "metric string, value double")
    report = json.loads(diagnostics.report(kept, one, one.withColumn("value", F.lit(1.23456))).first()["report"])
    assert list(report["samples"]) == ["a.ms", "b.ms"] and report["samples"]["a.ms"]["mean"] == 3.0 and report["counters"] == {"n": 2.0} and report["gauges"] == {"n": 1.235} and report["budgets"]["longTaskMs"] == 50
    usage = spark.createDataFrame([("start", 5.0, -1.0), ("stop", None, 2.0)], "label string, used double, total double")
    assert {r["metric"]: r["value"] for r in diagnostics.memory_gauges(usage).collect()} == {"memory.start.used_bytes": 5.0, "memory.stop.total_bytes": 2.0}


def test_devices_and_requests(spark):
    cores = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.9,), (4.0,), (16.0,)], "c double").select("c", planner.device_class(F.col("c")).alias("d"), planner.thread_candidates(F.col("c")).alias("t"))
    assert [(r["d"], r["t"]) for r in cores.collect()] == [("unknown", [0, 1])] * 2 + [("1-2", [0, 1]), ("3-4", [0, 1, 2]), ("3-4", [0, 1, 2, 4]), ("9+", [0, 1, 2, 4])]
    parts = dict(file_path=F.lit('a"b.md'), document_version=F.lit(1), anchor_start=F.lit(2), anchor_end=F.lit(4), anchor_text=F.lit("😀"), context_hash=F.lit("h"), mode=F.lit("manual"))
    row = spark.range(1).select(hashing.request_key(**parts).alias("k"), hashing.valid_request(**parts).alias("ok"), hashing.valid_request(**parts | {"mode": F.lit(None).cast("string")}).alias("no")).first()
    assert json.loads(row["k"]) == ['a"b.md', 1, 2, 4, "😀", "h", "manual"] and row["ok"] and not row["no"]


def test_evaluation(spark):
    seeds = spark.createDataFrame([(i, *[f"{c}{i}" for c in evaluation.SEED]) for i in range(3)], "position int, " + ", ".join(f"{c} string" for c in evaluation.SEED))
    rows = {r["id"]: r for r in evaluation.fixtures(seeds).collect()}
    assert len(rows) == 21 and rows["slug2-ambiguous-en"]["relevant"] == ["evaluation/slug2.md", "evaluation/slug0.md"] and rows["slug1-alias-en"]["exact_target"] == "evaluation/slug1.md"
    cases = evaluation.fixtures(seeds).select(F.col("id").alias("case_id"), "category", "language", "exact_target")
    ranking = cases.select("case_id", F.lit("evaluation/slug1.md").alias("target"), F.lit(1).alias("rank"))
    total = {(r["scope"], r["name"]): r for r in relevance.report(relevance.case_metrics(cases, ranking, evaluation.relevant_targets(evaluation.fixtures(seeds))), ["category", "language"]).collect()}
    assert total["total", ""]["exact_rate"] == 0.3333 and total["category", "semantic-only"]["semantic_rate"] == 0.3333 and total["category", "ambiguous"]["semantic_rate"] == 1.0
    flat = cases.join(ranking, "case_id").withColumn("relevant", F.col("exact_target") == F.col("target"))
    same = relevance.counted_metrics(cases, flat.select("case_id", "target", "rank", F.coalesce("relevant", F.lit(False)).alias("relevant")), cases.select("case_id", F.lit(1).alias("relevant")))
    assert same.where("rr > 0").count() == 3
