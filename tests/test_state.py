"""Contexts, controllers, generations, log, streams."""

import json

from pyspark.sql import functions as F

from linkrank.operators import context, incremental
from linkrank.sources import snapshot
from linkrank.streaming import control
from linkrank.streaming import events as E


def test_contexts(spark):
    text = "First one. The water cycle matters! Last one.\n\nOther [[Water]] text and `code` here."
    c = context.context_at(text, 0, 0, text.index("cycle") + 2)
    assert (c["anchor_text"], c["previous_sentence"], c["sentence"], c["next_sentence"]) == ("cycle", "First one.", "The water cycle matters!", "Last one.")
    a = text.index("water cycle")
    assert context.context_at(text, a, a + 12, 0)["selection"] == "water cycle"
    for word in ("Water]]", "code"):
        assert context.context_at(text, 0, 0, text.index(word) + 1) is None
    assert context.context_at("```\nx y\n```\nz", 0, 0, 5) is None and context.context_at("---\na: b\n---\nword", 0, 0, 14)["anchor_text"] == "word"
    assert context.context_at("<div>in</div> out", 0, 0, 6) is None and context.context_at("<div>in</div> out", 0, 0, 15)["anchor_text"] == "out"
    rows = spark.createDataFrame([(1, text, 0, 0, 2), (2, None, 0, 0, 0)], "id long, text string, selection_from int, selection_to int, cursor int")
    assert [r["anchor_text"] for r in context.contexts(rows).collect()] == ["First"]


EVENT = "stream string, position long, kind string, at double, asked int, done int, took double, pending boolean, memory double, most int"


def paced(start, *events):
    """The paces after each event."""
    out = []
    for e in events:
        start = control.after(start, e)
        out.append(start)
    return out


def test_batch_size():
    ask, quick = control.Event("ask", 5.0), control.Event("done", 5.0, 4, 4, 50.0)
    idle = control.Pace(active_at=-5000.0)
    one, two = paced(idle, quick, quick)
    assert (one.size, one.quick) == (4, 1) and (two.size, two.quick) == (6, 0)
    learned = control.after(two, control.Event("done", 6.0, 12, 12, 120.0))
    assert (learned.learned, learned.quick) == (12, 0) and control.after(learned, ask).size == 10  # four steps towards what is known
    slow = control.after(learned._replace(size=12), control.Event("done", 7.0, 12, 12, 500.0))
    assert (slow.size, slow.learned) == (6, 6) and control.after(slow, control.Event("failed")).learned == 4
    assert control.after(learned, control.Event("done", 7.0, 12, 5, 50.0)) == learned._replace(quick=0)
    for held in (ask._replace(pending=True), ask._replace(memory=0.85), ask._replace(at=-3001.0)):
        assert control.after(learned, held).size == 4
    assert control.after(learned, control.Event("active", 9.0)) == control.Pace(4, 12, 0, 9.0) and control.after(learned, control.Event("active", float("nan"))) == learned
    assert control.allowed(learned, ask._replace(most=3)) == 3 and control.allowed(learned, ask._replace(most=0)) == 1
    assert control.clamp_size(float("nan")) == 4 and control.clamp_size(99) == 16


def test_batch_sizes_of_streams(spark, tmp_path):
    rows = [(s, i, "done" if i % 2 else "ask", 3000.0 + i, 4, 4, 50.0, False, 0.0, 16) for s in ("a", "b") for i in range(6)]
    events = spark.createDataFrame(rows, EVENT)
    got = {(r["stream"], r["position"]): r["size"] for r in control.batch_sizes(events).collect()}
    assert got == {(s, i): n for s in ("a", "b") for i, n in enumerate([4, 4, 4, 6, 6, 6])}
    for k in (0, 1):
        events.where(F.col("position").between(3 * k, 3 * k + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = control.batch_sizes(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sizes").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["stream"], r["position"]): r["size"] for r in spark.table("sizes").collect()} == got


def test_checkpoint_requests_cache():
    s = control.Checkpoint()
    assert s.dirty(63) == 2000 and s.dirty() == 0 and s.begin() and not s.begin()
    s.end(False)
    assert s.pending == 64
    r = control.Requests()
    first, again, second = r.schedule("v", "a"), r.schedule("v", "a"), r.schedule("v", "b")
    assert again is None and not r.accepts("v", first, "a") and r.accepts("v", second, "b")
    cache = control.QueryCache(2)
    made = [cache.get(k, lambda k=k: k) for k in "abac"]
    assert list(cache.values) == ["a", "c"] and made == list("abac")


def test_generations_and_recovery(spark, tmp_path):
    root = str(tmp_path / "index")
    part = lambda n: spark.createDataFrame([(i, f"p{i}") for i in range(n)], "id long, path string")
    assert snapshot.open_latest(spark, root) is None
    for n in (2, 3):
        snapshot.write(spark, root, {p: part(n) for p in snapshot.PARTS}, {"model": "m"})
    manifest, data = snapshot.open_latest(spark, root)
    assert manifest["generation"] == 2 and data["documents"].count() == 3
    for f in (tmp_path / "index/generation-2/chunks").glob("*.parquet"):
        f.unlink()
    assert snapshot.open_latest(spark, root)[0]["generation"] == 1
    assert snapshot.open_latest(spark, root, {"model": "other"}) is None


def test_log(spark, tmp_path):
    lines = [snapshot.log_record(1, 0, {"removals": ["b"], "upserts": [{"path": "a", "value": "1"}]}), snapshot.log_record(2, 0, {"removals": [], "upserts": [{"path": "c", "value": "2"}]}), snapshot.log_record(3, 0, {"removals": ["a"], "upserts": []})]
    broken = json.loads(lines[2]) | {"checksum": "0" * 64}
    (tmp_path / "log").write_text("\n".join([lines[0], lines[1], json.dumps(broken), lines[2][:20]]))
    good = incremental.valid_prefix(snapshot.read_log(spark, str(tmp_path / "log")))
    base = spark.createDataFrame([("b", "0"), ("d", "9")], "path string, value string")
    state = {r["path"]: r["value"] for r in incremental.replay(base, snapshot.log_entries(good)).collect()}
    assert state == {"a": "1", "c": "2", "d": "9"}


def test_stream_debounce(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k", "2024-01-01 00:00:00"), (2, "k", "2024-01-01 00:00:00.1"), (3, "k", "2024-01-01 00:01:00"), (4, "z", "2024-01-01 01:00:00")], "event_id long, user string, ts string").selectExpr("event_id", "user", "cast(ts as timestamp) ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = E.debounce(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user", "350 milliseconds", watermark="1 second")
    q = stream.writeStream.format("memory").queryName("debounced").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["user"], r["last_event"]) for r in spark.table("debounced").collect()}
    assert got == {("k", 2), ("k", 3)}


def test_change_detection(spark):
    index = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "path string, modified_at long, content_hash string")
    live = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 2, "w"), ("n", 1, "q")], "path string, modified_at long, content_hash string")
    assert {r["path"]: r["change"] for r in incremental.changes(index, live).collect()} == {"a": "unchanged", "b": "reusable", "c": "changed", "n": "new"}
