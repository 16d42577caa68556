"""Queries that meet notes inside a task: the pairs of SQL on short, empty and repeated texts, whatever the blocks and pieces, and no pair shuffled."""

import random
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkrank.operators import matching, vectors
from linkrank.sources.snapshot import ensure_checkpoint_dir

WORDS = ("a", "ab", "abc", "abcd", "abab", "ababa", "the", "water", "watering", "sea", "7", "é", "12", "cab", "bcd")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents of short words, some empty; every hundredth asks."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("odd")
    line = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 5)))
    rows = [(i * (1 if i % 3 else 100), "" if i % 41 == 7 else "\n".join(line() for _ in range(rng.randint(1, 8))), rng.choice(("en", "de")), rng.choice(("src0", "the sea")), 0) for i in range(1, 400)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", list({r[0]: r for r in rows}.values()))
    db.execute(f"COPY documents TO '{folder}/documents.parquet'")
    return str(folder), db


def agree(spark, odd, name, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_QUERIES", 31, raising=False)
    found = entry.queries()[name](spark, odd[0])
    got = sorted(map(repr, (tuple(r) for r in found.collect())))
    assert got == sorted(map(repr, odd[1].execute(entry.oracle_sql()[name]).fetchall())) and len(got) > 300
    return found._jdf.queryExecution().executedPlan().toString()


def unshuffled(plan):
    # read from the top: nothing is dealt out once the pairs are there
    return "Exchange" not in plan[: plan.index("MapInArrow")]


def test_dice_pairs(spark, odd, monkeypatch):
    assert unshuffled(agree(spark, odd, "lex_dice", monkeypatch))


def test_pieces():
    work = np.array([5, matching.MATCHES * 2, 0, 1, 1])
    assert list(matching.pieces(work, 1)) == [(0, 1), (1, 2), (2, 5)] and list(matching.pieces(work[2:], matching.CELLS)) == [(0, 1), (1, 2), (2, 3)]
    assert list(matching.pieces(work[:0], 0)) == []


def test_gram_candidates(spark, odd, monkeypatch):
    assert unshuffled(agree(spark, odd, "lex_gram_candidates", monkeypatch))


def test_body_score(spark, odd, monkeypatch):
    assert unshuffled(agree(spark, odd, "lex_body_score", monkeypatch))


def test_term_candidates(spark, odd, monkeypatch):
    assert unshuffled(agree(spark, odd, "lex_term_candidates", monkeypatch))


def met(monkeypatch):
    """What leaves the tasks of the searches that follow."""
    seen, real = [], matching.map_blocks
    monkeypatch.setattr(matching, "map_blocks", lambda *a: seen.append(real(*a)) or seen[-1])
    return seen


def only_winners(seen):
    # at most as many rows of a query as it shows leave each task
    most = seen.groupBy("query_id", F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("limit").alias("limit"))
    return len(seen.head(1)) == 1 and most.where("n > `limit`").count() == 0


def test_lexical_search(spark, odd, monkeypatch):
    seen = met(monkeypatch)
    agree(spark, odd, "lexical_search", monkeypatch)
    assert only_winners(seen[0])


def test_hybrid_fusion(spark, odd, monkeypatch):
    rng = np.random.default_rng(5)
    odd[1].execute("CREATE OR REPLACE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    odd[1].executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(i, rng.normal(size=8).tolist(), int(i % 7)) for (i,) in odd[1].execute("SELECT doc_id FROM documents ORDER BY doc_id").fetchall()])
    odd[1].execute(f"COPY embeddings TO '{odd[0]}/embeddings.parquet'")
    seen = met(monkeypatch)
    agree(spark, odd, "hybrid_fusion", monkeypatch)
    assert only_winners(seen[0])


def test_suggestions(spark, odd, monkeypatch):
    seen = met(monkeypatch)
    found = entry.queries()["suggestions"](spark, odd[0])
    assert 0 < found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 6 and only_winners(seen[0])


def test_packed_tokens():
    row, token, count = np.array([0, 0, 2, 2, 2]), np.array([3, 200, 0, 1, 1 << 40]), np.array([0, 5000, 1, 127, 128])
    items = matching.packed(row, token, count, 4)
    assert [len(x) for x in items.to_pylist()] == [6, 0, 12, 0]
    apart = pa.ListArray.from_arrays(pa.array([0, 1, 2, 3, 4], pa.int32()), items)
    assert all((x == y).all() for x, y in zip(matching.unpacked(apart), (row, token, count)))
    assert [x.tolist() for x in matching.unpacked(apart.slice(1, 2))] == [[1, 1, 1], [0, 1, 1 << 40], [1, 127, 128]]
    twice = pa.ListArray.from_arrays(pa.array([0, 0, 3, 4], pa.int32()), items.take(pa.array([2, 1, 2, 0])))
    assert [x.tolist() for x in matching.unpacked(twice)] == [[1, 1, 1, 2, 2], [0, 1, 1 << 40, 3, 200], [2, 254, 256, 0, 5000]]
    assert all(len(x) == 0 for x in matching.unpacked(apart.slice(1, 1)))


@pytest.fixture(scope="module")
def shared(odd, tmp_path_factory):
    """The same documents, of which some share their path, or have none."""
    folder, db = tmp_path_factory.mktemp("shared"), duckdb.connect()
    db.execute(f"CREATE TABLE documents AS SELECT * REPLACE (CASE WHEN doc_id % 100 > 0 AND doc_id % 7 = 0 THEN doc_id - doc_id % 14 + 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 11 <> 0 THEN source END AS source) FROM '{odd[0]}/documents.parquet'")
    db.execute(f"COPY documents TO '{folder}/documents.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", ["lex_body_score", "lex_gram_candidates", "lex_term_candidates"])
def test_shared_paths(spark, shared, name, monkeypatch):
    assert shared[1].execute("SELECT count(*) - count(DISTINCT source || doc_id) FROM documents").fetchone()[0] > 40
    agree(spark, shared, name, monkeypatch)


@pytest.mark.parametrize("name", ["lex_term_candidates", "lex_body_score", "lexical_search"])
def test_notes_stay_where_they_are_read(spark, odd, name, monkeypatch):
    # neither the notes' terms nor their fields are dealt out again before they meet the queries
    seen = met(monkeypatch)
    entry.queries()[name](spark, odd[0])
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("together", [1, 8])
def test_term_candidates_of_many_files(spark, odd, tmp_path, monkeypatch, together):
    # pairs without a score need one look at the notes where they are read: their terms are written nowhere, unless there are too many queries
    for i in range(8):
        odd[1].execute(f"COPY (SELECT * FROM documents WHERE doc_id % 8 = {i}) TO '{tmp_path}/{i}.parquet'")
    (tmp_path / "documents.parquet").mkdir()
    for i in range(8):
        (tmp_path / f"{i}.parquet").rename(tmp_path / f"documents.parquet/{i}.parquet")
    monkeypatch.setattr(matching, "TOGETHER", together, raising=False)
    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.rglob("*"))
    plan = agree(spark, (str(tmp_path), odd[1]), "lex_term_candidates", monkeypatch)
    kept = set(folder.rglob("*")) != before
    assert unshuffled(plan) and kept == (together == 1)


def test_vectors_in_pieces():
    """Many queries against a large batch: few scores are held at once, and the best are those of brute force."""
    asked, rows = 1000, 12000
    rng = np.random.default_rng(9)
    m, v = rng.integers(-3, 4, (asked, 4)).astype(float), rng.integers(-3, 4, (rows, 4)).astype(np.float32)
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda run, schema: run)
    frame.select = lambda *a: frame
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vectors, "F", SimpleNamespace(col=lambda c: SimpleNamespace(cast=lambda kind: c)))
        run = vectors._best(frame, {4: (np.arange(asked), m)}, 5, True)
    batch = pa.record_batch([pa.array(np.arange(rows)), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * 4, pa.int32()), pa.array(v.ravel()))], ["chunk_id", "vector"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(run(iter([batch])))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(found["query_id"]) == asked * 5
    got = {}
    for q, c in zip(found["query_id"], found["chunk_id"]):
        got.setdefault(q, []).append(c)
    for q in range(0, asked, 97):
        score = v.astype(float) @ m[q]
        score[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(rows), -score))[:5].tolist()
