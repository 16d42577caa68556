"""The whole pipeline, and the registered queries, against brute force on small tables with odd rows."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_operators import brute_base, brute_pseudonym, luhn_rest
from tokenizers import Tokenizer

import corpus_pipeline
from linkrank.llm import pseudonyms, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(3000)]


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of_tables():
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(rng.choice(LETTERS, n))
    items = [("q1", prose(14)), ("q2", "Short item"), ("q3", None), (None, "lost item")]
    footer = ["Terms of this host", "All rights reserved", "Contact and imprint"]
    rows = [(i, "\n".join([prose(30), prose(20), *footer]), "en", "host", 1) for i in range(14)]
    for group in range(4):  # near copies of 0.8 and more, and below
        base = prose(150).split()
        rows.append((100 + 10 * group, " ".join(base), "en", "other", 1))
        for k in range(1, 4):
            near = list(base)
            for at in range(5, 5 + 35 * (2 * k - 1), 35):
                near[min(at, 149)] = "changed" + LETTERS[at]
            rows.append((100 + 10 * group + k, " ".join(near).upper() if k == 1 else " ".join(near), "en", "other", 1))
    rows += [(200, f"{prose(25)} {items[0][1].upper()} {prose(5)}", "en", "x", 1), (201, f"{prose(30)} short, ITEM {prose(3)}", None, "x", 1), (202, f"{prose(25)} {' '.join(items[0][1].split()[:9])}", "en", None, 1)]
    card = "411111111111111" + str(-luhn_rest("4111111111111110") % 10)
    rows += [(210 + i, f"{prose(25)} {value} {prose(4)}", "en", "y", 1) for i, value in enumerate([card, "a.b12@mail.example.com", "10.20.30.40", "2020-02-29", "+1 (017) 555-7713", "4111111111111112"])]
    long = prose(30)
    rows += [(300, None, None, None, None), (301, "", "en", "z", 0), (302, "few words", "en", "z", 9), (303, "again and again " * 200, "en", "z", 1), (304, "日本語 " * 30 + prose(25), "ja", "z", 1), (305, long, "en", "z", 1), (306, long, "en", "zz", 1)]
    return [*rows, rows[0], (None, prose(40), None, None, None)], items


def passed_rules(rows):
    """Rows that pass, with their lines above the limit taken out."""
    norm = lambda x: re.sub(r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", "", re.sub("[0-9]", "0", x.lower()))
    big = (1 << 63) - 1
    having = {}
    for i, t, _, s, _ in rows:
        for k in {norm(x) for x in (t or "").split("\n")} - {""}:
            having.setdefault((s, k), []).append((big if i is None else i, t))
    first = {k: min(i for i, _ in v) for k, v in having.items() if len({t for _, t in v}) >= 10}
    out = []
    for row in rows:
        i, t, _, s, _ = row
        words, chars, _, _, repeated = brute_base(t)
        gone = [(len(norm(x)), first[s, norm(x)] == (big if i is None else i)) for x in (t or "").split("\n") if (s, norm(x)) in first]
        removed, own = sum(n for n, _ in gone), sum(n for n, mine in gone if mine)
        poor = removed and (chars - removed < 50 or (chars - removed) * 100 < chars * 30)
        if words < 20 or 100 * repeated > 30 * words or (poor and own * 2 < removed):
            continue
        if removed and not poor:
            t = "\n".join(x for x in t.split("\n") if (s, norm(x)) not in first)
        out.append((i, t))
    return out


def one_of_each(rows, percent=80):
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", folded(t))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations([i for i in sets if i is not None], 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(i, t) for i, t in rows if i is None or find(i) == i]


def uncontaminated(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    windows = {tuple(ws[k : k + 10]) for item, t in items if item is not None for ws in [words(t)] if ws for k in range(max(1, len(ws) - 9))}
    hit = lambda ws: any(tuple(ws[p : p + n]) in windows for n in {len(w) for w in windows} for p in range(len(ws) - n + 1))
    return [(i, t) for i, t in rows if not hit(words(t))]


def replaced(text):
    return regex.sub(pseudonyms.CANDIDATES, lambda m: brute_pseudonym(m[0], registry.PII_KEY) or m[0], text)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = rows_of_tables()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_against_brute_force(spark, folder):
    rows, items = rows_of_tables()
    left = passed_rules(rows)
    assert len(left) < len(rows)
    unlike = one_of_each(left)
    assert len(unlike) < len(left)
    clean = uncontaminated(unlike, items)
    assert len(clean) < len(unlike)
    hidden = [(i, replaced(t)) for i, t in clean]
    assert sum(a != b for a, b in zip(clean, hidden)) >= 5
    library = Tokenizer.from_file(registry.tokenizer_path())
    want = sorted((-1 if i is None else i, ids := library.encode(t, add_special_tokens=False).ids, library.decode(ids, skip_special_tokens=False)) for i, t in hidden)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["tokens"], r["decoded"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("shard", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents.where("false"), folder).count() == 0, name
        out = stage(spark, documents, folder)
        assert out.columns == documents.columns and 0 < out.count() <= documents.count(), name


def test_registered_queries(spark, folder):
    """Columns and rows of the thin queries: held-out marks, predictions, laws and digests."""
    rows, items = rows_of_tables()
    n = len(rows)
    queries = registry.queries()
    assert list(queries) == sorted(queries, key=lambda q: int(q[2:].split("_")[0])) and len(queries) == 10
    spark.createDataFrame([(r[0], r[0] % 2, 0) for r in rows if r[0] is not None and r[1]], "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"]).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    import zlib

    rest = lambda i, m: zlib.crc32(str(i).encode()) % m
    one = queries["op1_language_id"](spark, folder).collect()
    assert len(one) == n and all(r["held_out"] == (r["doc_id"] is not None and rest(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in one) and {r["lang_pred"] for r in one if r["doc_id"] in (300, 301)} == {"und"}
    seven = queries["op7_attention_quality"](spark, folder).collect()
    assert len(seven) == n and all(r["held_out"] == (r["doc_id"] is not None and rest(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in seven)
    nine = queries["op9_sharding"](spark, folder).collect()
    assert len(nine) == n and {r["law"] for r in nine} == {"rows"} and {r["grown_shard"] for r in nine} == {None} and max(r["shard"] for r in nine) == 7
    sizes = [sum(r["shard"] == s for r in nine) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r["slot"] for r in nine if r["shard"] == s) == list(range(sizes[s])) for s in range(8))
    ten = {r["doc_id"]: r for r in queries["op10_decontamination"](spark, folder).collect()}
    assert ten[200]["items_sha256"] == hashlib.sha256(b"q1").hexdigest() and ten[201]["items_sha256"] == hashlib.sha256(b"q2").hexdigest() and not ten[202]["contaminated"] and ten[300]["n_words"] == 0
    library = Tokenizer.from_file(registry.tokenizer_path())
    texts = {r[0]: r[1] for r in rows}
    for r in queries["op3_bpe"](spark, folder).collect():
        if r["doc_id"] is not None:
            ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest() and r["n_tokens"] == len(ids)
