"""Lexical search on small notes."""

import pytest
from pyspark.sql import functions as F

from linkrank.functions import text as T
from linkrank.operators import lexical

NOTES = [
    ("Hydration.md", "Hydration", ["Water intake"], [], ["health"], "Drinking enough water supports the body."),
    ("Cycle.md", "Water cycle", [], ["Evaporation"], [], "Water returns to the atmosphere."),
    ("Plants.md", "Plant transpiration", [], [], [], "Plants lose water through their leaves."),
    ("Wellbeing.md", "Daily notes", [], [], ["topics/wellbeing"], ""),
]


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(p, t, t, a, h, g, b) for p, t, a, h, g, b in NOTES]
    return spark.createDataFrame(rows, "path string, title string, basename string, aliases array<string>, headings array<string>, tags array<string>, body string")


def test_top_hits(spark, notes):
    asked = [("water intake", "water intake"), ("evaporation", "evaporation"), ("transpiraton", "plant transpiraton"), ("health", "health"), ("wellbeing", "wellbeing"), ("atmosphere", "water returns atmosphere"), ("", "x")]
    queries = spark.createDataFrame([(i, a, c, "Source.md", 6, 0.5) for i, (a, c) in enumerate(asked)], "query_id long, anchor_text string, context_text string, source_path string, `limit` int, minimum_score double")
    top = {r["query_id"]: r for r in lexical.search(notes, queries).where("rank = 1").collect()}
    assert [top[i]["target_path"] for i in range(6)] == ["Hydration.md", "Cycle.md", "Plants.md", "Hydration.md", "Wellbeing.md", "Cycle.md"]
    assert "alias" in top[0]["match_kinds"] and top[1]["target_heading"] == "Evaporation" and "tag" in top[4]["match_kinds"]
    assert 6 not in top


def test_text_functions(spark):
    one = spark.range(1)
    got = lambda c: one.select(c.alias("x")).first()["x"]
    assert got(T.normalise(F.lit("ٱلْمَاءُ"))) == "الماء" and got(T.normalise(F.lit("Water—Cycle"))) == "water cycle"
    assert abs(got(T.similarity(F.lit("hydration"), F.lit("hydratoin"))) - 10 / 18) < 1e-12
    assert got(T.similarity(F.lit(""), F.lit(""))) == 0 and got(T.similarity(F.lit("ab"), F.lit("ab"))) == 1
    assert [got(T.token_estimate(F.lit(s))) for s in ("", "water conservation planning", "ترشيد استهلاك المياه")] == [1, 8, 12]
    assert got(T.canonical_space(F.lit("  water\n\tplanning  "))) == "water planning"
    text = "---\ntitle: Hidden metadata\n---\n# Water\nuse `hidden code` and [water cycle](https://x.org/a)\n```\nsecret\n```\nend"
    bare = got(T.strip_markdown(F.lit(text)))
    assert "water cycle" in bare and not any(x in bare for x in ("Hidden metadata", "hidden code", "secret", "https://"))
    assert got(T.preview(F.lit("a" * 200))) == "a" * 179 + "…" and got(T.preview(F.lit(" "))) is None
    assert got(T.wikilink(F.lit("Notes/Water"), F.lit(None).cast("string"), F.lit("Water"))) == "[[Notes/Water]]"
    assert got(T.wikilink(F.lit("Water"), F.lit("## Sea"), F.lit("a|b"))) == "[[Water#Sea|a\\|b]]"
