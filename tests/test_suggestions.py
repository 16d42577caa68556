"""From a cursor to ranked targets, with the hashing model."""

import os

import numpy as np
import pytest

from linkrank.operators import embedding
from linkrank.plans import suggestions


def test_hashing_model():
    m = embedding.hashing_model(64)(["water cycle", "Water cycles", "tax law", ""])
    assert m.shape == (4, 64) and np.allclose(np.linalg.norm(m[:3], axis=1), 1) and not m[3].any()
    assert m[0] @ m[1] > m[0] @ m[2]
    with pytest.raises(ValueError):
        embedding.checked(np.full((1, 2), np.nan), 1, 2)


def test_suggestions(spark):
    notes = spark.createDataFrame([(1, "Cycle.md", "Water cycle", "Cycle", [], ["Evaporation"], [], "Rain falls and vapour rises again."), (2, "Tax.md", "Tax law", "Tax", [], [], [], "Income and fees.")], "doc_id long, path string, title string, basename string, aliases array<string>, headings array<string>, tags array<string>, body string")
    text = "Some words first. The evaporation of rain makes vapour rise. More words."
    positions = spark.createDataFrame([(7, text, 0, 0, text.index("evaporation") + 3), (8, "`code`", 0, 0, 2)], "id long, text string, selection_from int, selection_to int, cursor int")
    got = suggestions.suggest(notes, positions).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {7} and got[0]["target_path"] == "Cycle.md" and "heading" in [k for r in got for k in r["match_kinds"]]


def test_passages_are_removed(spark):
    """Passages hold all texts: they are in a table beside the checkpoints, compressed, until the winners are found."""
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    seen, real = [], suggestions.vectors.best_of_groups

    def look(near, passages, *a):
        seen.extend(x for x in os.listdir(top) if x.startswith("passages-"))
        assert passages.columns == ["chunk_id", "target_path", "group_heading", "text_preview"]
        assert {r["chunk_id"] for r in passages.collect()} == {r["chunk_id"] for r in near.collect()}
        return real(near, passages, *a)

    notes = spark.createDataFrame([(f"N{i}.md", f"Note {i}", f"Note {i}", [], [], [], f"Words of number {i} and of the sea. " * 3) for i in range(60)], "path string, title string, basename string, aliases array<string>, headings array<string>, tags array<string>, body string")
    text = "Words first. The words of number 7 and of the deep sea. More words."
    positions = spark.createDataFrame([(7, text, 0, 0, text.index("number"))], "id long, text string, selection_from int, selection_to int, cursor int")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suggestions.vectors, "best_of_groups", look)
        assert 0 < suggestions.suggest(notes, positions).count() <= 6
    assert len(seen) == 1 and not [x for x in os.listdir(top) if x.startswith("passages-")]
