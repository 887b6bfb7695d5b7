"""Short items, and texts that repeat few words."""

from __future__ import annotations

import random
import time

import brute
import pytest
from conftest import LOREM, frame

from auditlens.llm import decontaminate as dc


def leaks(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["covered"], r["tiles"]) for r in dc.find_leaks(frame(spark, texts), bench).collect()}


def test_short_items(spark):
    items = ["four little words here", "Word!", "one two", "", None, "a b c d e f"]
    texts = [f"{LOREM} four little words, here {LOREM}", "four little words", "one\ntwo one", "word", None, "", "b c d e f a"]
    assert leaks(spark, texts, items) == {(0, 0): (4, 1), (2, 2): (2, 1), (3, 1): (1, 1), (6, 5): (5, 1)}
    kept = dc.clean_documents(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]


@pytest.mark.parametrize("period", [1, 2, 3, 7])
def test_a_million_repeating_words(spark, period):
    item = " ".join(f"w{i % period}" for i in range(50))
    text = " ".join(f"w{i % period}" for i in range(1_000_000))
    start = time.time()
    found = list(dc.scan([text.encode()], dc.Seeds([(0, item.encode())])))
    assert found == [(0, 0, 50, 1)]
    assert time.time() - start < 20


@pytest.mark.parametrize("seed", range(30))
def test_repeating_stretches_tile_as_whole(monkeypatch, seed):
    """Leaving out the middles changes nothing: items and texts of few words, with stretches of any period."""
    monkeypatch.setattr(dc, "MANY_PAIRS", 0)
    rng = random.Random(seed)

    def stretch(n):
        period = rng.randint(1, 3)
        some = [rng.choice("abc") for _ in range(period)]
        return [some[i % period] for i in range(n)]

    items = [sum((stretch(rng.randint(3, 9)) for _ in range(rng.randint(1, 3))), []) for _ in range(3)]
    doc = sum((stretch(rng.randint(1, 60)) for _ in range(5)), [])
    found = {(i): c for _, i, c, _ in dc.scan([" ".join(doc).encode()], dc.Seeds([(i, " ".join(x).encode()) for i, x in enumerate(items)]), 0.0)}
    for i, item in enumerate(items):
        least = min(5, len(item))
        assert found.get(i, 0) == (brute.tiles(doc, item, least) if least == 5 else least * (" ".join(item) in " ".join(doc)))
