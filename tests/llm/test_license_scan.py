"""Licences in any layout, at the threshold, and against the SQL on planted texts."""

from __future__ import annotations

import duckdb
import pytest
from conftest import LOREM, frame

from auditlens.llm import license_scan as ls

MIT = next(t for n, t in ls.TEMPLATES if n == "MIT" and "hereby" in t)
PARAGRAPHS = MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
PROSE = " ".join(f"{w}{i % 7}" for i, w in enumerate(LOREM.split() * 20))
TEXTS = [
    "released under the mit license a b",
    f"{PROSE[:3000]} {MIT} {PROSE[:3000]}",
    f"{PARAGRAPHS}\n\n{PROSE[:1500]}",
    f"{PROSE}\n\n{PARAGRAPHS}\n\n{PROSE}",
    "c 2020 Foo Inc all rights reserved. Released under the MIT License. More words on the same line follow here",
    "x This work is licensed under the GNU General Public License, version 2. y z",
    "Licensed under the Apache License, Version 2.0. Released under the MIT License. Licensed under CC BY 4.0.",
    "released license under the mit and so on",
    PROSE,
    "Released under the MIT License. " * 40,
    None,
    "",
    next(t for n, t in ls.TEMPLATES if n == "BSD-2-Clause"),
    "word " + next(t for n, t in ls.TEMPLATES if n == "BSD-3-Clause").replace("COPYRIGHT HOLDER ", "AUTHOR "),
    " ".join(f"a{i} released under the mit license b{i}" for i in range(300)),
]


def test_found_in_any_layout(spark):
    found = {}
    for r in ls.scan_licenses(frame(spark, TEXTS)).collect():
        found.setdefault(r["doc_id"], {})[r["license"]] = r["similarity"]
    assert found[0] == found[9] == found[14] == {"MIT": 1.0}
    assert all(found[i] == {"MIT": 1.0} for i in (1, 2, 3, 4))
    assert found[5] == {"GPL-2.0": 1.0}
    assert found[6] == {"Apache-2.0": 1.0, "MIT": 1.0, "CC-BY-4.0": 1.0}
    assert set(found[12]) == {"BSD-2-Clause"} and set(found[13]) == {"BSD-3-Clause"}
    assert not {7, 8, 10, 11} & set(found)


def test_equals_its_sql(spark):
    docs = frame(spark, TEXTS).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = sorted((a, b, round(c, 12)) for a, b, c in con.execute(ls.oracle_sql()).fetchall())
    assert sorted((a, b, round(c, 12)) for a, b, c in ls.scan_licenses(docs).collect()) == expected


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_eight_of_twelve_bigrams(spark, percent):
    """8 shared bigrams of 12 and of 8 are exactly 0.8, which floating point bounds lost."""
    words = [f"w{i}" for i in range(13)]
    templates = (("own", " ".join(words)),)
    docs = frame(spark, [" ".join(words[:9]), " ".join(words), " ".join(words[:6])])
    found = {r["doc_id"]: r["similarity"] for r in ls.scan_licenses(docs, templates=templates, percent=percent).collect()}
    every = {0: 16 / 20, 1: 1.0, 2: 10 / 17}
    assert found == {d: s for d, s in every.items() if 100 * s >= percent}


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("own", "some words of a licence of ours"), (None, "x y"), ("own", None)], "license string, text string")
    templates = ls.read_templates(table)
    assert templates == (("own", "some words of a licence of ours"),)
    docs = frame(spark, ["here are some words of a licence of ours for you"])
    assert [tuple(r) for r in ls.scan_licenses(docs, templates=templates).collect()] == [(0, "own", 1.0)]
