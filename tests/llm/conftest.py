from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

FOLDER = "/root/testdata/sf0.001"

LOREM = (
    "the quiet river carries every small boat past the old mill and under the stone bridge where children "
    "wave at strangers before the evening bells call them home across the wide green fields of early summer"
)

#: Null, empty, blank, tiny, tied, repeated, odd white space, several scripts, very long.
HARD_TEXTS: list[str | None] = [
    None,
    "",
    " \t\n",
    "one",
    "two words",
    "a b c d e f g h",
    LOREM,
    LOREM,
    LOREM.upper(),
    LOREM + " " + LOREM,
    "\n".join([LOREM, "x", LOREM, "", "x", " "]),
    "A B   C\x1cD\x0bE\x0cF\r\nG  H",
    "日本語 の テキスト 😀 naïve café ÀÉ ßtraße",
    "mail a.b+c@d-e.example.com, 10.0.0.256 and 10.0.0.255! card 4111 1111 1111 1111 or +1 (555) 010-9999 ok",
    'password = "abcdefghijkl" TOKEN: abcdefghijk api-key=x apikey=0123456789abcdef AKIAABCDEFGHIJKLMN deadbeefdeadbeef',
    "word " * 3000,
    "z" * 20000,
    " ".join(f"w{i % 97}" for i in range(5000)),
]


def frame(spark: SparkSession, texts: list[str | None], sources: list[str | None] | None = None) -> DataFrame:
    """documents with the given texts, and columns whose names the operators use inside."""
    rows = [
        (i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), -1, "taken", True, None)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, id int, kind string, kept boolean, "
        "component_id string",
    )


@pytest.fixture(scope="session")
def hard(spark):
    return frame(spark, HARD_TEXTS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, ["x"]).where("doc_id < 0")


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
