"""Source text from bytes, keeping what can be decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The well-formed byte sequences of the Unicode standard, on bytes that are read as one character each.
_TAIL = r"[\x80-\xBF]"
_WELL_FORMED = (
    r"[\x00-\x7F]++",
    rf"[\xC2-\xDF]{_TAIL}",
    rf"\xE0[\xA0-\xBF]{_TAIL}",
    rf"[\xE1-\xEC\xEE\xEF]{_TAIL}{{2}}",
    rf"\xED[\x80-\x9F]{_TAIL}",
    rf"\xF0[\x90-\xBF]{_TAIL}{{2}}",
    rf"[\xF1-\xF3]{_TAIL}{{3}}",
    rf"\xF4[\x80-\x8F]{_TAIL}{{2}}",
)
# Possessive, so a text of any length is read in a loop.  A byte that begins no sequence is left out.
_KEPT_OR_NOT = f"((?:{'|'.join(_WELL_FORMED)})++)|[\\x80-\\xFF]"


def _decoded(content: Column) -> Column:
    one_each = F.decode(content, "ISO-8859-1")
    mended = F.decode(F.encode(F.regexp_replace(one_each, _KEPT_OR_NOT, "$1"), "ISO-8859-1"), "UTF-8")
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(mended)


def decode_source(df: DataFrame, content: str = "content", output: str = "code") -> DataFrame:
    """Decode UTF-8 bytes, dropping malformed ones, with all line ends as `\\n`.

    Spark's own decoding fails on malformed bytes or puts a replacement character in
    their place, so they are taken out before it.  Rows are decoded one by one, without Python:
    memory depends on the largest text, not on how many come together.
    """
    text = _decoded(F.col(content))
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return df.withColumn(output, lines)
