"""Keyed hashes and canonical event text as Columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 64


def key_pads(spark: SparkSession, key: bytes) -> DataFrame:
    """One row (ipad, opad) made from the key.

    The pads reach a query as data, through a scalar subquery, so that the key is
    not printed in plans and event logs as a literal would be.
    """
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner = bytearray(b ^ 0x36 for b in block)
    outer = bytearray(b ^ 0x5C for b in block)
    return spark.createDataFrame([(inner, outer)], "ipad binary, opad binary")


def hmac_sha256(message: Column, pads: DataFrame) -> Column:
    """Hex HMAC-SHA256 of a text column."""
    ipad = pads.select("ipad").scalar()
    opad = pads.select("opad").scalar()
    inner = F.unhex(F.sha2(F.concat(ipad, message.cast("binary")), 256))
    return F.sha2(F.concat(opad, inner), 256)


def canonical_text(fields: Sequence[Column]) -> Column:
    """Fields in one text that no other field values can produce.

    Every value is written with its length; a null is a dash.
    """
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def exact_number(value: Column) -> Column:
    """A double as text that no other double has, the same in every engine; never fails.

    A finite number is m * 2^(8k - 53) with whole m and k, written `k:m`.  k follows from
    the logarithm, shifted so that no value near a step is a power of two; multiplying by
    powers of two loses nothing.  The two zeros are one value.
    """
    k = F.floor((F.log(F.abs(value)) / math.log(2) + 0.37) / 8)
    shift = 53 - 8 * k
    half = F.floor(shift / 2)
    # In two steps, as a single power of two would not do for the smallest and largest numbers.
    whole = (value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), shift - half)).cast("long")
    infinite = F.abs(value) == float("inf")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(value), "NaN")
        .when(infinite, F.when(value > 0, "Infinity").otherwise("-Infinity"))
        .when(value == 0, "0")
        .otherwise(F.concat(k.cast("string"), F.lit(":"), whole.cast("string")))
    )
