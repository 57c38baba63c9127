"""The two scalar functions, as Column expressions and as SQL functions. No Python runs per row."""

from __future__ import annotations

import ssl

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# What the functions put around their argument.
PREFIX, SUFFIX = "BitmapIdx ", " 🐥"
VERSION_TEXT = ", my linked OpenSSL version is "


def bitmap_idx(c: Column) -> Column:
    """'BitmapIdx ' || c || ' 🐥'; null for null."""
    return F.concat(F.lit(PREFIX), c, F.lit(SUFFIX))


def bitmap_idx_openssl_version(c: Column) -> Column:
    """'BitmapIdx ' || c || ', my linked OpenSSL version is ' and the driver's OpenSSL; null for null."""
    return F.concat(F.lit(PREFIX), c, F.lit(VERSION_TEXT + ssl.OPENSSL_VERSION))


def register(spark: SparkSession) -> None:
    """Make both callable from SQL in this session; Catalyst inlines them as concat."""
    for name, after in (("bitmap_idx", SUFFIX), ("bitmap_idx_openssl_version", VERSION_TEXT + ssl.OPENSSL_VERSION)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN concat('{PREFIX}', x, '{after}')")
