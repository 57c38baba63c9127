"""Bitmaps as sparse rows of 64-bit words: (value int, word_idx long, word long).

Bit b of word w stands for row id 64 * w + b, the lowest bit first. Words without a bit aren't
stored, so an index has one row for each value and each stretch of 64 rows in which it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KEY_TYPE, NotImplementedIndexError

KEY_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def check_key_type(kind: T.DataType) -> None:
    """Integer-like keys only. Unsigned 64-bit columns are read as decimal(20,0)."""
    if not isinstance(kind, KEY_TYPES) and not (isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision == 20) and not isinstance(kind, T.NullType):
        raise NotImplementedIndexError(KEY_TYPE)


def word_of(row_id: Column) -> Column:
    return F.shiftright(row_id, 6)


def bit_of(row_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(row_id, F.lit(64)).cast("int"))


def row_words(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., word_idx, word, n) of the row ids in rows, n rows in each: one aggregation, combined
    before its shuffle and the same however the rows are dealt."""
    bits = rows.select(*by, word_of(F.col("row_id")).alias("word_idx"), bit_of(F.col("row_id")).alias("bit"))
    return bits.groupBy(*by, "word_idx").agg(F.bit_or("bit").alias("word"), F.count("*").alias("n"))


def present(words: DataFrame) -> DataFrame:
    """(word_idx, word) of all rows in words, whatever their value."""
    return words.groupBy("word_idx").agg(F.bit_or("word").alias("word"))


def merge(*parts: DataFrame) -> DataFrame:
    """The words of all parts together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by = [c for c in out.columns if c != "word"]
    return out.groupBy(*by).agg(F.bit_or("word").alias("word"))


def without(words: DataFrame, gone: DataFrame) -> DataFrame:
    """words with the bits of gone (word_idx, word) cleared, and no words of zero."""
    left = words.join(gone.withColumnRenamed("word", "_gone"), "word_idx", "left")
    cleared = F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("_gone", F.lit(0).cast("long"))))
    return left.withColumn("word", cleared).where("word <> 0").select(*words.columns)


def row_ids(words: DataFrame) -> DataFrame:
    """words with a row for each bit and row_id in place of word_idx and word."""
    keep = [c for c in words.columns if c not in ("word_idx", "word")]
    each = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).where(F.getbit("word", F.col("b")) == 1)
    return each.select(*keep, (F.col("word_idx") * 64 + F.col("b")).alias("row_id"))


def group_counts(words: DataFrame) -> DataFrame:
    """(value, n): rows of each value, from the index alone."""
    return words.groupBy("value").agg(F.sum(F.bit_count("word").cast("long")).alias("n"))


def cumulative_counts(words: DataFrame) -> DataFrame:
    """(value, n): rows of at most each value that occurs, negatives left out. Running sums inside
    stretches of 2**16 values, and before them the sum of all earlier stretches: as keys have 31
    bits, no more than 2**15 rows are in the one window that isn't partitioned."""
    counts = group_counts(words.where("value >= 0")).withColumn("stretch", F.shiftright("value", 16))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.groupBy("stretch").agg(F.sum("n").alias("m")).select("stretch", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"))
    inside = F.sum("n").over(Window.partitionBy("stretch").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("value", "stretch", inside.alias("n")).join(F.broadcast(earlier), "stretch").select("value", (F.col("n") + F.col("m")).alias("n"))


def range_encoded(words: DataFrame) -> DataFrame:
    """The range encoding: (value, word_idx, word) with the rows of at most each value that occurs,
    for each stretch of rows that the value's own rows reach; the running OR is within a stretch."""
    order = Window.partitionBy("word_idx").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return words.where("value >= 0").select("value", "word_idx", F.bit_or("word").over(order).alias("word"))


def range_lookup(encoded: DataFrame, value: int) -> DataFrame:
    """(word_idx, word) of the rows of at most a value, from the range encoding: in each stretch of
    rows the bitmap of the value, or where it doesn't occur there of the next smaller one."""
    return encoded.where(F.col("value") <= value).groupBy("word_idx").agg(F.max_by("word", "value").alias("word"))


def values_of(words: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (row_id) with the value of each, null where it has none."""
    want = rows.select("row_id").distinct().withColumn("word_idx", word_of(F.col("row_id"))).withColumn("bit", F.pmod("row_id", F.lit(64)).cast("int"))
    hit = want.join(words, "word_idx").where(F.getbit("word", F.col("bit")) == 1).groupBy("row_id").agg(F.min("value").alias("value"))
    return rows.join(hit, "row_id", "left")
