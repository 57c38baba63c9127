"""Bitmap algebra: predicates on indexed columns as sets of row ids, combined word by word."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import words as W
from ..sources.tables import BUCKET_ROWS


class Bitmap:
    """Rows for which a condition is true, and, worked out only when a negation asks for it, those
    for which it is false; the others are unknown, as in SQL. Both are (word_idx, word).

    & joins on word_idx, which is unique on both sides; | is a union and one aggregation; ~ swaps.
    """

    def __init__(self, true: DataFrame, false: Callable[[], DataFrame]):
        self.true, self._false = true, false

    @cached_property
    def false(self) -> DataFrame:
        return self._false()

    def __and__(self, other: Bitmap) -> Bitmap:
        return Bitmap(_meet(self.true, other.true), lambda: W.merge(self.false, other.false))

    def __or__(self, other: Bitmap) -> Bitmap:
        return Bitmap(W.merge(self.true, other.true), lambda: _meet(self.false, other.false))

    def __invert__(self) -> Bitmap:
        return Bitmap(self.false, lambda: self.true)

    def count(self) -> DataFrame:
        """One row n, from the words alone."""
        return self.true.agg(F.coalesce(F.sum(F.bit_count("word").cast("long")), F.lit(0).cast("long")).alias("n"))

    def row_ids(self) -> DataFrame:
        return W.row_ids(self.true)

    def fetch(self, table: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
        """The table's rows (with row_id) in the bitmap. Rows look up their word, so that a bitmap
        of most rows costs a join with one row for 64 of them, and none is expanded into row ids.
        Adaptive execution broadcasts the words if there are few; of a table materialised in
        buckets of bucket_rows only the directories that hold some of them are read."""
        words = self.true.select(F.col("word_idx").alias("_at"), F.col("word").alias("_word"))
        on = W.word_of(F.col("row_id")) == F.col("_at")
        if "row_bucket" in table.columns:
            words = words.withColumn("_bucket", F.expr(f"_at * 64 div {bucket_rows}"))
            on = (F.col("row_bucket") == F.col("_bucket")) & on
        hit = F.getbit("_word", F.pmod("row_id", F.lit(64)).cast("int")) == 1
        return table.join(words, on).where(hit).select(*(f"`{c}`" for c in table.columns))


def _meet(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("word", "_other"), "word_idx")
    return both.select("word_idx", F.col("word").bitwiseAND(F.col("_other")).alias("word")).where("word <> 0")
