"""The bitmap index: words, the row ids that exist, and what its size is counted from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CONSTRAINT, KEY_RANGE, ONE_COLUMN, ROW_TWICE, ConstraintIndexError, NotImplementedIndexError, OutOfRangeIndexError
from ..plans.bitmap import Bitmap
from . import words as W


@dataclass(frozen=True)
class Stats:
    """What the size is counted from; deletes don't lower it. rows: of the table at creation."""

    rows: int = 0
    max_value: int = -1  # the largest key seen, -1 without one that isn't negative
    max_row: int = -1  # the largest row id with a key, -1 without one

    def __or__(self, other: Stats) -> Stats:
        return Stats(self.rows, max(self.max_value, other.max_value), max(self.max_row, other.max_row))

    @property
    def bitmaps(self) -> int:
        return max(1, self.rows, self.max_value + 1)

    @property
    def words(self) -> int:
        """Of each bitmap, zero words included."""
        return (self.max_row + 64) // 64

    @property
    def memory_bytes(self) -> int:
        return 8 * self.bitmaps * self.words

    @property
    def bits(self) -> int:
        return 64 * self.bitmaps * self.words


def keyed_rows(table: DataFrame, column: str) -> DataFrame:
    """(row_id, key), the key any SQL expression over the table of an integer-like type."""
    out = table.select("row_id", F.expr(column).alias("key"))
    W.check_key_type(out.schema["key"].dataType)
    return out.withColumn("key", F.col("key").cast("int") if out.schema["key"].dataType.simpleString() == "boolean" else F.col("key"))


def aggregated(rows: DataFrame, column: str) -> DataFrame:
    """(value, word_idx, word, n) of rows (with row_id) by an expression, rows whose key is null
    under a null value; values are of the key's own type until :func:`measured` has seen them."""
    return W.row_words(keyed_rows(rows, column).withColumnRenamed("key", "value"), "value")


def measured(everything: DataFrame) -> Stats:
    """The stats of what :func:`aggregated` gives; raises if a key doesn't fit 32 bits, or if a row
    id occurs twice, as rows have no order by which one of them could win."""
    top = F.col("word_idx") * 64 + F.length(F.bin("word")) - 1  # the highest bit of the word
    each = everything.groupBy("word_idx").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("word")).alias("bits"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(F.when(F.col("value").isNotNull(), top)).alias("row"))
    got = each.agg(F.sum("n").alias("n"), F.sum("bits").alias("bits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("row").alias("row")).first()
    for end in (got["lo"], got["hi"]):
        if end is not None and not W.INT_MIN <= int(end) <= W.INT_MAX:
            raise OutOfRangeIndexError(KEY_RANGE.format(int(end)))
    if got["n"] != got["bits"]:
        raise ConstraintIndexError(ROW_TWICE)
    return Stats(got["n"] or 0, max(-1, -1 if got["hi"] is None else int(got["hi"])), -1 if got["row"] is None else got["row"])


def valued(everything: DataFrame) -> DataFrame:
    """The words of what :func:`aggregated` gives: rows whose key is null are in no bitmap."""
    return everything.where("value IS NOT NULL").select(F.col("value").cast("int").alias("value"), "word_idx", "word")


@dataclass(frozen=True)
class BitmapIndex:
    """An index of one key. Maintenance returns a new index; the words stay ordinary DataFrames.

    words (value, word_idx, word) have negative keys too, so that predicates agree with plain
    filters; dumps, distinct values and scans leave them out. live (word_idx, word) are the rows
    that exist, with a key or without.
    """

    name: str
    table: str
    column: str
    words: DataFrame
    live: DataFrame
    stats: Stats
    options: dict[str, str] = field(default_factory=dict)

    # -- counts, values, sizes

    def evaluate(self, value: int, encoding: str = "equality") -> DataFrame:
        """One row n: rows with the value, or in the range encoding with a key from 0 to it."""
        fits = F.col("value") == value if encoding == "equality" else F.col("value").between(0, value)
        return self.words.where(fits).where("value >= 0").agg(F.coalesce(F.sum(F.bit_count("word").cast("long")), F.lit(0).cast("long")).alias("n"))

    def group_counts(self) -> DataFrame:
        return W.group_counts(self.words)

    def cumulative_counts(self) -> DataFrame:
        return W.cumulative_counts(self.words)

    def get_value(self, row_id: int) -> int:
        """The row's value; -1 without one."""
        at = self.words.where((F.col("word_idx") == row_id // 64) & (F.getbit("word", F.lit(row_id % 64)) == 1)).agg(F.min("value")).first()[0]
        return -1 if at is None else at

    def values_of(self, rows: DataFrame) -> DataFrame:
        return W.values_of(self.words, rows)

    def distinct_values(self) -> DataFrame:
        """(distinct_value string) of values that some row has, negatives left out."""
        return self.words.where("value >= 0 AND word <> 0").select(F.col("value").cast("string").alias("distinct_value")).distinct()

    def n_rows(self) -> int:
        """One more than the largest row id with a key ever seen."""
        return self.stats.max_row + 1

    def dump(self) -> DataFrame:
        """(distinct_value, bitmap_mem_size, bitmap_bit_size, compression_ratio): a row a value,
        each with the sizes of the whole index as dense bitmaps."""
        s = self.stats
        return self.distinct_values().select("distinct_value", F.lit(s.memory_bytes).cast("long").alias("bitmap_mem_size"), F.lit(s.bits).cast("long").alias("bitmap_bit_size"), F.lit(1.0).alias("compression_ratio"))

    def sizes(self) -> DataFrame:
        """(value, n_words, n_rows, dense_words): of each value the words that are stored and the
        rows in them, and the words that a dense bitmap up to the last row would have."""
        each = self.words.where("value >= 0").groupBy("value").agg(F.count("*").alias("n_words"), F.sum(F.bit_count("word").cast("long")).alias("n_rows"))
        return each.withColumn("dense_words", F.lit(self.stats.words).cast("long"))

    def at_most(self, value: int) -> DataFrame:
        """(word_idx, word) of the rows with keys from 0 to the value, by the range encoding."""
        return W.range_lookup(W.range_encoded(self.words), value)

    def scan(self) -> DataFrame:
        """(value, row_id) of every indexed row; order by both for value-major order."""
        return W.row_ids(self.words.where("value >= 0"))

    # -- predicates

    def _notnull(self) -> DataFrame:
        return self.words.groupBy("word_idx").agg(F.bit_or("word").alias("word"))

    def _where(self, condition) -> Bitmap:
        true = self.words.where(condition).groupBy("word_idx").agg(F.bit_or("word").alias("word"))
        return Bitmap(true, lambda: W.without(self._notnull(), true))

    def eq(self, value: int) -> Bitmap:
        return Bitmap(self.words.where(F.col("value") == value).select("word_idx", "word"), lambda: self.ne(value).true)

    def ne(self, value: int) -> Bitmap:
        return self._where(F.col("value") != value)

    def isin(self, *values: int) -> Bitmap:
        return self._where(F.col("value").isin(*values))

    def lt(self, value: int) -> Bitmap:
        return self._where(F.col("value") < value)

    def le(self, value: int) -> Bitmap:
        return self._where(F.col("value") <= value)

    def gt(self, value: int) -> Bitmap:
        return self._where(F.col("value") > value)

    def ge(self, value: int) -> Bitmap:
        return self._where(F.col("value") >= value)

    def between(self, low: int, high: int) -> Bitmap:
        return self._where(F.col("value").between(low, high))

    def is_null(self) -> Bitmap:
        return Bitmap(W.without(self.live, self._notnull()), self._notnull)

    def is_not_null(self) -> Bitmap:
        return ~self.is_null()

    # -- maintenance

    def delta(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """What :func:`aggregated` gives for rows (row_id and the index's column). With `order`, a
        third column, the row that is last in it wins where a row id occurs more than once."""
        columns = [c for c in rows.columns if c not in ("row_id", order)]
        if len(columns) != 1:
            raise NotImplementedIndexError(ONE_COLUMN)
        if order:
            rows = rows.groupBy("row_id").agg(F.max_by(columns[0], order).alias(columns[0]))
        return aggregated(rows, f"`{columns[0]}`")

    def append(self, rows: DataFrame, order: str | None = None) -> BitmapIndex:
        """Set the keys of rows (row_id and the index's column), new ones or others' instead; a
        null key takes the row out of all bitmaps. A row id that occurs more than once raises,
        unless `order` names a column (see :meth:`delta`)."""
        return self.append_delta(self.delta(rows, order))

    def append_delta(self, delta: DataFrame) -> BitmapIndex:
        stats, touched = self.stats | measured(delta), W.present(delta)
        kept = W.without(self.words, touched)
        return replace(self, words=W.merge(kept, valued(delta)), live=W.merge(self.live, touched), stats=stats)

    insert = append
    update = append

    def delete(self, rows: DataFrame) -> BitmapIndex:
        """Without the rows (row_id, other columns ignored); sizes stay."""
        gone = W.row_words(rows.select("row_id")).drop("n")
        return replace(self, words=W.without(self.words, gone), live=W.without(self.live, gone))

    def merge(self, other: BitmapIndex) -> BitmapIndex:
        """With the rows of another index too; a row in both keeps the other's key."""
        kept = W.without(self.words, other.live)
        return replace(self, words=W.merge(kept, other.words), live=W.merge(self.live, other.live), stats=self.stats | other.stats)

    def vacuum(self) -> BitmapIndex:
        """Words merged and those without a bit left out."""
        return replace(self, words=W.merge(self.words).where("word <> 0"), live=W.merge(self.live).where("word <> 0"))

    def crowded(self) -> DataFrame:
        """(word_idx) of the stretches with rows in several bitmaps: those with more bits than rows."""
        bits = F.sum(F.bit_count("word").cast("long"))
        return self.words.groupBy("word_idx").agg(bits.alias("bits"), F.bit_count(F.bit_or("word")).alias("rows")).where("bits <> rows").select("word_idx")

    def conflicts(self) -> DataFrame:
        """(row_id, n) of rows that are in several bitmaps; empty for a sound index. Only words of
        crowded stretches are expanded."""
        return W.row_ids(self.words.join(self.crowded(), "word_idx", "left_semi")).groupBy("row_id").agg(F.count("*").alias("n")).where("n > 1")

    def verify(self, only_verify: bool = False) -> str:
        """Raise if a row has two values; otherwise what the index holds, or '' with only_verify."""
        if not self.crowded().isEmpty():
            raise ConstraintIndexError(CONSTRAINT)
        return "" if only_verify else f"Bitmap Index {self.name} (indexed values: {self.distinct_values().count()})"


def create(name: str, table: str, column: str, rows: DataFrame, options: dict[str, str] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> BitmapIndex:
    """An index over rows (with row_id) by a column or expression. keep: writes a DataFrame and
    reads it back; then the table is scanned once."""
    everything = aggregated(rows, column)
    if keep:
        everything = keep(everything)
    return BitmapIndex(name, table, column, valued(everything), W.present(everything), measured(everything), dict(options or {}))


def any_of(parts: Iterable[Bitmap]) -> Bitmap:
    first, *rest = parts
    for p in rest:
        first = first | p
    return first
