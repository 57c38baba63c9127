"""Helpers shared by the operators: reading tables, cutting lineage, sizing shuffles."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete, shared_dir

#: A word: a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_made: list[list[DataFrame]] = []


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that :func:`cut` writes inside, to be dropped when their result is written."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, lost
    executors don't force a recomputation, and later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for tables in _made[-1:]:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing lazy still reads; those deleted before do no harm."""
    for df in tables:
        delete(df.sparkSession, df._cut_path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced.
    Called between phases whose shuffles each hold about as much as the input."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_keys(d: pd.Series, h: pd.Series) -> np.ndarray:
    """Sixteen bytes a row that sort as (id, hash of the text) do."""
    out = np.empty((len(d), 2), dtype=">u8")
    for k, c in enumerate((d, h)):
        out[:, k] = c.to_numpy(np.int64).view(np.uint64) ^ np.uint64(2**63)
    return out.view("S16").ravel()


def order_bounds(rows: DataFrame, parts: int, n: int, each: int = 20) -> np.ndarray:
    """Up to parts - 1 ascending splitters of n rows (d, h) into ranges of like size, from a sample
    of about `each` rows a range."""
    share = each * parts / max(n, 1)
    some = (rows.sample(share, 1) if share < 1 else rows).select("d", "h").toPandas()
    found = np.sort(order_keys(some["d"], some["h"]))
    return np.unique(found[(len(found) * np.arange(1, parts)) // parts]) if len(found) else found
