"""Row ids: the number of a row in its table, from where it stands in its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 20  # rows of a directory of a materialised table


def read_with_row_ids(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table plus row_id, counted from 0 over its files in order of their paths.

    A row's place in its file comes from the file source, so the id doesn't hang on how files are
    split into tasks, and no sort or global window touches the rows: only one count a file is
    summed up in order."""
    df = spark.read.parquet(path)
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    if len(df.inputFiles()) == 1:
        return at.withColumn("row_id", F.col("_at")).drop("_file", "_at")
    files = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return at.join(files, "_file").withColumn("row_id", F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def materialize(df: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Write df (with row_id) in directories of bucket_rows row ids, a multiple of 64, and read it
    back: a fetch then only reads the directories that it needs."""
    if bucket_rows % 64:
        raise ValueError(f"bucket_rows must be a multiple of 64, not {bucket_rows}")
    out = df.withColumn("row_bucket", F.expr(f"row_id div {bucket_rows}"))
    out.repartition("row_bucket").sortWithinPartitions("row_id").write.mode("overwrite").partitionBy("row_bucket").parquet(path)
    return df.sparkSession.read.parquet(path).withColumn("row_bucket", F.col("row_bucket").cast("long"))
