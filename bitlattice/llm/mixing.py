"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Spark reference points: range partitioning by (source, key) gives sorted runs, and a prefix sum
is one sum per run, a running sum over the runs, and a window inside each run, so that a source
with a third of all rows is never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, partitions

#: Symbols of decoration and markup; the share of them lowers a document's quality weight.
SYMBOLS = "#*$%&|<>"
WEIGHTS = (5.0, 2.0, 1.0)


def quality_weight(text: Column) -> Column:
    """In [0.05, 1]: falls with the share of SYMBOLS among the characters; 1 without text."""
    n = F.length(text)
    bad = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * bad / n)), F.lit(1.0))


def uniform(seed: int, *cols: Column) -> Column:
    """A reproducible number in (0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(items: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) by water filling.

    Sources in code-point order, null last, get the weights in turn; they share `share` times all
    sizes by weight, but none more than `cap` times its own size, the excess going to the others
    by weight. In order of cap/weight the capped sources come first, so that the level is found by
    running sums over one row a source. Only these aggregated rows meet in one task.
    """
    per = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    per = per.withColumn("c", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("c") / F.col("w"), F.asc_nulls_last("source"))
    per = (
        per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("c").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(before.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("k", F.row_number().over(before))
    )
    level = F.min_by(F.when(F.col("c") / F.col("w") > F.col("level"), F.col("level")), F.when(F.col("c") / F.col("w") > F.col("level"), F.col("k"))).over(every)
    return per.select("source", "source_size", F.when(F.col("c") <= F.col("w") * F.coalesce(level, F.col("c") / F.col("w")), F.col("c")).otherwise(F.col("w") * level).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, size: Column | None = None, seed: int = 17, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, row: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, epochs, picked, copies, taken, and
    the columns `row`, which tell rows of equal doc_id and text apart.

    A source's target is so many complete epochs and a rest. Every document is taken once for each
    epoch; for the rest, documents are drawn without replacement with probability by quality
    weight: exponential keys -ln(u)/weight, ascending, taken while the running size, counted to a
    document's middle, stays within the rest. So each source misses its target by half a document
    at most, unless it is smaller than that.

    Null text has size 0; null sources are a source of their own; repeated rows are documents of
    their own, each with copies of its own; those of one doc_id, or without, but of other texts have keys of their
    own, so that no id's rows stand in one run, and only rows equal in both have equal keys (in the order of
    `row`, else any). An empty table gives no rows. Reruns agree: u hangs on doc_id, text and seed alone. Other columns are ignored.
    """
    spark = docs.sparkSession
    weight = quality_weight(F.col("text")) if weight is None else weight
    size = n_words(F.col("text")) if size is None else size
    items = docs.select("doc_id", "source", size.alias("size"), (-F.log(uniform(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))) / weight).alias("key"), *row)
    items = cut(items, "mix-items")
    runs = items.repartitionByRange(partitions(spark), F.asc_nulls_last("source"), "key", "doc_id", *row).withColumn("run", F.spark_partition_id())
    runs = cut(runs, "mix-runs")
    targets = source_targets(items, weights, share, cap)
    totals = runs.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    before = F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("before", F.coalesce(before, F.lit(0)))
    plan = totals.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select("r.source", "r.run", "r.before", "t.source_size", "t.target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    inside = F.sum("size").over(Window.partitionBy("source", "run").orderBy("key", "doc_id", *row).rowsBetween(Window.unboundedPreceding, 0))
    out = runs.withColumn("upto", inside).alias("d").join(plan.alias("p"), F.expr("d.run = p.run AND d.source <=> p.source"))
    picked = (F.col("before") + F.col("upto") - F.col("size") / 2) < F.col("rest")
    out = out.select("d.doc_id", "d.source", "size", "source_size", "target", "epochs", picked.alias("picked"), *row)
    return out.withColumn("copies", F.col("epochs") + F.col("picked").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
