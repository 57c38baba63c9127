"""Interpolated modified Kneser-Ney model of character n-grams (Chen and Goodman 1998), counted and
looked up by sharded joins, and a quality classifier by its perplexities.

An n-gram of four characters is one long, 16 bits a character (characters beyond the basic plane
are folded into 16 bits); its context is the long shifted right by 16, and the n-gram of the next
lower order its low bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, order_bounds, order_keys, release

ORDER = 4
BLOCK_ROWS = 8_000  # documents whose distinct n-grams are looked up together
BLOCK_BYTES = 64 << 20  # of their texts on average, at most
CHUNK = 1 << 20  # n-grams that are sorted at once
QUANTILE = 0.99  # of the trusted documents' perplexities, for each language

# Ids pass through pandas as strings, as a null would turn the integers of its batch into doubles.
PACKED = "block long, ids array<string>, langs array<string>, sizes array<int>, data binary"
SCORED = "doc_id string, lang string, perplexity double"


def grams(text: str) -> np.ndarray:
    """The n-gram that ends in each character of the text, which starts behind ORDER - 1 zeros."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    points = np.concatenate((np.zeros(ORDER - 1, dtype=np.uint64), (points ^ (points >> np.uint64(16))) & np.uint64(0xFFFF)))
    out = np.zeros(len(points) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | points[k : k + len(out)]
    return out.view(np.int64)


def tally(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all texts, ascending, and their counts; CHUNK n-grams or those of
    one text are held at a time besides."""
    keys = counts = np.zeros(0, dtype=np.int64)
    waiting, size = [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        new, c = np.unique(np.concatenate(waiting), return_counts=True)
        both, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
        return both, np.bincount(at, weights=np.concatenate((counts, c)), minlength=len(both)).astype(np.int64)

    for text in texts:
        waiting.append(grams(text))
        size += len(waiting[-1])
        if size > CHUNK:
            keys, counts = fold()
            waiting, size = [], 0
    return fold() if waiting else (keys, counts)


def _placed(docs: DataFrame) -> DataFrame:
    """docs with what their place in the order of ids and texts' hashes hangs on: (d, h)."""
    return docs.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))


def _blocks(bounds: np.ndarray, batch: pd.DataFrame) -> np.ndarray:
    return np.searchsorted(bounds, order_keys(batch["d"], batch["h"]), "right")


def pack_blocks(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(PACKED): documents by range of ids and texts' hashes, compressed, for a shuffle by block. So
    rows of one id, or of none, are in blocks of their own size, unless their texts are equal too."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for batch in batches:
            out = []
            for block, rows in batch.groupby(_blocks(bounds, batch)):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
                out.append((block, rows["doc_id"].tolist(), rows["lang"].tolist(), [len(t) for t in texts], zstandard.compress(b"".join(texts), 3)))
            yield pd.DataFrame(out, columns=["block", "ids", "langs", "sizes", "data"])

    return _placed(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text", "d", "h").mapInPandas(packed, PACKED)


def _unpack(row: tuple) -> Iterator[tuple[str | None, str | None, str]]:
    import zstandard

    data, at = zstandard.decompress(row.data), 0
    for doc_id, lang, size in zip(row.ids, row.langs, row.sizes, strict=True):
        yield doc_id, lang, data[at : at + size].decode("utf-8", "surrogatepass")
        at += size


def count_grams(docs: DataFrame, packed: DataFrame, trusted: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(key, c): how often each n-gram of highest order occurs in the trusted documents (doc_id)."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["d"].astype(str), "block": _blocks(bounds, batch)})

    def count(texts: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        wanted = set(ids["doc_id"])
        keys, c = tally(t for row in texts.itertuples() for doc_id, _, t in _unpack(row) if doc_id in wanted)
        return pd.DataFrame({"key": keys, "c": c})

    # Only ids and hashes are joined with the trusted ids, so that no text is shuffled for them.
    ids = _placed(docs).select("doc_id", "d", "h").join(trusted, "doc_id").select("d", "h").distinct().mapInPandas(place, "doc_id string, block long")
    counts = packed.groupBy("block").cogroup(ids.groupBy("block")).applyInPandas(count, "key long, c long")
    return counts.groupBy("key").agg(F.sum("c").alias("c"))


@dataclass
class KneserNey:
    """For each order n from 1: grams[n] (key, c), contexts[n] (key, total, back) and discounts[n];
    c counts occurrences at the highest order and distinct left neighbours below it."""

    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    discounts: dict[int, tuple[float, float, float]]
    symbols: int

    def taken(self, n: int, c: Column) -> Column:
        one, two, more = self.discounts[n]
        return F.when(c == 1, one).when(c == 2, two).otherwise(more)

    def log_probabilities(self, keys: DataFrame) -> DataFrame:
        """(key, logp) for distinct n-grams of highest order, each by joins with the counts of all
        orders; a context that was never seen passes its whole mass to the next lower order."""
        out = keys
        for n in range(1, ORDER + 1):
            low = F.col("key").bitwiseAND(_low(n))
            seen = self.grams[n].select(F.col("key").alias("g"), F.col("c").alias(f"c{n}"))
            context = self.contexts[n].select(F.col("key").alias("x"), F.col("total").alias(f"t{n}"), F.col("back").alias(f"b{n}"))
            out = out.withColumn("_g", low).join(seen, F.col("_g") == F.col("g"), "left").drop("g")
            out = out.withColumn("_x", F.shiftrightunsigned("_g", 16)).join(context, F.col("_x") == F.col("x"), "left").drop("x", "_g", "_x")
        p = F.lit(1.0 / (self.symbols + 1))
        for n in range(1, ORDER + 1):
            own = F.coalesce((F.col(f"c{n}") - self.taken(n, F.col(f"c{n}"))) / F.col(f"t{n}"), F.lit(0.0))
            p = own + F.coalesce(F.col(f"b{n}"), F.lit(1.0)) * p
        return out.select("key", F.log(p).alias("logp"))


def _low(n: int) -> Column:
    """The bits of the last n characters."""
    return F.lit(-1 if n == 4 else (1 << (16 * n)) - 1).cast("long")


def kneser_ney(counts: DataFrame) -> KneserNey:
    """The model of the counts (key, c) of highest order. Only counts of counts reach the driver."""
    grams, contexts, discounts = {ORDER: cut(counts, "grams4")}, {}, {}
    for n in range(ORDER - 1, 0, -1):
        lower = grams[n + 1].groupBy(F.col("key").bitwiseAND(_low(n)).alias("key")).agg(F.count("*").alias("c"))
        grams[n] = cut(lower, f"grams{n}")
    model = KneserNey(grams, contexts, discounts, grams[1].count())
    for n in range(1, ORDER + 1):
        got = dict(grams[n].where("c <= 4").groupBy("c").count().collect())
        n1, n2, n3, n4 = (got.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [k - (k + 1) * y * (after / before) if before and n1 else y for k, before, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discounts[n] = tuple(min(max(d, 0.05), 0.95 * k) for k, d in enumerate(raw, 1))
        mass = grams[n].groupBy(F.shiftrightunsigned("key", 16).alias("key")).agg(F.sum("c").alias("total"), F.sum(model.taken(n, F.col("c"))).alias("off"))
        contexts[n] = mass.select("key", "total", (F.col("off") / F.col("total")).alias("back"))
    return model


def perplexities(docs: DataFrame, packed: DataFrame, bounds: np.ndarray, model: KneserNey) -> DataFrame:
    """(SCORED): the perplexity per character of each document, null for an empty text.

    Each block asks for its distinct n-grams; their probabilities come by joins and go back to the
    block, where the texts are, so that neither the model nor an n-gram's postings meet in a task."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, rows in batch.groupby(_blocks(bounds, batch)):
                yield pd.DataFrame({"key": tally(t for t in rows["text"] if t)[0]}).assign(block=block)

    def rate(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("key")
        keys, logp = answers["key"].to_numpy(), answers["logp"].to_numpy()
        out = []
        for row in texts.itertuples():
            for doc_id, lang, text in _unpack(row):
                out.append((doc_id, lang, float(np.exp(-logp[np.searchsorted(keys, grams(text))].mean())) if text else None))
        return pd.DataFrame(out, columns=["doc_id", "lang", "perplexity"])

    asked = cut(_placed(docs).select("text", "d", "h").mapInPandas(ask, "block long, key long").distinct(), "asked")
    known = cut(model.log_probabilities(asked.select("key").distinct()), "known")
    answers = asked.join(known, "key").select("block", "key", "logp")
    scored = cut(packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(rate, SCORED).withColumn("doc_id", F.col("doc_id").cast("long")), "scored")
    drop(asked, known)
    return scored


def _limit(value: Column, quantile: float) -> Column:
    """The quantile of values, or the bound of a further one where they are too few (see classify);
    null for fewer than two."""
    n, z = F.count(value), NormalDist().inv_cdf(quantile)
    exact = F.percentile_approx(value, quantile, 100_000)  # the accuracy
    # Student's t by its expansion in 1 / degrees of freedom.
    free = F.nullif(n - 1, F.lit(0))
    t = F.lit(z) + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free * free)
    bound = F.exp(F.avg(F.log(value)) + t * F.stddev_samp(F.log(value)) * F.sqrt(1 + 1 / (free + 1)))
    return F.when(n * (1 - quantile) >= 1 - 1e-9, exact).otherwise(bound)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, held_out: int = 5) -> DataFrame:
    """Per row of docs: doc_id, lang, perplexity, threshold, kept.

    The model is trained on the documents with a label of quality 1, except one in held_out by a
    hash of the id; a language's threshold is the `quantile` of those held out in it. Fewer
    than 1 / (1 - quantile) of them don't reach that far: there it is the value that a further
    document stays below with that probability, logarithms being normal (of all held out where a
    language has one or none, infinity without any). A document is kept if its perplexity doesn't
    exceed the threshold.

    Null and empty texts have no perplexity and aren't kept; null languages are one language;
    rows without doc_id are never trusted; repeated rows are scored alike (and counted as often);
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bounds = order_bounds(_placed(docs), max(1, -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES)), n, 4)
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    out = F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0
    packed = pack_blocks(docs, bounds)
    model = kneser_ney(count_grams(docs, packed, trusted.where(~out), bounds))
    release(spark)
    scored = perplexities(docs, packed, bounds, model)
    drop(*model.grams.values())
    release(spark)
    held = scored.join(trusted.where(out), "doc_id")
    limits = held.groupBy("lang").agg(_limit(F.col("perplexity"), quantile).alias("limit"))
    overall = held.agg(_limit(F.col("perplexity"), quantile)).first()[0]
    limits = limits.select(F.coalesce("lang", F.lit("")).alias("_lang"), "limit")
    threshold = F.coalesce("limit", F.lit(float("inf") if overall is None else float(overall)))
    rows = scored.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(limits, "_lang", "left").withColumn("threshold", threshold)
    return rows.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
