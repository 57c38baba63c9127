"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken, SIGMOD 2003)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import order_bounds, order_keys, partitions
from .textbytes import BASE, U, mix, powers

GRAM, WINDOW = 16, 40  # characters of a k-gram, and k-grams in a window
PIECE_CHARS = 4 << 20  # of texts in a batch of results

# Ids pass through pandas as strings, as a null would turn the integers of its batch into doubles.
MARKED = "doc_id string, text string, fingerprint string, positions array<long>, hashes array<long>"
EDITED = "doc_id string, n_chars long, edited string, fingerprint string, positions array<long>, edited_fingerprint string, near_edited double, near_next double"


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of each k-gram (of code points) that is the least of some window of
    `window` k-grams, the rightmost of equals. A common substring of window + gram - 1 characters
    or more has a chosen k-gram in common. A text of fewer characters is one window; one of fewer
    than `gram` is one k-gram; an empty text has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U)
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    k = min(gram, n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(points + BASE) * powers(n)[0], dtype=U)))
        m = n - k + 1
        hashes = mix((sums[k:] - sums[:m]) * powers(n)[1][:m]) >> U(32)
    w = min(window, m)
    at = np.arange(m, dtype=U)
    v = np.full(-(-m // w) * w, U(2**64 - 1))
    v[:m] = (hashes << U(32)) | (U(2**32 - 1) - at)  # of equal hashes the later one is less
    v = v.reshape(-1, w)
    ahead, back = np.minimum.accumulate(v, axis=1).ravel(), np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - w + 1], ahead[w - 1 : m])
    chosen = np.concatenate((least[:1], least[1:][least[1:] != least[:-1]]))
    return (chosen >> U(32)).astype(np.int64), (U(2**32 - 1) - (chosen & U(2**32 - 1))).astype(np.int64)


def as_text(hashes: np.ndarray) -> str:
    """The fingerprint as a string: the chosen hashes in order, 8 hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice similarity of two fingerprints as multisets, 0 to 1; two empty ones are alike."""
    if not len(a) + len(b):
        return 1.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2.0 * float(np.minimum(nx[i], ny[j]).sum()) / (len(a) + len(b))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, fingerprint, positions, hashes) of each text; null text counts as empty."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            got = [winnow(t, gram, window) for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "fingerprint": [as_text(h) for h, _ in got], "positions": [p for _, p in got], "hashes": [h for h, _ in got]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(mark, MARKED)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def edited_text(text: str, after: str) -> str:
    """text with its last quarter (floor) of characters replaced by as many, or all there are, of
    the next text's first."""
    return text[: len(text) - len(text) // 4] + after[: len(text) // 4]


def _neighbours(gram: int, window: int):
    """For ranges of documents in order, each with the first document of the next range behind it
    as a guest: every document with the one that follows it. Only one document is held."""
    columns = [x.split()[0] for x in EDITED.split(", ")]

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out, size = [], 0
            for part, guest, d, no_id, text in zip(batch["part"], batch["guest"], batch["d"], batch["no_id"], batch["text"], strict=True):
                mark = winnow(text, gram, window)
                if last is not None and last[0] == part:
                    _, own_id, own, (hashes, positions) = last
                    edited = edited_text(own, text)
                    again = winnow(edited, gram, window)[0]
                    out.append((own_id, len(own), edited, as_text(hashes), positions, as_text(again), likeness(hashes, again), likeness(hashes, mark[0])))
                    size += len(own)
                last = None if guest else (part, None if no_id else str(d), text, mark)
                if size > PIECE_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return neighbours


def compare_with_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_chars, its edited text, both fingerprints with the positions of the
    first, and how near its fingerprint is to the edited text's and to the next document's.

    The next document is the one with the next doc_id, after the last the first. Documents are
    dealt to as many ranges of ids as there are shuffle partitions, split at sampled ids, and each
    range also gets the first document of the next one, so that texts are shuffled once and no
    window spans the table. A range is sorted by Spark, which spills, and read in a stream. Only
    some ids a partition (splitters, first ids) meet in the driver.
    Null text counts as empty. Rows with null doc_id come first; rows with equal doc_id, or none,
    are in the order of their texts' hashes, by which ranges are split too, so that only rows equal
    in both must be in one. A table of one row is its own next; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    parts = partitions(spark)
    bounds = order_bounds(rows, parts, rows.count())

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = order_keys(batch["d"], batch["h"])
            part, order = np.searchsorted(bounds, keys, "right"), np.argsort(keys)
            own, at = np.unique(part[order], return_index=True)
            yield pd.DataFrame({"part": own, "d": batch["d"].to_numpy()[order[at]], "h": batch["h"].to_numpy()[order[at]]})

    firsts = rows.select("d", "h").mapInPandas(least, "part long, d long, h long").groupBy("part").agg(F.min(F.struct("d", "h")).alias("x"))
    first = {r["part"]: tuple(r["x"]) for r in firsts.collect()}
    order = sorted(first)
    host = {first[p]: order[k - 1] for k, p in enumerate(order)}  # the range before, for each range's first row

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(part=np.searchsorted(bounds, order_keys(batch["d"], batch["h"]), "right"), guest=False)
            to = [host.get(x) for x in zip(batch["d"].tolist(), batch["h"].tolist(), strict=True)]
            if any(x is not None for x in to):
                yield batch.assign(part=to, guest=True).dropna(subset=["part"]).astype({"part": int})

    dealt = rows.mapInPandas(deal, "d long, no_id boolean, text string, h long, part int, guest boolean")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "guest", "d", "h")
    return dealt.mapInPandas(_neighbours(gram, window), EDITED).withColumn("doc_id", F.col("doc_id").cast("long"))
