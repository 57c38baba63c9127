"""Quality rules: counts over whole texts, and lines labelled content or boilerplate by a CRF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, partitions
from .crf import LinearChain, fit

SAMPLE, LINES = 4_000, 400_000  # labelled documents that the field is fitted on at most, and their lines
MIN_CONTENT = 0.5  # share of a document's word characters in content lines

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_LINK = re.compile(r"https?://|www\.|@\w")
_ODD = re.compile(r"[#*$%&|<>]")
_SHOUT = re.compile(r"[!?]{2}")
FEATURES = ("line", "no words", "1-2 words", "3-5 words", "6-12 words", "13-40 words", "more words", "some symbols", "many symbols", "capitals", "some digits", "many digits", "ends a sentence", "ends in a letter", "bars", "earlier line", "few different words", "long words", "short words", "link", "comma", "shouts", "first", "last", "capital first")
_BIT = {name: 1 << k for k, name in enumerate(FEATURES)}


def line_masks(text: str) -> tuple[list[int], list[int], int]:
    """(features as bits, word characters) of each line, and how many lines with a word repeat an
    earlier one."""
    masks, sizes, repeats = [], [], 0
    seen: set[str] = set()
    lines = text.split("\n")
    for line in lines:
        words = line.split()
        mask = _BIT["line"]
        if not words:
            masks.append(mask | _BIT["no words"])
            sizes.append(0)
            repeats += line in seen and bool(line.strip(SPACE))
            seen.add(line)
            continue
        n = len(words)
        size = len(line) - line.count(" ")
        if line in seen:
            mask |= _BIT["earlier line"]
            repeats += bool(line.strip(SPACE))
        seen.add(line)
        mask |= _BIT["1-2 words" if n < 3 else "3-5 words" if n < 6 else "6-12 words" if n < 13 else "13-40 words" if n < 41 else "more words"]
        odd = len(_ODD.findall(line))
        if odd:
            mask |= _BIT["many symbols"] if odd * 10 > size else _BIT["some symbols"] if odd * 50 > size else 0
            if line.count("|") * 3 >= n:
                mask |= _BIT["bars"]
        upper = line.upper() == line and line.lower() != line
        if upper:
            mask |= _BIT["capitals"]
        if not line.isascii() or any(c in line for c in "0123456789"):
            digits = sum(map(line.count, "0123456789"))
            mask |= _BIT["many digits"] if digits * 4 > size else _BIT["some digits"] if digits * 20 > size else 0
        end = words[-1][-1]
        mask |= _BIT["ends a sentence"] if end in ".!?" else _BIT["ends in a letter"] if end.isalpha() else 0
        if n > 5 and len(set(words)) * 2 < n:
            mask |= _BIT["few different words"]
        mask |= _BIT["long words"] if size > 12 * n else _BIT["short words"] if size < 3 * n else 0
        if ("http" in line or "www." in line or "@" in line) and _LINK.search(line):
            mask |= _BIT["link"]
        if "," in line:
            mask |= _BIT["comma"]
        if ("!" in line or "?" in line) and _SHOUT.search(line):
            mask |= _BIT["shouts"]
        if words[0][0].isupper():
            mask |= _BIT["capital first"]
        masks.append(mask)
        sizes.append(size)
    if masks:
        masks[0] |= _BIT["first"]
        masks[-1] |= _BIT["last"]
    return masks, sizes, repeats


def repeat_words(words: list[bytes]) -> int:
    """How many words are in a three-word window that the text has twice or more; none of a text
    of fewer than four words."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    if not twice.any():
        return 0
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double"


def text_stats(text: str | None, field: LinearChain) -> tuple[int, int, int, int, int, float]:
    """STATS of a whole text. content_share: word characters in the lines that Viterbi decoding
    marks as content, of all; 0 without any."""
    if not text:
        return 0, 0, 0, 0, 0, 0.0
    words = text.encode("utf-8", "surrogatepass").split()
    masks, sizes, repeats = line_masks(text)
    labels = field.viterbi(masks)
    total = sum(sizes)
    content = sum(s for s, y in zip(sizes, labels, strict=True) if y == 1)
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), repeats, repeat_words(words), content / total if total else 0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> LinearChain:
    """Fit the field on `sample` labelled documents at most, those whose ids hash least, and of
    these on whole documents with `lines` lines altogether at most, in order of their texts' hashes
    (a document that alone has more is passed over).

    Lines have no labels of their own. Those of a document of quality 1 count as content, unless
    they repeat an earlier line; all others as boilerplate. Equal texts count once. Null ids,
    labels and texts are passed over.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("id")).agg(F.min("quality").alias("quality"), F.min("text").alias("text"))

    def masks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "quality": batch["quality"], "masks": [line_masks(t)[0] for t in batch["text"]]})

    held = cut(rows.repartition(partitions(docs.sparkSession), "id").mapInPandas(masks_of, "id long, quality int, masks array<long>"), "lines")
    # One row for each of `sample` documents at most is in the window.
    each = held.select("id", F.size("masks").alias("n")).where(F.col("n") <= lines)
    upto = F.sum("n").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    got = held.join(each.withColumn("upto", upto).where(F.col("upto") <= lines).select("id"), "id", "left_semi").orderBy("id").collect()
    drop(held)
    poor = _BIT["earlier line"] | _BIT["no words"]
    return fit([r["masks"] for r in got], [[int(r["quality"] == 1 and not m & poor) for m in r["masks"]] for r in got], len(FEATURES))


def judge(docs: DataFrame, field: LinearChain, min_words: int = 50, repeat_percent: int = 50, min_content: float = MIN_CONTENT) -> DataFrame:
    """Per row of docs: doc_id, STATS, base_failed (fewer than min_words words, or more than
    repeat_percent of them in repeated three-word windows) and kept (false if base_failed, else
    whether content_share is min_content at least).

    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table
    gives no rows; other columns are ignored.
    """

    names = [x.split()[0] for x in STATS.split(", ")]

    @F.pandas_udf(STATS)
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t, field) for t in texts], columns=names)

    out = docs.select("doc_id", stats("text").alias("s")).select("doc_id", "s.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= min_content))
