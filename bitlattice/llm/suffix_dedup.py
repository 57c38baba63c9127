"""Removal of long repeated byte strings by a distributed sparse suffix array.

Every string of `length` bytes has an anchor: the place of its least `gram`-byte hash (the leftmost
of equals). Equal strings have it at the same place, so it is enough to sort the suffixes that
start at anchors, about one in 185 bytes, instead of all. The strings of one anchor are
neighbours in the text; together they are its context, and two strings of different contexts are
equal if and only if they have as many bytes before the anchor in common as they have there, and
likewise behind it.

Texts may also be read as words: each then stands for its hash of WORD bytes, and only strings of
whole words count (`unit`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, drop, partitions, release
from .textbytes import U, mix, prefix_sums, span_hashes, word_hashes, word_places

LENGTH, GRAM = 400, 32
WORD, GRAM_WORDS = 6, 5  # bytes of a word's hash, and words of a gram where texts are read as words
PASSAGE_WORDS = 50  # of a run of words that counts as a repeated passage, at least
BUCKET_BYTES = 8 << 20  # of contexts in a bucket
COMMON = 32  # contexts of one gram from which on splitters between them are whole suffixes

ANCHORS = "doc long, th long, key long, ctx long, lo int, size int, a int"
CONTEXTS = "key long, ctx long, copies boolean, common boolean, a int, bytes binary"
BEHIND = ", behind binary"  # the gram at the anchor, then the bytes before it, last first
LCS = ", lcs int"  # at most so many bytes before the anchor are common with another context
FOUND = "key long, ctx long, j0 int, j1 int, w1 long, w2 long, bucket int"
_CTX = U(0xD6E8FEB86659FD93)


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> tuple[np.ndarray, ...]:
    """(key, ctx, lo, size, a) of each anchor: hashes of its gram and of its context, where the
    context starts, its bytes, and how many of them stand before the anchor."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),) * 3
    n_windows, w = (len(data) - length) // unit + 1, (length - gram) // unit + 1
    sums = prefix_sums(np.frombuffer(data, dtype=np.uint8))
    at = np.arange(0, len(data) - gram + 1, unit)
    grams = span_hashes(sums, at, at + gram)
    # The least hash in each window of w grams: running minima from both ends of blocks of w.
    v = np.full(-(-len(grams) // w) * w, U(2**64 - 1))
    v[: len(grams)] = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams)).astype(U)
    v = v.reshape(-1, w)
    ahead, back = np.minimum.accumulate(v, axis=1).ravel(), np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    x = (np.minimum(back[:n_windows], ahead[w - 1 : w - 1 + n_windows]) & U(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1))
    lo, hi = first * unit, (np.concatenate((first[1:], [n_windows])) - 1) * unit + length
    x = x[first]
    return grams[x].view(np.int64), mix(span_hashes(sums, lo, hi) ^ _CTX).view(np.int64), lo.astype(np.int32), (hi - lo).astype(np.int32), (x * unit - lo).astype(np.int32)


def _units(text: bytes, unit: int) -> bytes:
    """The text itself, or where units are words the hashes of its words, `unit` bytes each."""
    return text if unit == 1 else word_hashes(text).view(np.uint8).reshape(-1, 8)[:, :unit].tobytes()


def _anchor_rows(length: int, gram: int, unit: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [anchors(_units(t or b"", unit), length, gram, unit) for t in batch["text"]]
            counts = [len(g[0]) for g in got]
            if sum(counts):
                cols = [np.concatenate(c) for c in zip(*got, strict=True)]
                yield pd.DataFrame({"doc": np.repeat(batch["doc"].to_numpy(), counts), "th": np.repeat(batch["th"].to_numpy(), counts)} | dict(zip(("key", "ctx", "lo", "size", "a"), cols, strict=True)))

    return rows


def _cut_out(gram: int, unit: int):
    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                units = _units(text, unit)
                for p in wanted:
                    data, a = units[p["lo"] : p["lo"] + p["size"]], p["a"]
                    out.append((p["key"], p["ctx"], p["n"] > 1, p["common"], a, data, data[a : a + gram] + data[:a][::-1]))
            yield pd.DataFrame(out, columns=["key", "ctx", "copies", "common", "a", "bytes", "behind"])

    return cut_out


def multikey_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the strings data[start : start + size]: multikey quicksort with characters
    of 8 bytes, all subproblems of one depth at a time. At each depth the strings that are still
    equal to another are split by their next character; lcp[i] is what the i-th in order has in
    common with the one before it. data ends with 8 spare bytes; shorter strings come first."""
    n = len(starts)
    order, lcp = np.arange(n), np.zeros(n, dtype=np.int64)
    head = np.zeros(n, dtype=bool)  # where a group of strings equal so far begins
    head[:1] = True
    active, depth = np.arange(n), 0  # places in order that are in a group of two or more
    while len(active) > 1:
        who = order[active]
        left = sizes[who] - depth
        at = np.minimum(starts[who] + depth, len(data) - 8)
        token = data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(U)
        shift = (U(8) * (U(8) - np.clip(left, 0, 8).astype(U))).astype(U)
        token = np.where(shift >= U(64), U(0), (token >> np.minimum(shift, U(63))) << np.minimum(shift, U(63)))
        group = np.cumsum(head[active])
        by = np.lexsort((left.clip(0, 8), token, group))
        order[active], token, left = who[by], token[by], left[by].clip(0, 8)
        same_group = ~head[active][1:]
        split = same_group & ((token[1:] != token[:-1]) | (left[1:] != left[:-1]))
        differ = token[1:] ^ token[:-1]
        bits = np.zeros(len(differ), dtype=np.int64)
        for step in (32, 16, 8):  # leading zero bytes of the difference, times 8
            zero = (differ >> U(64 - step)) == 0
            bits[zero] += step
            differ[zero] <<= U(step)
        common = np.minimum(np.where(token[1:] == token[:-1], 8, bits // 8), np.minimum(left[1:], left[:-1]))
        places = active[1:][split]
        lcp[places] = depth + common[split]
        head[places] = True
        # Equal strings that end here stay together for good.
        ended = np.concatenate(([False], same_group & ~split & (left[1:] < 8)))
        lcp[active[ended]] = sizes[order[active[ended]]]
        lonely = head[active] & np.concatenate((head[active][1:], [True]))
        first_of_ended = head[active] & (left < 8)
        active = active[~(lonely | ended | first_of_ended)]
        depth += 8
    return order, lcp


def _bucket_rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = list(batches)
    rows = pd.concat(parts, ignore_index=True).drop_duplicates(["key", "ctx"], ignore_index=True) if parts else None
    return rows if rows is not None and len(rows) else None


def _most(order: np.ndarray, lcp: np.ndarray, whole: np.ndarray, common: np.ndarray, gram: int) -> np.ndarray:
    """For each string what it has in common with any other string of all buckets, at most. In
    sorted order none has more than a neighbour; but the first and the last of a bucket may have
    their nearest neighbour beyond its boundary, and so may all strings of the first and last
    group of equal grams, unless they are split by whole suffixes: these count with their whole length."""
    near = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    group = np.cumsum(lcp < gram)
    open_ = np.isin(group, group[[0, -1]]) & ~common[order]
    open_[[0, -1]] = True
    near = np.where(open_, whole[order], near)
    out = np.empty_like(near)
    out[order] = near
    return out


def _behind(gram: int):
    """lcs of each context, from a bucket of contexts in order of what stands before the anchors."""

    def behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (rows := _bucket_rows(batches)) is None:
            return
        sizes = np.array([len(b) for b in rows["behind"]])
        buffer = np.frombuffer(b"".join(rows["behind"]) + bytes(8), dtype=np.uint8)
        lcs = _most(*multikey_sort(buffer, np.cumsum(sizes) - sizes, sizes), sizes, rows["common"].to_numpy(bool), gram) - gram
        yield rows.drop(columns="behind").assign(lcs=np.maximum(lcs, -1))

    return behind


def _bucket(length: int, gram: int, unit: int):
    """For all contexts of a range partition: runs of repeated strings j0..j1 (places in the
    context), and for the first and last group, whose anchors' grams other partitions may have
    too, one of each set of equal strings that could be elsewhere, with two 64-bit hashes."""

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (rows := _bucket_rows(batches)) is None:
            return
        number = int(rows["part"].iloc[0])
        sizes = np.array([len(b) for b in rows["bytes"]])
        buffer = np.frombuffer(b"".join(rows["bytes"]) + bytes(8), dtype=np.uint8)
        ends = np.cumsum(sizes)
        begin, a = ends - sizes, rows["a"].to_numpy().astype(np.int64)
        order, lcp = multikey_sort(buffer, begin + a, sizes - a)
        group = np.cumsum(np.concatenate(([0], (lcp[1:] < gram).astype(np.int64))))  # in order: equal grams
        mirror = np.concatenate((buffer[:-8][::-1], np.zeros(8, np.uint8)))
        back_order, back_lcp = multikey_sort(mirror, len(buffer) - 8 - (begin + a), a)
        rank, back_rank = np.empty_like(order), np.empty_like(order)
        rank[order], back_rank[back_order] = np.arange(len(order)), np.arange(len(order))
        windows = sizes - length + 1
        fewest, most = length - _most(order, lcp, sizes - a, rows["common"].to_numpy(bool), gram), rows["lcs"].to_numpy()  # bytes before the anchor
        outer = np.isin(group, group[[0, -1]])[rank]
        repeated = np.zeros((len(rows), (length - gram) // unit + 1), dtype=bool)
        asked = []
        for left in range(0, length - gram + 1, unit):
            j = a - left
            those = np.flatnonzero((j >= 0) & (j < windows) & (fewest <= left) & (left <= most))
            if not len(those):
                continue
            ahead = np.cumsum(lcp < length - left)[rank[those]]
            behind = np.cumsum(back_lcp < left)[back_rank[those]] if left else 0
            _, one, which, count = np.unique(ahead * (len(rows) + 1) + behind, return_index=True, return_inverse=True, return_counts=True)
            repeated[those, left // unit] = count[which] > 1
            ask = those[one][outer[those[one]]]
            asked.append(np.stack((ask, a[ask] - left)))
        keys, ctxs = rows["key"].to_numpy(), rows["ctx"].to_numpy()
        yield _runs(repeated, a, unit, keys, ctxs, rows["copies"].to_numpy(bool), number)
        who, at = np.concatenate(asked, axis=1) if asked else np.zeros((2, 0), np.int64)
        by = np.argsort(who, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(who[by])) + 1) if len(by) else ():
            i, places = who[part[0]], at[part]
            data = buffer[begin[i] : ends[i]]
            w1, w2 = (span_hashes(prefix_sums(d), places, places + length) for d in (data, data ^ np.uint8(0x5A)))
            yield pd.DataFrame({"key": keys[i], "ctx": ctxs[i], "j0": places, "j1": places, "w1": w1.view(np.int64), "w2": w2.view(np.int64), "bucket": number})

    return bucket


def _runs(repeated: np.ndarray, a: np.ndarray, unit: int, keys: np.ndarray, ctxs: np.ndarray, copies: np.ndarray, number: int) -> pd.DataFrame:
    """The maximal runs of repeated strings of each context that isn't repeated as a whole."""
    wide = np.zeros((len(a), repeated.shape[1] + 2), dtype=np.int8)
    wide[:, 1:-1] = repeated & ~copies[:, None]
    step = np.diff(wide, axis=1)
    i, first = np.nonzero(step == 1)
    _, past = np.nonzero(step == -1)
    return pd.DataFrame({"key": keys[i], "ctx": ctxs[i], "j0": (a[i] - (past - 1) * unit).astype(np.int32), "j1": (a[i] - first * unit).astype(np.int32), "w1": pd.array([None] * len(i), dtype="Int64"), "w2": pd.array([None] * len(i), dtype="Int64"), "bucket": number})


def _remove(as_text: bool, unit: int):
    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, spans = [], []
            for text, found in zip(batch["text"], batch["found"], strict=True):
                merged: list[list[int]] = []
                for s, e in sorted((f["s"], f["e"]) for f in (found if found is not None else ())):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                if merged and unit > 1:  # from words to bytes
                    starts, ends = word_places(text)
                    merged = [[int(starts[s // unit]), int(ends[e // unit - 1])] for s, e in merged]
                cuts = [0, *(x for m in merged for x in m), len(text)]
                left = b"".join(text[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True)) if merged else text
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                spans.append([{"start": s, "end": e} for s, e in merged])
            yield pd.DataFrame({"kept": kept, "spans": spans}).join(batch.drop(columns=["text", "found"]))

    return remove


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> DataFrame:
    """(doc, th, found): for each text with repeats, the byte ranges (s, e) found, which may
    overlap. docs has doc, th, text (binary). With a unit other than 1, texts are read as their words' hashes
    of so many bytes; length, gram, s and e are multiples of it. See :func:`remove_repeats`."""
    spark = docs.sparkSession
    all_anchors = cut(docs.mapInPandas(_anchor_rows(length, gram, unit), ANCHORS), "anchors")
    # Contexts that occur twice are repeated as a whole; copies meet in one pre-aggregated row.
    contexts = all_anchors.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "lo", "size", "a")).alias("at"))
    contexts = cut(contexts.select("key", "ctx", "n", "at.*"), "contexts")
    release(spark)
    # Others can only share strings with the other contexts of their anchor's gram.
    several = contexts.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("n")).where("c > 1 AND n = 1").select("key", (F.col("c") > COMMON).alias("common"))
    wanted = cut(contexts.join(several, "key"), "wanted")
    whole = cut(contexts.where("n > 1").select("key", "ctx", F.lit(0).alias("j0"), (F.col("size") - length).alias("j1")), "whole")
    drop(contexts)
    release(spark)
    of_doc = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("key", "ctx", "n", "common", "lo", "size", "a")).alias("wanted"))
    pieces = cut(docs.join(of_doc, ["doc", "th"]).select("text", "wanted").mapInPandas(_cut_out(gram, unit), CONTEXTS + BEHIND), "pieces")
    release(spark)
    total = wanted.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    # Buckets are ranges, split at sampled leading bytes, a gram of them; only contexts of a gram that
    # COMMON others have too are split by their whole suffixes. ctx splits equal ones. First by what
    # stands before the anchors, to bound what contexts have in common there, then by the suffixes.
    leading = lambda c: F.when(F.col("common"), c).otherwise(F.substring(c, 1, gram))
    bounded = pieces.repartitionByRange(n_buckets, leading(F.col("behind")), "ctx").mapInPandas(_behind(gram), CONTEXTS + LCS)
    bounded = cut(bounded, "bounded")
    drop(pieces)
    suffix = F.expr("substring(bytes, a + 1)")
    buckets = bounded.repartitionByRange(n_buckets, leading(suffix), "ctx").withColumn("part", F.spark_partition_id())
    found = cut(buckets.mapInPandas(_bucket(length, gram, unit), FOUND), "found")
    # Across boundaries: strings of the outer groups that another bucket has as well.
    outer = found.where("w1 IS NOT NULL")
    both = outer.groupBy("w1", "w2").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo < hi").select("w1", "w2")
    across = outer.join(both, ["w1", "w2"], "left_semi").select("key", "ctx", "j0", "j1")
    runs = found.where("w1 IS NULL").select("key", "ctx", "j0", "j1").union(across).join(whole, ["key", "ctx"], "left_anti")
    hits = all_anchors.join(runs.union(whole), ["key", "ctx"])
    hits = hits.select("doc", "th", (F.col("lo") + F.col("j0")).alias("s"), (F.col("lo") + F.col("j1") + length).alias("e"))
    spans = cut(hits.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e")).alias("found")), "spans")
    drop(all_anchors, wanted, whole, bounded, found)
    release(spark)
    return spans


def _covered(found: Column) -> Column:
    """How many bytes the ranges (s, e) cover, which may overlap."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda x, f: F.struct(F.greatest(x["to"], f["e"]).alias("to"), (x["n"] + F.greatest(F.lit(0), f["e"] - F.greatest(x["to"], f["s"]))).alias("n"))
    return F.aggregate(F.array_sort(found), start, step, lambda x: x["n"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False, words: int = 0, count_words: int = 0) -> DataFrame:
    """docs, whose text is replaced by kept (binary, or with as_text a string that leaves out
    characters of which a part was removed) and spans. kept has the text's UTF-8 bytes without each byte that is
    covered by a string of `length` bytes which also starts anywhere else, in the same document
    or another; spans are the maximal removed ranges of bytes in order. Strings don't cross
    documents and are judged on the input.

    With `words` (GRAM_WORDS at least), the strings are runs of so many words instead, however
    many bytes they have; they are removed from their first word's start to their last one's end,
    and the white space between words doesn't matter. With `count_words`, n_repeated_words is how
    many words of the text stand in runs of so many words that also start elsewhere; these aren't
    removed.

    Null texts count as empty, and texts that are shorter than such a string have none; their
    bytes are kept (for null text kept is empty, was_null true). Documents are told apart by doc_id and text, so null or repeated ids do no
    harm; repeated rows are repeats of each other and go wholly if long enough. An empty table
    gives no rows. All other columns of docs are returned, under whatever names,
    but for older ones named as those made here, which these replace.
    """
    made = ["kept", "spans", "was_null", *(["n_repeated_words"] if count_words else [])]
    rest = [c for c in docs.columns if c not in ("text", *made)]
    inner = docs.select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"),
        F.xxhash64("text").alias("th"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        F.col("text").isNull().alias("was_null"),
        *(F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(rest)),
    )
    texts = inner.select("doc", "th", "text")
    of_words = lambda n: repeated_spans(texts, n * WORD, GRAM_WORDS * WORD, WORD)
    spans = of_words(words) if words else repeated_spans(texts, length, gram)
    if count_words:
        counted = of_words(count_words).select("doc", "th", (_covered(F.col("found")) / WORD).cast("long").alias("n_repeated_words"))
        spans = spans.join(counted, ["doc", "th"], "full")
    # Integers pass through pandas as strings, as a null would turn those of its batch into doubles.
    kinds = {c: docs.schema[c].dataType for c in rest}
    whole = {c for c in rest if isinstance(kinds[c], IntegralType)}
    rows = inner.join(spans, ["doc", "th"], "left")
    counts = [F.coalesce("n_repeated_words", F.lit(0)).cast("long").alias("n_repeated_words")] if count_words else []
    shaped = rows.select("text", "found", *(F.col(f"c_{k}").cast("string").alias(f"c_{k}") if c in whole else f"c_{k}" for k, c in enumerate(rest)), "was_null", *counts)
    fields = ", ".join([f"c_{k} {'string' if c in whole else kinds[c].simpleString()}" for k, c in enumerate(rest)] + ["was_null boolean"] + ["n_repeated_words long"] * bool(count_words))
    out = shaped.mapInPandas(_remove(as_text, WORD if words else 1), f"kept {'string' if as_text else 'binary'}, spans array<struct<start:int,end:int>>, {fields}")
    return out.select(*(F.col(f"c_{k}").cast(kinds[c]).alias(c) for k, c in enumerate(rest)), *made)
