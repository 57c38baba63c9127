"""Best-fit packing of token sequences, certified by dual-feasible-function lower bounds."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, partitions

CAPACITY, END = 1024, 2
PART_ITEMS = 20_000  # items packed in one task in the first round
FAN = 4  # partitions whose documents are exchanged with each other

# Ids pass through pandas as strings, as a null would turn the integers of its batch into doubles.
PIECE = "doc_id string, piece int, start long, length long, ids binary"
# Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: visible Latin-1 characters
    stand for themselves, the other bytes, in order, for the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as by tokenizers' encode(text, add_special_tokens=False): a special token that
    stands in the text as such has its one id.

    Where each merge makes a larger id than the one before it, merging in order of ids is the same
    as in order of merges; tiktoken does that some four times as fast as tokenizers, with the same
    ids. A file of any other kind goes through tokenizers.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"].get("vocab", {})
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", ())]
        made = [vocabulary.get("".join(m), -1) for m in merges]
        split = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", ())
        loose = any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        plain = not loose and spec["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
        if plain and made and made[0] >= 0 and all(x < y for x, y in pairwise(made)):
            import tiktoken

            special, byte = {t["content"]: t["id"] for t in added}, _byte_of_symbol()
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
            fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
            self.encode = lambda text: fast.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            self.encode = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, text: str) -> bytes:
        """As little-endian unsigned 32-bit numbers."""
        return self.encode(text).astype("<u4").tobytes()


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(PIECE): each text's ids, by a byte-level tokenizer file, and `end`. Documents of more than
    `capacity` ids are cut into pieces of that many, of which the first may be shorter. ids are
    little-endian unsigned 32-bit numbers. Null text counts as empty."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = Encoder(path), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                out = []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = encode(text or "") + last
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    out += [(doc_id, k, s, e - s, ids[4 * s : 4 * e]) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(pieces, PIECE)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of the lengths needs, at least: the best of the dual feasible
    functions identity, f0 (for each threshold: items that leave less than it count as whole,
    items below it as nothing) and u(k) = floor((k + 1) x) / k (x itself where (k + 1) x is whole)."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.cumsum(count[::-1])[::-1], np.cumsum((count * size)[::-1])[::-1]  # of items >= size
    best = -(-int(total[0]) // capacity)
    for t in range(1, capacity // 2 + 1):
        whole = int(n[capacity - t + 1])
        best = max(best, whole + -(-int(total[t] - total[capacity - t + 1]) // capacity))
    for k in range(1, 20):
        up = size * (k + 1)
        value = np.where(up % capacity == 0, k * size, up // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin."""
    bins, offsets, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if some bin has room for exactly r more
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        if fits := mask >> x:
            r = x + (fits & -fits).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - x
        if r > x:
            with_room[r - x].append(b)
            mask |= 1 << (r - x)
    return bins, offsets, capacity - np.array(room, dtype=np.int64)


PLACED = "item long, length long, part long, bin long, offset long, fill long, gap long"


def _pack(capacity: int):
    """Pack a group anew; where documents were exchanged, keep what is there unless bins are saved."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        if "bin" in rows and len(fill) >= len(rows[["part", "bin"]].drop_duplicates()):
            return rows[["item", "length", "part", "bin", "offset", "fill"]].assign(gap=gap)
        return pd.DataFrame({"item": rows["item"], "length": lengths, "part": key[0], "bin": bins, "offset": offsets, "fill": fill[bins], "gap": gap})

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY, rounds: int = 4) -> DataFrame:
    """(item, sequence_id, offset) for items (item long, length long from 1 to capacity).

    Items of full length are sequences by themselves. The others are dealt to partitions by a
    hash and packed best-fit decreasing; a lower bound certifies each partition's number of bins.
    Partitions with a gap release the documents of their bins that aren't full; those of FAN or so
    partitions are pooled and packed again, for some rounds or until no gap is left. A round can
    only lower the number of bins, and only moves (item, length) of unfilled bins.
    """
    n = items.count()
    parts = -(-n // PART_ITEMS) or 1
    packed = items.where(F.col("length") < capacity).select("item", "length", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part"))
    placed = cut(packed.groupBy("part").applyInPandas(_pack(capacity), PLACED), "packed")
    base = parts
    for turn in range(rounds):
        free = F.expr(f"gap > 0 AND fill < {capacity}")
        open_parts = placed.where(free).select("part").distinct().count()
        if not open_parts:
            break
        groups = max(1, open_parts // FAN)
        again = placed.where(free).withColumn("group", F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(groups)) + base)
        again = again.groupBy("group").applyInPandas(_pack(capacity), PLACED)
        new = cut(placed.where(~free).unionByName(again), "packed")
        drop(placed)
        placed, base = new, base + groups
        if open_parts == 1:
            break
    whole = items.where(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select("item", (F.col("part") * 2**24 + F.col("bin")).alias("sequence_id"), "offset").unionByName(whole)


def pack_documents(docs: DataFrame, path: str, payload: dict[str, Column] | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, the payload (by default ids), sequence_id, offset.

    Null text is an empty document, of the end id alone; rows with null or repeated doc_id are
    packed each for itself; an empty table gives no rows; other columns are ignored.
    """
    payload = {"ids": F.col("ids")} if payload is None else payload
    pieces = tokenize(docs, path, capacity, end).select("doc_id", "piece", "start", "length", *(c.alias(k) for k, c in payload.items()))
    pieces = cut(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("item", "length"), capacity), "item").drop("item")
