"""Near-duplicate documents by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, partitions, release
from .components import connected_components, hub_size, with_least
from .textbytes import U, mix, word_hashes

COORDINATES, ROWS = 32, 4  # coordinates of a signature, and min-hashes combined in each
BLOCK = 1024  # documents of a posting list that are compared with as many others at once, at most
SPREAD = 16  # blocks that smaller lists are split into, so that several tasks share their pairs

_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = _RNG.integers(0, 2**63, COORDINATES * ROWS, dtype=U) * U(2) + U(1)
_ADD = _RNG.integers(0, 2**64, COORDINATES * ROWS, dtype=U)
_FOLD = _RNG.integers(0, 2**63, ROWS, dtype=U) * U(2) + U(1)
_PLACE = _RNG.integers(0, 2**64, COORDINATES, dtype=U)
_SHINGLE = _RNG.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)


def shingles(data: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles, A-Z in lower case; with
    fewer words the whole sequence is the only shingle; without words there is none."""
    h = word_hashes(data.lower())
    n = len(h)
    if n == 0:
        return h
    with np.errstate(over="ignore"):
        if n < words:
            return mix(np.array([(h * _SHINGLE[:n]).sum(dtype=U) + U(n)], dtype=U))
        total = h[: n - words + 1] * _SHINGLE[0]
        for j in range(1, words):
            total += h[j : n - words + 1 + j] * _SHINGLE[j]
    return np.unique(mix(total))


def signature(sets: np.ndarray) -> np.ndarray:
    """COORDINATES values, each of ROWS min-hashes and salted with its place."""
    least = np.full(COORDINATES * ROWS, 2**64 - 1, dtype=U)
    with np.errstate(over="ignore"):
        for at in range(0, len(sets), 2048):
            part = np.multiply.outer(_MUL, sets[at : at + 2048])
            part += _ADD[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return mix((mix(least).reshape(COORDINATES, ROWS) * _FOLD).sum(axis=1, dtype=U) + _PLACE)


def needed_matches(percent: int, miss: float = 1e-7) -> int:
    """The most coordinates that may be asked for so that a pair of the least similarity has
    fewer in common with a probability of `miss` at most."""
    p, total = (percent / 100) ** ROWS, 0.0
    for t in range(COORDINATES):
        total += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if total > miss:
            return max(1, t)
    return COORDINATES


def _features(words: int):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, one, two, post = [], [], [], []
            for text in batch["text"]:
                s = shingles(text or b"", words)
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                n.append(len(s))
                one.append(d[0])
                two.append(d[1])
                post.append(signature(s).view(np.int64) if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": n, "d1": one, "d2": two, "post": post})

    return features


def _sets(words: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"family": batch["family"], "rep": batch["rep"], "s": [shingles(x or b"", words).tobytes() for x in batch["text"]]})

    return sets


def _blocks(n: Column) -> Column:
    """How many blocks n documents make: of BLOCK each, but up to SPREAD smaller ones first."""
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(SPREAD), F.ceil(n * SPREAD / BLOCK))).cast("int")


def _by_group(keys: list[str], of_group):
    """A function for mapInPandas over rows sorted by keys; a group that goes on in the next batch
    waits for it."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            marks = rows[keys].to_numpy()
            bounds = [0, *(np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1)) + 1).tolist()]
            out = [of_group(rows.iloc[s:e]) for s, e in zip(bounds, bounds[1:], strict=False)]
            waiting = rows.iloc[bounds[-1] :]
            if out:
                yield pd.concat(out, ignore_index=True)
        if waiting is not None and len(waiting):
            yield of_group(waiting)

    return stream


def _blocks_of(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two blocks that a group of rows compares, which may be one and the same."""
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    left = rows[rows["block"] == i]
    return left, left if i == j else rows[rows["block"] == j]


def _across(need: int):
    """For a posting list's two blocks: a pair with enough collisions for any two families."""

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = _blocks_of(rows)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x, y = np.stack(left["post"].to_numpy()), np.stack(right["post"].to_numpy())
        same = np.zeros((len(x), len(y)), dtype=np.uint8)
        for c in range(COORDINATES):
            same += x[:, c, None] == y[None, :, c]
        fa, fb = left["family"].to_numpy(), right["family"].to_numpy()
        p, q = np.nonzero((same >= need) & (fa[:, None] != fb[None, :]))
        return pd.DataFrame({"a": np.minimum(fa[p], fb[q]), "b": np.maximum(fa[p], fb[q])}).drop_duplicates()

    return across


def similar(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of x and y are similar enough, from their exact intersections: products of
    incidence matrices over the values that both sides have, some thousand values at a time."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    vx, vy = np.concatenate(x), np.concatenate(y)
    values = np.intersect1d(vx, vy)
    both = np.zeros((len(x), len(y)), dtype=np.float32)
    rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    cx, cy = np.searchsorted(values, vx), np.searchsorted(values, vy)
    for c, v in ((cx, vx), (cy, vy)):
        c[c == len(values)] = 0
        c[values[c] != v if len(values) else slice(None)] = -1
    for at in range(0, len(values), 4096):
        mx, my = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
        for m, r, c in ((mx, rx, cx), (my, ry, cy)):
            here = (c >= at) & (c < at + 4096)
            m[r[here], c[here] - at] = 1
        both += mx @ my.T
    both = both.astype(np.int64)  # exact: counts below 2**24
    return 100 * both >= percent * (nx[:, None] + ny[None, :] - both)


def _exact(percent: int):
    """For two blocks of a family: links that join the same documents as all links between them."""

    def exact(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = _blocks_of(rows)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x, y = ([np.frombuffer(s, dtype=U) for s in side["s"]] for side in (left, right))
        p, q = np.nonzero(similar(x, y, percent))
        one, two = left["rep"].to_numpy(), right["rep"].to_numpy()
        root: dict[int, int] = {}

        def find(n: int) -> int:
            while root.setdefault(n, n) != n:
                root[n] = n = root[root[n]]
            return n

        out = []
        for a, b in zip(one[p].tolist(), two[q].tolist(), strict=True):
            if (ra := find(a)) != (rb := find(b)):
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return exact


def _to_head(percent: int):
    """Whether each member is linked with its family's head, and whether it is near enough to be
    linked with one that is: Jaccard distances keep the triangle inequality."""

    def to_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked, near = [], []
            for x, y in zip(batch["s"], batch["head"], strict=True):
                x, y = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                linked.append(100 * both >= percent * union)
                near.append(100 * both >= (2 * percent - 100) * union)
            yield pd.DataFrame({"family": batch["family"], "rep": batch["rep"], "linked": linked, "near": near})

    return to_head


def confirmed(families: DataFrame, groups: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b): links confirmed on the full sets that connect the same sets as all links between
    sets of one family. families has (node, component), component the least node; groups has
    (rep, least, th), the doc_id and text hash of a document with the set of node rep.

    Each member is compared with the family's head first. Families with members that aren't
    linked with it, the rest, are then compared in blocks of BLOCK x BLOCK: the rest with itself,
    and those of the rest that are near enough with those linked with the head."""
    spark = docs.sparkSession
    member = families.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    source = member.join(groups.select("rep", F.col("least").alias("doc_id"), "th"), "rep")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")).join(source, ["doc_id", "th"])
    texts = texts.dropDuplicates(["doc_id", "th"]).select("family", "rep", "text")
    sets = cut(texts.mapInPandas(_sets(words), "family long, rep long, s binary"), "sets")
    release(spark)
    # A family that has more than a 4 * partitions-th of all members, so one of fewer than that many,
    # is dealt to several tasks, each with a copy of its head.
    share = max(BLOCK, member.count() // (4 * partitions(spark)))
    big = member.groupBy("family").agg(F.ceil(F.count("*") / share).cast("int").alias("salts")).where("salts > 1")
    salted = sets.join(F.broadcast(big), "family", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    heads = salted.where("rep = family").select("family", F.col("s").alias("head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = salted.where("rep <> family").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts").cast("int"))
    judged = cut(others.join(heads, ["family", "salt"]).mapInPandas(_to_head(percent), "family long, rep long, linked boolean, near boolean").distinct(), "judged")
    links = judged.where("linked").select(F.col("family").alias("a"), F.col("rep").alias("b"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rest, near = ~F.col("linked"), ~F.col("linked") & F.col("near")
    sizes = judged.groupBy("family").agg(count(rest).alias("n_rest"), count(near).alias("n_near"), count(F.col("linked")).alias("n_linked"))
    sizes = sizes.where("n_rest > 1 OR n_near > 0 AND n_linked > 0")
    rows = judged.join(sizes, "family").withColumn("rest_blocks", _blocks(F.col("n_rest"))).withColumn("linked_blocks", F.when(F.col("n_near") > 0, _blocks(F.col("n_linked"))).otherwise(0))
    # Blocks of the rest are numbered from 0, those of linked members from -1 down.
    block = F.when(rest, F.pmod(F.xxhash64("rep"), "rest_blocks").cast("int")).otherwise(-1 - F.pmod(F.xxhash64("rep"), F.greatest("linked_blocks", F.lit(1))).cast("int"))
    rows = rows.withColumn("block", block)
    others = F.transform(F.sequence(F.lit(1), "rest_blocks"), lambda k: k - 1)
    down = F.when(F.col("linked_blocks") > 0, F.transform(F.sequence(F.lit(1), F.greatest("linked_blocks", F.lit(1))), lambda k: -k)).otherwise(F.array().cast("array<int>"))
    with_linked = F.when(F.col("near"), down).otherwise(F.array().cast("array<int>"))
    other = F.when(rest, F.concat(others, with_linked)).when(F.col("linked_blocks") > 0, others).otherwise(F.array().cast("array<int>"))
    rows = rows.select("family", "rep", "block", F.explode(other).alias("other"))
    rows = rows.select("family", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    keys = ["family", "i", "j"]
    rows = rows.join(sets.select("rep", "s"), "rep").repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    more = rows.mapInPandas(_by_group(keys, _exact(percent)), "a long, b long")
    out = cut(links.unionByName(more), "links")
    drop(sets, judged)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept, text_hash (Spark's xxhash64 of the text).

    Documents are linked if their shingle sets have a Jaccard similarity of `percent` or more;
    component_id is the least doc_id reachable, and that document is kept.

    1. Documents of equal sets are linked and stand in the rest for one, the least doc_id. What is
       linked then are sets, which have numbers of their own, as a doc_id may have several texts.
    2. Each is posted under its (coordinate, value) pairs. Two documents with t or more equal
       coordinates out of k share one of the first k - t + 1, so only that prefix is posted; the
       others are skipped and only compared for the pairs found (t: :func:`needed_matches`).
    3. In each list every document is paired with the least one only: as many pairs as postings,
       however large the list. Pairs with t collisions make families.
    4. In lists whose documents aren't in one family by then, those outside the list's largest
       family are compared with each other and with that family, in blocks of BLOCK x BLOCK
       documents; two families with a pair of t collisions become one. So documents that could be
       linked are in one family, whatever the size of a list, and no list is expanded into pairs.
    5. Links are confirmed on full sets inside the families: see :func:`confirmed`.

    Null or empty texts and texts without words have an empty set and are linked with nothing;
    rows without doc_id are linked with nothing and kept; repeated rows are in one component (and
    all marked kept, as they have the same doc_id); of rows with one doc_id but other texts each
    has its own set's component; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    need = needed_matches(percent)
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    features = base.mapInPandas(_features(words), "doc_id string, text_hash long, n_shingles long, d1 long, d2 long, post array<long>")
    features = cut(features.withColumn("doc_id", F.col("doc_id").cast("long")), "features")
    groups = features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"))
    groups = groups.select("d1", "d2", F.col("of.doc_id").alias("least"), F.col("of.text_hash").alias("th"), F.monotonically_increasing_id().alias("rep"))
    groups = cut(groups, "groups")
    sides = ["d1", "d2", "least", "th"]
    posts = features.select("d1", "d2", F.col("doc_id").alias("least"), F.col("text_hash").alias("th"), "post").join(groups, sides).dropDuplicates(sides)
    posts = cut(posts.select("rep", "post"), "posts")

    listed = posts.select("rep", F.explode(F.slice("post", 1, COORDINATES - need + 1)).alias("key"))
    heads = listed.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    shared = cut(listed.join(heads, "key"), "postings")
    release(spark)

    stars = shared.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda c: posts.select(F.col("rep").alias(c), F.col("post").alias(f"p{c}"))
    equal = F.size(F.filter(F.zip_with("pa", "pb", lambda x, y: x == y), lambda z: z))
    stars = cut(stars.join(side("b"), "b").join(side("a"), "a").where(equal >= need).select("a", "b"), "stars")
    families = cut(connected_components(stars), "families")
    release(spark)

    listed = shared.join(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    listed = cut(listed, "listed")
    per_family = listed.groupBy("key", "family").agg(F.count("*").alias("c"))
    mixed = per_family.groupBy("key").agg(F.max(F.struct("c", "family")).alias("most"), F.sum("c").alias("n")).where("n > most.c")
    mixed = mixed.select("key", F.col("most.family").alias("main"), _blocks(F.col("most.c")).alias("main_blocks"), _blocks(F.col("n") - F.col("most.c")).alias("rest_blocks"))
    # Blocks of the rest are numbered from 0, those of the largest family from -1 down.
    rows, rest = listed.join(mixed, "key"), F.col("family") != F.col("main")
    block = F.when(rest, F.pmod(F.xxhash64("rep"), "rest_blocks")).otherwise(-1 - F.pmod(F.xxhash64("rep"), "main_blocks")).cast("int")
    with_rest = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    other = F.when(rest, F.concat(with_rest, F.sequence(F.lit(-1), -F.col("main_blocks"), F.lit(-1)))).otherwise(with_rest)
    rows = rows.select("key", "rep", "family", block.alias("block"), other.alias("others"))
    rows = rows.select("key", "rep", "family", "block", F.explode("others").alias("other"))
    rows = rows.select("key", "rep", "family", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    keys = ["key", "i", "j"]
    rows = rows.join(posts, "rep").repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    joined = cut(rows.mapInPandas(_by_group(keys, _across(need)), "a long, b long").distinct(), "joined")
    if not joined.isEmpty():
        families = cut(connected_components(families.select(F.col("node").alias("a"), F.col("component").alias("b")).union(joined)), "families")
    drop(shared, listed, posts, stars, joined)
    release(spark)

    links = confirmed(families, groups, docs, percent, words)
    member = cut(connected_components(links).withColumnRenamed("node", "rep").join(groups, "rep").select("rep", F.col("component").alias("u"), F.col("least").alias("v")), "members")
    release(spark)

    component = with_least(member, hub_size(member.count(), spark))
    sets = groups.select("d1", "d2", "least", "rep").join(component.select("rep", "m"), "rep", "left")
    sets = sets.select("d1", "d2", F.coalesce("m", "least").alias("own"))
    out = features.select("doc_id", "n_shingles", "d1", "d2", "text_hash").join(sets, ["d1", "d2"], "left")
    own = F.coalesce("own", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "text_hash")
