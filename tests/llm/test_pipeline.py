"""The pipeline and its stages against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import brute_word_runs, shingle_set

import corpus_pipeline
from bitlattice.llm import packing
from bitlattice.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{k}" for k in range(3000)]
PASSAGE = " ".join(f"p{k}" for k in range(120))
BAD = ("vile", "foul", "nasty")


def corpus():
    """Rows of DOCS, of three sources and none, with toxic texts, copies, near copies and repeats."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(10, 60))) for _ in range(150)]
    for k in range(0, 150, 10):
        texts[k] += " " + " ".join(BAD)
    for k in range(1, 150, 15):
        texts[k] = f"{texts[k]} {PASSAGE} {texts[k][::-1]}"
    texts += [texts[3], texts[4] + " more", texts[5] + " # $ %", "", None]
    rows = [(k, t, "en", (*"abc", None)[k % 4]) for k, t in enumerate(texts)]
    # Ids that are null or repeated, of texts that differ; equal rows are taken once.
    rows += [(None, " ".join(rng.choice(VOCABULARY) for _ in range(20)), "en", "c") for _ in range(25)]
    rows += [(1000, " ".join(rng.choice(VOCABULARY) for _ in range(3)), "en", "b") for _ in range(2)]
    return [(*r, len(r[1] or "")) for r in rows]


def brute_mix(rows):
    """The copies of each of rows, in order; weights 5, 2, 1, 1.5 times all words, twice a source at most."""
    n_words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    size = Counter()
    for r, n in zip(rows, n_words, strict=True):
        size[r[3]] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= weight[s] * level}
        target |= {s: 2 * size[s] if full else weight[s] * level for s in full or open_}
        open_ -= full or open_
    copies, upto = [0] * len(rows), Counter()

    def key(k):
        text = rows[k][1] or ""
        u = hashlib.md5(f"17:{'' if rows[k][0] is None else rows[k][0]}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:13]
        quality = max(0.05, 1 - 4 * sum(map(text.count, "#*$%&|<>")) / len(text)) if text else 1.0
        return -math.log((int(u, 16) + 0.5) / 2**52) / quality

    for k in sorted(range(len(rows)), key=key):
        s = rows[k][3]
        epochs = target[s] // size[s] if size[s] else 0
        copies[k] = int(epochs) + (upto[s] + n_words[k] / 2 < target[s] - epochs * size[s])
        upto[s] += n_words[k]
    return copies, {s: target[s] / size[s] for s in order if size[s]}


def brute_near(rows):
    """Rows with a doc_id that are the least of their group of near duplicates, and those without."""
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [r for k, r in enumerate(rows) if root[k] == k]


def brute_cut(rows):
    cuts = brute_word_runs([(r[1] or "").encode() for r in rows], 50)
    texts = [r[1] if r[1] is None else t.decode() for r, (t, _) in zip(rows, cuts, strict=True)]
    return [(r[0], t, r[2], r[3], None if t is None else len(t)) for r, t in zip(rows, texts, strict=True)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{to}/documents.parquet")
    marks = [(r[0], 1, int("vile" in (r[1] or ""))) for r in rows if r[0] is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def bag(rows):
    return Counter(map(tuple, rows))


def clean(rows):
    return [r for r in rows if "vile" not in (r[1] or "")]


def test_drop_toxic(spark, folder):
    rows = corpus()
    assert bag(corpus_pipeline.drop_toxic(spark, frame(spark, rows), folder).collect()) == bag(clean(rows))


def test_drop_near_duplicates(spark, folder):
    rows = corpus()
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), folder).collect()
    assert bag(got) == bag(brute_near(rows)) and len(got) < len(rows)


def test_near_duplicates_of_one_id(spark, folder):
    """A text of its own stays, though another row of its doc_id is a copy."""
    say = lambda seed: " ".join(random.Random(seed).choices(VOCABULARY, k=60))
    rows = [(3, say(1)), (9, say(1) + " more"), (9, say(2)), (12, say(2) + " more"), (5, say(3)), (5, say(4))]
    rows = [(k, t, "en", "a", len(t)) for k, t in rows]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), folder).collect()
    assert bag(got) == bag([rows[0], rows[2], rows[4], rows[5]])


def test_drop_repeated_passages(spark, folder):
    rows = corpus()
    got = corpus_pipeline.drop_repeated_passages(spark, frame(spark, rows), folder).collect()
    assert bag(got) == bag(brute_cut(rows)) != bag(rows)


def test_passages_of_short_words_go(spark, folder):
    """51 to 80 words of one or two letters, far below 400 bytes, each in three documents."""
    rng = random.Random(3)
    own = lambda: " ".join(rng.choice(VOCABULARY) for _ in range(90))
    rows, passages = [], []
    for n in (51, 60, 80):
        passages.append([rng.choice("abcdefghijklmnop") + rng.choice("xyz") * rng.randint(0, 1) for _ in range(n)])
        rows += [(len(rows) + k, f"{own()}{sep}{sep.join(passages[-1])}\n{own()}", "en", "a", 0) for k, sep in enumerate((" ", "\n", "  "))]
    rows += [(100 + k, own(), "en", "a", 0) for k in range(20)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, frame(spark, rows), folder).collect()}
    for k, (_, text, *_) in enumerate(rows):
        if k < 9:
            assert " ".join(passages[k // 3]) not in " ".join(got[k].split()) and len(got[k].split()) == 180
        else:
            assert got[rows[k][0]] == text


def with_copies(rows, copies):
    return Counter({r: n for r, n in zip(rows, copies, strict=True) if n})


def test_mix_sources(spark, folder):
    rows = [(k, r[1], *r[2:]) if r[0] is not None else r for k, r in enumerate(corpus())]
    # Which of the rows with equal keys are taken is left open, so here ids are single.
    rows = [(5000 + k, *r[1:]) if r[0] is None else r for k, r in enumerate(rows)]
    copies, ratio = brute_mix(rows)
    assert min(ratio.values()) < 0.9 and 0 in copies and 2 in copies
    assert bag(corpus_pipeline.mix_sources(spark, frame(spark, rows), folder).collect()) == with_copies(rows, copies)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_sources_counts_rows_of_one_id(spark, folder, doc_id):
    """Each row has copies of its own, so the source below its size stays near its target."""
    rows = [(doc_id, f"{s}{k} word word word", "en", s, 15) for s in "abc" for k in range(40)]
    _, ratio = brute_mix(rows)
    taken = Counter(r["source"] for r in corpus_pipeline.mix_sources(spark, frame(spark, rows), folder).collect())
    assert ratio["c"] < 1 and all(abs(taken[s] - 40 * ratio[s]) <= 1 for s in "abc")


def test_run(spark, folder):
    rows = brute_cut(brute_near(clean(corpus())))
    copies, ratio = brute_mix(rows)
    assert min(ratio.values()) < 1
    encode, want, got = packing.Encoder(tokenizer_path()), Counter(), Counter()
    open_ids = {None, 1000}  # of rows with equal keys, any may be taken
    for r, n in zip(rows, copies, strict=True):
        want[r[0] if r[0] in open_ids else (r[0], len(encode(r[1] or "")) // 4 + 1)] += n
    bins = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        assert r["piece"] == 0
        got[r["doc_id"] if r["doc_id"] in open_ids else (r["doc_id"], r["length"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k in open_ids:
        assert abs(got.pop(k, 0) - want.pop(k, 0)) <= 1
    assert got == +want
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [at for at, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 1024
