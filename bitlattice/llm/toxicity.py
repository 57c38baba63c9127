"""Toxicity severity by cumulative-link (proportional-odds) regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, partitions

SAMPLE = 20_000  # labelled rows that a model is fitted on at most
TERMS = 2_000  # features of a model at most
MIN_DOCS, MIN_G2 = 2, 6.0  # documents that hold a feature, and its log-likelihood ratio, at least
PRIOR = 1.0  # precision of the normal prior of a weight, which shrinks those of rare words most
REJECT = 0.2  # expected severity from which on a document is rejected, chosen on sf0.01: the largest of a clean text held out there is 0.184
EVIDENCE = 3.0  # times that a text's words raise the odds of a grade, at least, for it to be rejected

_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """The distinct runs of letters, in lower case."""
    return set(text.lower().encode().translate(_SPACES).split()) if text else set()


@dataclass(frozen=True)
class CumulativeLink:
    """P(grade <= k) = sigmoid(cuts[k] - sum of the weights of the words in a text): one weight
    a word for all thresholds, one ascending cut a threshold."""

    weights: dict[bytes, float]
    cuts: tuple[float, ...]

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return self.above_at(sum(map(self.weights.__getitem__, words(text) & self.weights.keys())))

    def above_at(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold k of a text whose words have weights of that sum."""
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts) - score, -50, 50)))


def fit_cumulative_link(rows: list[list[int]], grades: np.ndarray, n_terms: int, n_grades: int, steps: int = 400, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by Adam on the penalised log-likelihood; rows hold feature numbers and may be
    empty. Without rows weights are zero and the cuts those of equal shares."""
    grades = np.asarray(grades, dtype=np.int64)
    col = np.fromiter((c for r in rows for c in r), dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.array([(np.sum(grades <= k) + 1) / (len(grades) + 2) for k in range(n_grades - 1)])
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    x = np.concatenate([np.zeros(n_terms), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])  # cuts as a first one and log steps
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        first, gaps = x[n_terms], np.exp(x[n_terms + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, weights=x[:n_terms][col], minlength=len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = (1 / (1 + np.exp(-np.clip(edges[grades + d] - score, -50, 50))) for d in (1, 0))
        p, dhi, dlo = np.maximum(hi - lo, 1e-12), hi * (1 - hi), lo * (1 - lo)
        d_score = (dhi - dlo) / p  # of the negative log-likelihood
        d_cut = np.zeros(n_grades - 1)
        np.add.at(d_cut, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -dhi / p, 0))
        np.add.at(d_cut, np.maximum(grades - 1, 0), np.where(grades > 0, dlo / p, 0))
        g = np.concatenate([np.bincount(col, weights=d_score[row], minlength=n_terms) + l2 * len(rows) / 100 * x[:n_terms], [d_cut.sum()], [d_cut[k + 1 :].sum() * gaps[k] for k in range(n_grades - 2)]]) / max(1, len(rows))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x[:n_terms], x[n_terms] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_terms + 1 :]))])


def grades_of(marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0 for unmarked texts; of the marked ones 2 from the count on that splits them most evenly,
    which is two or more, and 1 below it."""
    of_marked = counts[marks > 0]
    limits = np.arange(2, max(2, of_marked.max(initial=0)) + 1)
    shares = (of_marked[None, :] >= limits[:, None]).mean(axis=1) if len(of_marked) else np.zeros(len(limits))
    return np.where(marks > 0, 1 + (counts >= limits[np.argmin(abs(shares - 0.5))]), 0)


def fit(docs: DataFrame, labels: DataFrame, mark: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> CumulativeLink:
    """Fit on `sample` labelled documents at most, those whose ids hash least.

    labels (doc_id, mark) only mark documents, so the grades are derived: 0 unmarked; of marked
    ones 2 (severe) if they hold so many of the over-represented terms, two at least, as about half
    of the marked ones do (:func:`grades_of`), else 1. Terms are
    the `terms` words with the largest log-likelihood ratio between marked and unmarked texts,
    counted once for texts that are equal; two texts are enough for a word, if that ratio is MIN_G2
    or more. Null ids, marks and texts are passed over. Without
    marked documents every grade is 0 and so is every expected severity.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull()).select("doc_id", F.col(mark).cast("int").alias("mark"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(sample)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("id")).agg(F.max("mark").alias("mark"), F.min("text").alias("text"))

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"mark": batch["mark"], "terms": [[w.decode() for w in sorted(words(t))] for t in batch["text"]]})

    held = cut(rows.repartition(partitions(docs.sparkSession), "id").select("mark", "text").mapInPandas(terms_of, "mark int, terms array<string>"), "toxic-sample")
    n, marked = held.agg(F.count("*"), F.coalesce(F.sum("mark"), F.lit(0))).first()
    if not marked or marked == n:
        drop(held)
        return CumulativeLink({}, (50.0, 50.0))
    # Log-likelihood ratio of the two-by-two table (marked or not, word in text or not).
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    both, inside, outside = F.col("n").cast("double"), F.lit(marked / n), F.lit(1 - marked / n)
    g2 = 2 * (part(a, both * inside) + part(b, both * outside) + part(marked - a, (n - both) * inside) + part(n - marked - b, (n - both) * outside))
    counts = held.select("mark", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("mark").alias("a"), F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    best = counts.where(F.col("n") < n).withColumn("g2", g2).where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "term").limit(terms)
    best = [(r["term"], r["a"] / r["n"] > marked / n) for r in best.collect()]
    names = F.array(*(F.lit(t) for t, _ in best)) if best else F.array().cast("array<string>")
    rows = held.select("mark", F.array_intersect("terms", names).alias("terms")).collect()
    drop(held)
    number, over = {t: k for k, (t, _) in enumerate(best)}, {t for t, more in best if more}
    grades = grades_of(np.array([r["mark"] for r in rows]), np.array([len(over.intersection(r["terms"])) for r in rows]))
    weights, cuts = fit_cumulative_link([[number[t] for t in r["terms"]] for r in rows], grades, len(best), 3, l2=100 * PRIOR / len(rows))
    return CumulativeLink({t.encode(): float(w) for (t, _), w in zip(best, weights, strict=True)}, tuple(map(float, cuts)))


def score(docs: DataFrame, model: CumulativeLink, reject: float = REJECT) -> DataFrame:
    """docs with expected_severity (the sum of P(grade > k)), grade (its rounding) and toxic
    (expected_severity >= reject, and the text's words raise the odds EVIDENCE times or more, so that
    none is rejected for the share of marked labels alone). Null and empty texts have severity 0 and are never toxic. All
    columns are returned, older ones of these three names replaced; only texts go to Python, and
    the model is of bounded size."""

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([float(model.above(t).sum()) if t else 0.0 for t in texts], dtype=float)

    least = max(reject, float(model.above_at(float(np.log(EVIDENCE))).sum()))
    out = docs.drop("expected_severity", "grade", "toxic").withColumn("expected_severity", rate("text"))
    return out.withColumn("grade", F.round("expected_severity").cast("int")).withColumn("toxic", F.col("expected_severity") >= least)
