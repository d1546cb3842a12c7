"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features are words, and beginnings of words of 4 to 7 letters (inflected forms share them), that stand in far more of
the labelled severe texts than chance allows; a text has the logarithm of one plus the number of its words that bear
each. P(grade > k) is the logistic function of x.w - theta_k: one weight vector for all grades, thresholds in order.
The expected severity is the sum of these probabilities over k. Grades are those of the labels: labels of 0 and 1 make
one threshold, and the expected severity is then the probability of 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, held_out, least_hashes, ship, texts, tidy

#: Labelled rows that features and weights are learned from at most: those of the least hashes of their ids.
SAMPLE = 10_000
#: How many terms may pass for features by chance alone, of all that are tried; lengths of beginnings.
CHANCE, BEGINNINGS = 0.01, (4, 5, 6, 7)
STEPS, RATE, RIDGE = 1500, 0.5, 1e-4
WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """terms: word or beginning with a final * -> column; theta ascending, one fewer than there are grades."""

    terms: dict[str, int]
    weights: np.ndarray
    theta: np.ndarray

    def __post_init__(self):
        self.heads = {t.rstrip("*")[:4] for t in self.terms}

    def features(self, text: str) -> Counter:
        """Columns and how many words bear each."""
        heads, found = self.heads, Counter()
        for w in WORDS.findall(text.lower()):
            if w[:4] in heads:
                for t in (w, *(w[:n] + "*" for n in BEGINNINGS if len(w) >= n)):
                    if t in self.terms:
                        found[self.terms[t]] += 1
        return found

    def above(self, rows: list[Counter]) -> np.ndarray:
        """P(grade > k) for each row and k."""
        total = np.array([sum(self.weights[c] * np.log1p(n) for c, n in row.items()) for row in rows], np.float64)
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.theta[None, :], -40, 40)))


def fit(rows: list[Counter], grades: np.ndarray, terms: dict[str, int]) -> Model:
    """Weights and thresholds of the largest penalised likelihood, by gradient steps scaled as in Adam."""
    top = max(1, int(grades.max(initial=0)))
    share = np.array([(np.sum(grades > k) + 0.5) / (len(grades) + 1.0) for k in range(top)])
    theta = -np.log(share / (1 - share))
    model = Model(terms, np.zeros(len(terms)), theta)
    if not terms or not len(rows):
        return model
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.array([k for x in rows for k in x], np.int64)
    v = np.log1p(np.array([n for x in rows for n in x.values()], np.float64))
    gaps = np.log(np.maximum(np.diff(theta), 1e-2))
    params = np.concatenate([model.weights, theta[:1], gaps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, theta = params[: len(terms)], np.cumsum(np.concatenate([params[len(terms) : len(terms) + 1], np.exp(params[len(terms) + 1 :])]))
        z = np.bincount(r, v * w[c], len(rows))
        p = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40))), np.zeros((len(rows), 1))], axis=1)
        likely = np.maximum(p[np.arange(len(rows)), grades] - p[np.arange(len(rows)), grades + 1], 1e-12)
        slope = p * (1 - p)
        low, high = slope[np.arange(len(rows)), grades] / likely, slope[np.arange(len(rows)), grades + 1] / likely
        dz = (low - high) / len(rows)
        dtheta = np.array([-low[grades == k + 1].sum() + high[grades == k].sum() for k in range(top)]) / len(rows)
        tail = np.cumsum(dtheta[::-1])[::-1]  # a gap moves every threshold from its own on
        grad = np.concatenate([np.bincount(c, v * dz[r], len(terms)) - RIDGE * w, tail[:1], tail[1:] * np.exp(params[len(terms) + 1 :])])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params + RATE / (1 + step / 100) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    theta = np.cumsum(np.concatenate([params[len(terms) : len(terms) + 1], np.exp(params[len(terms) + 1 :])]))
    return Model(terms, params[: len(terms)], theta)


def learn_terms(known: DataFrame, scratch: Scratch) -> dict[str, int]:
    """Terms of rows (text, y: severe or not) by the excess of severe texts among those that have them.

    Of n texts with a term k are severe; the chance of so many or more, by Chernoff's bound, must be so small that CHANCE
    of all terms would pass. A term that begins with a chosen beginning says nothing new and is left out.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    bare = known.select("y", words.alias("words"))
    stems = F.array_distinct(F.flatten(F.transform("words", lambda w: F.filter(F.array(*(F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in BEGINNINGS)), lambda t: t.isNotNull()))))
    counts = scratch.table(bare.select("y", F.explode(F.concat("words", stems)).alias("term")).groupBy("term").agg(F.sum("y").alias("k"), F.count("*").alias("n")), "terms")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")).first()
    if not 0 < size["k"] < size["n"]:
        return {}
    p, share = size["k"] / size["n"], F.col("k") / F.col("n")
    apart = share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    bar = math.log(max(1, counts.count()) / CHANCE)
    # a term that passes stands in several labelled texts, of which there are `sample`
    best = counts.where("k > 0").withColumn("share", share).withColumn("score", F.col("n") * apart).where((F.col("share") > p) & (F.col("score") >= bar)).orderBy(F.desc("score"), F.desc(F.length("term")), "term").select("term").collect()
    chosen: dict[str, int] = {}
    for (term,) in best:
        word = term.rstrip("*")
        if not any(word[:n] + "*" in chosen for n in BEGINNINGS if n <= len(word)):
            chosen[term] = len(chosen)
    return chosen


def score_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: id, held_out, severity (expected grade), p_toxic (that the grade is not 0), toxic (1 if that is 0.5 or more).

    Learns from rows of `labels` (id, label; nulls left out) that are not held out, the `sample` of least hash where
    there are more; labels are grades from 0. A null or empty text has no features. Repeated ids and rows each get their
    row, and where labelled ids repeat, `sample` of their rows are learned from; without usable labels every severity is
    the same. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("grade")).where(F.col("id").isNotNull() & (F.col("grade") >= 0) & ~held_out(F.col("id")))
    some = least_hashes(usable, ["id", "grade"], sample)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # at most `sample` rows of two numbers: under 300 KB
    known = source.join(F.broadcast(some), "id").withColumn("y", (F.col("grade") > 0).cast("int"))
    scratch = Scratch(spark)
    terms = learn_terms(known, scratch)
    blank = Model(terms, np.zeros(len(terms)), np.zeros(1))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                found = [blank.features(x) for x in texts(batch, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], names=["grade", "columns", "counts"])

    features = scratch.table(known.select("grade", "text").mapInArrow(tidy(reduce), "grade int, columns array<int>, counts array<int>"), "features")
    got = least_hashes(features, ["grade", "columns", "counts"], sample).toArrow().to_pylist() if terms else []
    got.sort(key=lambda r: (r["grade"], r["columns"], r["counts"]))
    rows = [Counter(dict(zip(r["columns"], r["counts"], strict=True))) for r in got]
    grades = np.array([r["grade"] for r in got], np.int64)
    model = fit(rows, grades, terms)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 2):
                above = model.above([model.features(x) for x in texts(batch, 2)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((above[:, 0] >= 0.5).astype(np.int32))], names=[id_col, "held_out", "severity", "p_toxic", "toxic"])

    return source.select("id", held_out(F.col("id")), "text").mapInArrow(tidy(score), f"`{id_col}` {kind}, held_out boolean, severity double, p_toxic double, toxic int")
