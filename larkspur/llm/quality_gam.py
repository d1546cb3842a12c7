"""Quality scores by a generalised additive model with pairwise interactions.

Fifteen statistics of a whole text fall into bins at the quantiles of the training rows. Boosting goes round the
statistics: each turn fits a tree of at most LEAVES leaves on one statistic's bins to the gradients and adds a share of
it to that statistic's table. With these tables fixed, the PAIRS pairs of statistics whose grid of bins explains most of
what is left get tables of two dimensions in the same way. A score is the logistic function of the intercept and the
sum of table entries: one vectorised addition per table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, held_out, least_hashes, ship, tidy

#: Labelled rows that the model is fitted on at most: those of the least hashes of their ids.
SAMPLE = 50_000
BINS, PAIR_BINS, PAIRS, LEAVES = 32, 12, 5, 3
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.15, 2.0
CUT = 0.3

NAMES = ["words", "length", "upper", "digits", "symbols", "shouts", "stops", "pipes", "unique", "stutter", "repeated_lines", "lines", "entropy", "wide", "blank"]
_UPPER, _LOWER, _DIGIT = ([*map(ord, x)] for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
_SYMBOL, _SHOUT, _STOP, _BLANK = ([*map(ord, x)] for x in ("#*$%&<>@^_=+~\\{}[]/", "!?", ".,;:", " \t\n\r\x0b\x0c"))


def statistics(data: bytes) -> list[float]:
    """The fifteen statistics of UTF-8 text, all zero for one without a word."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    solid = size - int(of[_BLANK].sum())
    share = of[of > 0] / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, int(of[_UPPER].sum() + of[_LOWER].sum()))
    return [
        float(np.log1p(n)), solid / n, of[_UPPER].sum() / letters, of[_DIGIT].sum() / solid, of[_SYMBOL].sum() / solid, of[_SHOUT].sum() / solid, of[_STOP].sum() / solid,
        of[ord("|")] / solid, len(set(words)) / n, sum(map(eq, words, islice(words, 1, None))) / n, 1 - len(set(lines)) / len(lines), len(lines) / n, float(-(share * np.log2(share)).sum()), of[128:].sum() / size, of[_BLANK].sum() / size,
    ]


def _tree(gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Steps of a tree of LEAVES leaves over ordered bins, from sums of gradients and curvatures."""
    g, h = np.concatenate([[0.0], np.cumsum(gain)]), np.concatenate([[0.0], np.cumsum(weight)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    cuts = [0, len(gain)]
    for _ in range(LEAVES - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                won = value(a, mid) + value(mid, b) - value(a, b)
                if won.max() > best:
                    best, at = won.max(), int(mid[won.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    return np.repeat([(g[b] - g[a]) / (h[b] - h[a] + RIDGE) for a, b in zip(cuts, cuts[1:], strict=False)], np.diff(cuts))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], side="right") for pair in self.pairs for k in pair}
        for (i, j), table in self.pairs.items():
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows x and labels y in {0, 1}; without rows of either kind, the smoothed share of ones."""
    ones = float(y.sum())
    intercept = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(width)]
    coarse_edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    pairs: dict[tuple[int, int], np.ndarray] = {}
    if not 0 < ones < len(y):
        return Model(intercept, edges, tables, coarse_edges, pairs)
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse_edges)]
    total = np.full(len(y), intercept)

    def gradients():
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = gradients()
            step = RATE * np.clip(_tree(np.bincount(b, g, len(tables[k])), np.bincount(b, h, len(tables[k]))), -4, 4)
            tables[k] += step
            total += step[b]
    g, h = gradients()

    def grid(i, j, values):
        shape = len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    explained = {(i, j): float((grid(i, j, g) ** 2 / (grid(i, j, h) + RIDGE)).sum()) for i, j in combinations(range(width), 2)}
    chosen = sorted(explained, key=lambda p: (-explained[p], p))[:PAIRS]
    pairs = {p: np.zeros((len(coarse_edges[p[0]]) + 1, len(coarse_edges[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = gradients()
            a, b = grid(i, j, g), grid(i, j, h)
            ga, ha = np.cumsum(a.sum(axis=1))[:-1], np.cumsum(b.sum(axis=1))[:-1]
            if not len(ga):
                continue
            won = ga**2 / (ha + RIDGE) + (a.sum() - ga) ** 2 / (b.sum() - ha + RIDGE)
            cut = int(won.argmax()) + 1
            step = np.concatenate([np.tile(_tree(a[rows].sum(axis=0), b[rows].sum(axis=0)), (n, 1)) for rows, n in ((slice(0, cut), cut), (slice(cut, None), a.shape[0] - cut))])
            step = RATE * np.clip(step, -4, 4)
            pairs[i, j] += step
            total += step[coarse[i], coarse[j]]
    return Model(intercept, edges, tables, coarse_edges, pairs)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """One row per row of `docs`: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= cut).

    Learns from rows of `labels` (id, label; nulls left out) that are not held out, the `sample` of least hash where
    there are more. Null and empty texts have all statistics zero and get that score. Repeated ids and rows each get
    their row; if ids repeat in either table each combination counts in the fit, up to `sample`. Without usable labels each score is 0.5.
    Texts are read once, the statistics are kept in the shared folder, the fit takes at most `sample` rows of 15 numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                made = [statistics(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["id", "x"])

    rows = scratch.table(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(count), f"id {kind}, x array<double>"), "statistics")
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    some = least_hashes(usable, ["id", "y"], sample)
    found = scratch.table(rows.join(some, "id").select("x", "y"), "known")
    known = least_hashes(found, ["x", "y"], sample).toArrow()  # where labelled ids repeat there are more
    x = np.array(known["x"].combine_chunks().flatten(), np.float64).reshape(-1, len(NAMES)) if known.num_rows else np.empty((0, len(NAMES)))
    order = np.lexsort(x.T) if len(x) else np.empty(0, int)  # sums do not depend on the order of arrival
    model = fit(x[order], np.array(known["y"].to_numpy() if known.num_rows else [], np.float64)[order])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(np.array(batch.column(2).flatten(), np.float64).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= cut).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return rows.select("id", held_out(F.col("id")).alias("held_out"), "x").mapInArrow(add, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
