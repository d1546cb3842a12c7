"""URL rules, and gradient-boosted trees on lexical features for URLs that no rule fits.

Rules name a host (with its subdomains) and the beginning of a path; the longest that fits decides. Trees judge the
others by lengths, depth, shares of digits and other signs, entropy, parameters, and for the last and last two labels
of the host how often they were seen and blocked, counted on all labelled URLs, also where the trees are fitted on a
sample. A URL that the trees are fitted on has these counts without those of its own part of the hosts (one of FOLDS),
so that no label is among its own features.

Labels come with a table of labelled URLs. Where there is none, a URL is labelled by its host's words: one of SEEDS, the
trades that public block lists are sorted by, makes it one to block. The words themselves are no features: what the
trees learn is how such URLs are built, and so they judge hosts that name no trade.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_hashes, ship

#: Labelled URLs that trees are fitted on at most: those of the least hashes.
SAMPLE = 20_000
#: Counts of so many suffixes are broadcast; more are joined by exchange.
BROADCAST_SUFFIXES = 100_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 3, 32, 0.2, 1.0
#: Parts of the hosts, by hash, for counts that leave a URL's own part out.
FOLDS = 5
#: Words of host names that categories of public block lists go by.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "dating", "gambling", "malware", "phishing", "pills", "poker", "porn", "scam", "sex", "spam", "tracker", "warez", "xxx")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (host and path, as in example.org/en/) that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        of, slash, rest = rule.partition("/")
        found = F.when(((host == of) | host.endswith("." + of)) & path.startswith(slash + rest), F.lit(rule)).otherwise(found)
    return found


def names_a_seed(host: Column) -> Column:
    """Whether a word of the host (between dots, hyphens and digits) is one of SEEDS."""
    return host.rlike(rf"(^|[.\-0-9])({'|'.join(SEEDS)})($|[.\-0-9])")


def _entropy(text: str) -> float:
    share = np.array([*Counter(text).values()], np.float64) / max(1, len(text))
    return float(-(share * np.log2(share)).sum())


def lexical(url: str, host: str, path: str) -> list[float]:
    """What of a URL does not depend on other URLs."""
    query = url.partition("?")[2].partition("#")[0]
    n = max(1, len(url))
    labels = host.split(".")
    return [
        len(url), len(host), len(path), sum(bool(x) for x in path.split("/")), sum(c.isdigit() for c in url) / n, sum(not c.isalnum() for c in url) / n, _entropy(url), _entropy(host),
        len([x for x in query.split("&") if x]), len(labels), max(map(len, labels)), host.count("-"), sum(c.isdigit() for c in host), float(url.startswith("https")), float("." in path.rpartition("/")[2]), float(path.endswith("/")),
    ]


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-1:]), ".".join(labels[-2:])]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    #: For each tree and inner node: the feature and the last bin that goes left; then the leaves.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    seen: dict[str, tuple[float, float]]
    rate: float

    def with_seen(self, seen: dict[str, tuple[float, float]]) -> Model:
        """The model with these counts of suffixes and how many of each were blocked."""
        return replace(self, seen={s: (float(np.log1p(k)), (b + 10 * self.rate) / (k + 10)) for s, (k, b) in seen.items()})

    def rows(self, urls: list[tuple[str, str, str]]) -> np.ndarray:
        none = (0.0, self.rate)
        return np.array([lexical(*u) + [x for s in suffixes(u[1]) for x in self.seen.get(s, none)] for u in urls], np.float64).reshape(len(urls), -1)

    def blocks(self, urls: list[tuple[str, str, str]]) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        total = np.full(len(urls), self.base)
        if self.trees and urls:
            x = self.rows(urls)
            total += _walk(np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], axis=1), self.trees)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fold_of(host: Column) -> Column:
    return F.crc32(F.encode(host, "UTF-8")) % FOLDS


def _walk(bins: np.ndarray, trees: list) -> np.ndarray:
    total, row = np.zeros(len(bins)), np.arange(len(bins))
    for feature, cut, leaf in trees:
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[row, feature[node]] > cut[node])
        total += leaf[node - (2**DEPTH - 1)]
    return total


def fit(urls: list[tuple[str, str, str]], blocked: np.ndarray, seen: list[dict[str, tuple[float, float]]]) -> Model:
    """Trees on labelled URLs (url, host, path); with labels of one kind only, their smoothed share.

    seen: for each URL, how often each of its suffixes occurs and is blocked among the labelled URLs of other folds.
    """
    n, ones = len(urls), float(blocked.sum())
    rate = (ones + 0.5) / (n + 1.0)
    model = Model(float(np.log(rate / (1 - rate))), [], [], {}, rate)
    if not 0 < ones < n:
        return model
    x = np.vstack([model.with_seen(own).rows([u]) for u, own in zip(urls, seen, strict=True)])
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(model.edges)], axis=1)
    total = np.full(n, model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        g, h = blocked - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == at)
                best = 1e-9
                for k in range(bins.shape[1]):
                    a, b = np.bincount(bins[mine, k], g[mine], BINS), np.bincount(bins[mine, k], h[mine], BINS)
                    ga, ha = np.cumsum(a)[:-1], np.cumsum(b)[:-1]
                    won = ga**2 / (ha + RIDGE) + (a.sum() - ga) ** 2 / (b.sum() - ha + RIDGE) - a.sum() ** 2 / (b.sum() + RIDGE)
                    if won.max() > best:
                        best, feature[at], cut[at] = won.max(), k, int(won.argmax())
            node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[node])
        place = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(place, g, 2**DEPTH) / (np.bincount(place, h, 2**DEPTH) + RIDGE)
        model.trees.append((feature, cut, leaf))
        total += leaf[place]
    return model


def _labelled(parted: DataFrame, labelled: DataFrame | None) -> DataFrame:
    """Different labelled URLs: url, host, path, y."""
    if labelled is None:
        known = parted.where("host <> ''").select("url", "host", "path", names_a_seed(F.col("host")).cast("int").alias("y"))
    else:
        known = labelled.where(F.col("blocked").isNotNull()).select(F.coalesce("url", F.lit("")).alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("int").alias("y"))
    return known.distinct()


def learn(known: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """Trees fitted on labelled URLs, the `sample` of least hash where there are more, and the counts by suffix and fold of all
    of them: suffix, folds (map of fold to the struct k, b), k (seen), b (blocked)."""
    suffix = [F.substring_index("host", ".", -n) for n in (1, 2)]
    by_fold = known.select(F.explode(F.array_distinct(F.array(*suffix))).alias("suffix"), fold_of(F.col("host")).alias("fold"), "y").groupBy("suffix", "fold").agg(F.count("*").cast("double").alias("k"), F.sum("y").cast("double").alias("b"))
    counts = by_fold.groupBy("suffix").agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct("k", "b")))).alias("folds"), F.sum("k").alias("k"), F.sum("b").alias("b"))
    counts = scratch.table(counts, "suffixes")
    some = least_hashes(known, ["url", "y"], sample).withColumn("fold", fold_of(F.col("host")))
    order = F.shiftrightunsigned(F.xxhash64("url", "y"), 1)
    got = counted(some, counts).orderBy(order, "url", "y").collect()
    seen = []
    for r in got:
        own = {}
        for s, x in zip(suffixes(r.host), (r["__lk_1"], r["__lk_2"]), strict=True):
            mine = x["folds"].get(r.fold)
            own[s] = (x["k"] - (mine["k"] if mine else 0.0), x["b"] - (mine["b"] if mine else 0.0))
        seen.append(own)
    return fit([(r.url, r.host, r.path) for r in got], np.array([r.y for r in got], np.float64), seen), counts


def counted(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with the counts of the last one and two labels of their hosts among all labelled URLs; null if never seen."""
    small = F.broadcast(counts) if counts.count() <= BROADCAST_SUFFIXES else counts
    for n in (1, 2):
        of = small.select(F.col("suffix").alias("__lk_s"), F.struct("k", "b", "folds").alias(f"__lk_{n}"))
        rows = rows.join(of, F.substring_index("host", ".", -n) == F.col("__lk_s"), "left").drop("__lk_s")
    return rows


def judge(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule (that decided, or null), verdict (allow or block), p_block (of the trees).

    rules: rule -> allow or block. `labelled` (url, blocked 0/1) trains the trees; if not given, the URLs of `pages`, by
    `names_a_seed`. A null URL, or one without ://, has an empty host and path, no rule, and the trees' verdict.
    Repeated ids and rows each get their row; of repeated URLs one is learned from. Without labelled URLs of both kinds the
    verdict is that of most labels, or block at a tie. Other columns are not read.
    """
    ship(pages.sparkSession)
    url = F.col(url_col)
    parted = pages.select(F.col(id_col), F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    parted = parted.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    parted = parted.withColumn("verdict", verdict)
    model, counts = learn(_labelled(parted, labelled), Scratch(pages.sparkSession), sample)
    kind = pages.schema[id_col].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.to_pydict()
            seen = {s: (x["k"], x["b"]) for h, *own in zip(of["host"], of["__lk_1"], of["__lk_2"], strict=True) for s, x in zip(suffixes(h), own, strict=True) if x is not None}
            p = model.with_seen(seen).blocks(list(zip(of["url"], of["host"], of["path"], strict=True)))
            said = [v or ("block" if x >= 0.5 else "allow") for v, x in zip(of["verdict"], p, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3, 4)), pa.array(said, pa.string()), pa.array(p)], names=[id_col, "host", "path", "rule", "verdict", "p_block"])

    rows = counted(parted, counts).withColumns({f"__lk_{n}": F.col(f"__lk_{n}").dropFields("folds") for n in (1, 2)})
    return rows.mapInArrow(decide, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, p_block double")
