"""Operator 3 against a plain version of its rules and estimates."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality_rules as q
from larkspur.llm.common import Scratch

SCHEMA = "kept string, doc_id long, text string, lang string, source string, w string"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def vector(text):
    n, chars, symbols, dup, rep = base(text)
    caps = len(re.findall("[A-Z]", text or ""))
    n, chars = max(n, 1), max(chars, 1)
    raw = [math.log1p(100 * symbols / n), math.log(chars / n), math.log1p(20 * rep / n), math.log1p(dup), math.log1p(20 * caps / chars)]
    return np.array([x / s for x, s in zip(raw, q.SPREAD, strict=True)])


def at_share(values, share):
    values = np.sort(values)
    return values[math.ceil(share * len(values)) - 1]


def half_up(x):
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def scatter(u, factor):
    m = u.mean(axis=0)
    return m, factor * (u.T @ u / len(u) - np.outer(m, m))


def starts(u):
    grid = half_up(u * q.GRID)
    v = np.array([at_share(grid[:, k], 0.5) for k in range(q.P)])
    d = np.sqrt(1 + (1.4826 * np.array([at_share(np.abs(grid[:, k] - v[k]), 0.5) for k in range(q.P)]) / q.GRID) ** 2)
    z = (u - v / q.GRID) / d
    for f in (z.clip(-2, 2), z * q.P**0.5 / np.sqrt((z**2).sum(axis=1, keepdims=True) + 1e-9), np.tanh(z)):
        yield v / q.GRID, scatter(f, 1.0)[1] * np.outer(d, d)


def least(u):
    """Centre and scatter of the least determinant, by steps until it settles."""
    ends = []
    for m, s in starts(u):
        was, now = np.inf, None
        while now is None or was - now >= q.SETTLED:
            was = np.inf if now is None else now
            far = np.floor(q.DISTANCE_GRID * np.log1p(distance(u, m, s + np.eye(q.P)))).clip(max=q.DISTANCE_TOP)
            m, s = scatter(u[far <= at_share(far, q.COVERAGE)], q.CONSISTENT)
            now = np.linalg.slogdet(s + np.eye(q.P))[1]
        ends.append((np.linalg.slogdet(s + np.eye(q.P))[1], m, s))
    return min(ends, key=lambda e: e[0])


def estimate(u):
    _, m, s = least(u)
    inner = u[distance(u, m, s + np.eye(q.P)) <= q.INNER]
    return len(inner), *scatter(inner, q.INNER_CONSISTENT)


def mixed(one, other):
    n, m, s = one
    share = n / (n + q.SHRINK)
    return n, share * m + (1 - share) * other[1], share * s + (1 - share) * other[2]


def distance(u, m, s):
    return np.einsum("ij,jk,ik->i", u - m, np.linalg.inv(s), u - m)


def test_least_determinant_of_all_subsets(spark):
    """Small groups, two of whose ten vectors lie apart: the ends against every subset of eight."""
    rng = np.random.default_rng(5)
    groups = {g: np.vstack([rng.normal(0, 1.5, (8, q.P)), rng.normal(rng.choice([-9, 9], q.P), 1, (2, q.P))]) for g in range(25)}
    rows = spark.createDataFrame([(g, u.tolist()) for g, us in groups.items() for u in us], "g long, u array<double>")
    got = {r.g: r.det for r in q.least_determinant(rows, Scratch(spark), lambda f: f).collect()}
    for g, u in groups.items():
        every = min(np.linalg.slogdet(scatter(u[list(k)], q.CONSISTENT)[1] + np.eye(q.P))[1] for k in combinations(range(10), 8))
        assert got[g] == pytest.approx(every, abs=1e-6)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda *w: F.xxhash64(*w).bitwiseAND(F.lit(1))], ids=["xxhash64", "of one bit"])
def test_repeated_words_by_hashes_that_meet(spark, hashed):
    """Different windows of one hash, standing between equal ones, hide no repeat."""
    random.seed(8)
    texts = [" ".join(random.choice("abcd") for _ in range(n)) for n in (3, 4, 5, 9, 20, 70, 200)] + ["a b c x y z a b c", "p q r s t u", "a a a a", "a b c d " * 2000]
    frame = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "i int, words array<string>")
    got = {r.i: r.n for r in frame.select("i", q.repeat_words(F.col("words"), hashed).alias("n")).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def test_against_plain_version(spark):
    random.seed(6)
    words = ["the", "ring", "of", "Éa", "tion", "shx", "and", "er.", "wh", "ouable", "x|y", "#"]
    rows = []
    for i in range(260):
        chosen = random.sample(words, 8) if i % 9 else ["A|", "B*", "same"]
        text = "".join(random.choice(chosen) + random.choice([" ", " ", "\n", "\t "]) for _ in range(random.choice([3, 60, 90, 300])))
        rows.append(("k", i, text, random.choice(["en", "en", "de"]), random.choice(["a", "a", "a", "b", None]), "w"))
    rows += [("k", None, "w " * 70, None, None, "w"), ("k", 1003, None, "en", "a", "w"), ("k", 1005, "", "xx", "b", "w"), ("k", 1005, "", "xx", "b", "w"), ("k", 900, "a b c " * 20000, "en", "a", "w")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(q.quality_rules(docs).collect(), key=lambda r: (str(r.doc_id), r.t))
    assert len(got) == len(rows)
    want = {(r[1], (r[2] or "")): base(r[2]) for r in rows}
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(r[1]), *want[r[1], r[2] or ""]) for r in rows)
    passed = [r for r in rows if base(r[2])[0] >= 50 and 100 * base(r[2])[4] <= 50 * base(r[2])[0]]
    members = defaultdict(list)
    for r in passed:
        for g in ((r[3], r[4]), (r[3],), ()):
            members[g].append(vector(r[2]))
    found = {g: estimate(np.array(u)) for g, u in members.items()}
    assert len(found) > 6
    by_id = {r.doc_id: r for r in got}
    for r in passed:
        _, m, s = mixed(found[r[3], r[4]], mixed(found[r[3],], found[()]))
        d = distance(vector(r[2])[None], m, s + np.eye(q.P))[0]
        assert by_id[r[1]].distance == pytest.approx(d, rel=1e-6)
        assert by_id[r[1]].kept == (d <= q.CUTOFF)
    assert not any(r.kept for r in got if r.base_failed)
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if r.kept)


def test_no_rows(spark):
    assert q.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_short_texts(spark):
    got = q.quality_rules(spark.createDataFrame([("k", 1, "a b", "en", "s", "w")], SCHEMA)).collect()
    assert [(r.kept, r.base_failed, r.distance) for r in got] == [(False, True, None)]
