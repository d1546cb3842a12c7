"""Operators 1 and 5 against brute force."""

import random
from collections import defaultdict

import pytest
import xxhash

from larkspur.llm import line_dedup, simhash
from larkspur.llm.components import components
from larkspur.llm.common import Scratch

SCHEMA = "t string, doc_id long, text string, n_lines int, fp string"


def rows(spark, texts):
    return spark.createDataFrame([("x", i, t, 0, "y") for i, t in texts], SCHEMA).repartition(3)


def brute_lines(texts, least):
    """Every run of every length against every earlier place."""
    seq = []
    order = sorted(set(texts), key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest(r[1].encode(), 42) ^ 1 << 63) if r[1] else 0))
    for doc in order:
        if doc[1]:
            for at, line in enumerate(doc[1].split("\n")):
                if line.encode().split():
                    seq.append((doc, at, line, len(line.encode().split())))
    cut = defaultdict(set)
    for p in range(len(seq)):
        for q in range(p):
            n = words = 0
            while p + n < len(seq) and seq[p + n][0] == seq[p][0] and seq[q + n][0] == seq[q][0] and seq[p + n][2] == seq[q + n][2]:
                words += seq[p + n][3]
                n += 1
            if words >= least:
                cut[seq[p][0]] |= {seq[k][1] for k in range(p, p + n)}
    for one, two in zip(seq, seq[1:], strict=False):
        if one[0] == two[0] and {one[1], two[1]} <= cut[one[0]]:
            cut[one[0]] |= set(range(one[1], two[1]))  # lines without words between them
    return {doc: "\n".join(x for i, x in enumerate(doc[1].split("\n")) if i not in cut[doc]) if doc[1] else doc[1] for doc in order}


def test_runs_against_every_run(spark):
    random.seed(7)
    lines = ["a b c", "d e", "f g h i j k l", "m", "", "  ", "n o p q r s t u v w", "é ñ", "x" * 300]
    passages = ["\n".join(random.choices(lines, k=random.randint(1, 6))) for _ in range(6)]
    texts = [(i, "\n".join(random.choice([random.choice(passages), random.choice(lines), f"only {i} {k}"]) for k in range(random.randint(0, 9)))) for i in range(40)]
    texts += [(None, None), (None, texts[3][1]), (50, ""), (51, None), (52, "\n\n"), (3, texts[3][1]), (3, texts[4][1]), (60, "q r s\n" * 30), (61, "f g h i j k l\n" * 3)]
    for least in (1, 6, 12):
        want = brute_lines([(i, t) for i, t in texts], least)
        got = line_dedup.deduplicated(rows(spark, texts), least).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(want[i, t])) for i, t in texts)
        assert all(r.n_removed == sum(b - a + 1 for a, b in zip(r.first_removed, r.last_removed, strict=True)) for r in got)


def test_long_passage_and_license_line(spark):
    passage = "\n".join(" ".join(f"w{k}x{j}" for j in range(9)) for k in range(7))
    texts = [(i, f"license line of few words\nown {i}\n{passage}\nend {i}") for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(rows(spark, texts)).collect()}
    assert got[0] == texts[0][1]
    assert all(got[i] == f"license line of few words\nown {i}\nend {i}" for i in range(1, 5))


def test_no_rows(spark):
    assert line_dedup.deduplicated(rows(spark, [(1, "a")]).limit(0)).count() == 0
    assert simhash.near_duplicates(rows(spark, [(1, "a")]).limit(0)).count() == 0


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(nodes):
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(nodes):
        for j, y in nodes[:a]:
            if bin(x ^ y).count("1") <= 2:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in nodes}


def test_near_duplicates(spark):
    random.seed(1)
    base = [" ".join(random.choices(["The", "an", "OF", "é", "ring", "tion", "sh", "x\x1cy", "É"], k=random.randint(1, 120))) for _ in range(25)]
    texts = list(enumerate([None, "", " \n", "a", "a b", "A  B\n", "a b c"] + [t.replace("ring", "rang", random.randint(0, 2)) if random.random() < 0.5 else t + " tail" * random.randint(0, 2) for t in base for _ in range(6)]))
    want_fp = {i: slow_fingerprint(t) for i, t in texts}
    want = brute_components(sorted(want_fp.items()))
    got = simhash.near_duplicates(rows(spark, [*texts, (9, texts[9][1]), (None, "alone 1 2 3 4")])).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (int(r.fingerprint, 16), r.component_id) == (want_fp[r.doc_id], want[r.doc_id])


def test_dense_clusters_are_complete(spark):
    random.seed(3)
    values = set()
    for _ in range(3):
        center = random.getrandbits(64)
        for _ in range(150):
            values.add(center ^ (1 << random.randrange(24)) ^ (1 << random.randrange(24)) ^ (1 << random.randrange(64)))
    values |= {random.getrandbits(64) for _ in range(200)}
    nodes = [(v - (1 << 64) if v >> 63 else v, v) for v in sorted(values)]
    nodes.sort()
    want = brute_components(nodes)
    scratch = Scratch(spark)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(i,) for i, _ in nodes], "fp long")), scratch).collect()}
    assert {i: got.get(i, i) for i, _ in nodes} == want


def test_components_of_a_chain(spark):
    scratch = Scratch(spark)
    chain = [(i, i + 1) for i in range(100)] + [(200, 200), (300, 201), (201, 300), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), scratch).collect()}
    assert got == {i: 0 for i in range(101)} | {300: 201, 201: 201}


def test_one_of_each_stays(spark):
    texts = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (7, "quite another text"), (None, "of no id at all"), (8, None), (9, "")]
    got = simhash.keep_one(rows(spark, texts))
    assert got.columns == ["t", "doc_id", "text", "n_lines", "fp"]
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("2", "a b c d"), ("7", "quite another text"), ("8", "None"), ("None", "of no id at all")]
