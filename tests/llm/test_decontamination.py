"""Operator 9 against brute force over planted passages."""

import random

import numpy as np
import pytest

from larkspur.llm import decontamination as dc

SCHEMA = "item_id string, doc_id long, text string, cosine int"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_lcs():
    random.seed(1)
    for _ in range(300):
        a, b = (random.choices(range(1, 6), k=random.randint(0, 30)) for _ in range(2))
        assert dc.lcs(a, b) == slow_lcs(a, b)


@pytest.fixture(scope="module")
def planted(spark):
    random.seed(11)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: random.choice(common) if random.random() < 0.4 else "".join(random.choices(["ba", "ko", "ri", "tu", "ne", "sol", "mag"], k=3))
    items = [(k, " ".join(word() for _ in range(random.randint(14, 60)))) for k in range(30)] + [(100, None), (101, ""), (102, "!!"), (5, "of the and to in of the and solbari magtune")]
    docs, truth = [], set()
    for i in range(150):
        words = [word() for _ in range(random.choice([3, 40, 200, 700]))]
        if i % 3 == 0:
            k, text = items[random.randrange(30)]
            passage = text.split()
            if i % 2:
                passage = [word() if j % 9 == 4 and j < len(passage) - 4 else w.upper() + "," for j, w in enumerate(passage)]
            at = random.randint(0, len(words))
            words[at:at] = passage
            truth.add((i, k))
        docs.append(("c", i, " ".join(words), 1))
    docs += [("c", 500, None, 1), ("c", 501, "", 1), ("c", 502, " .. ", 1), ("c", None, items[3][1], 1), ("c", 0, docs[0][2], 1), ("c", 503, "word " * 100000 + items[4][1], 1)]
    truth |= {(None, 3), (503, 4)}
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"), docs, items, truth


def brute(docs, items):
    found = set()
    for _, doc, text, _ in docs:
        words = dc.words_of(text or "")
        for k, item in items:
            own = dc.words_of(item or "")
            for at in range(0, max(1, len(words)), 8) if own and len(words) < 5000 else []:
                if slow_lcs(own, words[at : at + 2 * len(own)]) >= dc.LCS_SHARE * len(own):
                    found.add((doc, k))
                    break
    return found


def test_planted_passages_are_found_and_nothing_else(planted):
    docs, benchmark, rows, items, truth = planted
    got = dc.contaminated(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert truth <= found
    assert brute(rows[:90], items[:30]) <= found
    assert found <= truth | {(d, 5) for d, _ in found}
    assert all(r.cosine >= dc.COSINE and r.lcs_share >= dc.LCS_SHARE and r.answer_share >= dc.ANSWER_SHARE for r in got)
    assert len([r for r in got if r.doc_id == 0]) == 2 * len({k for d, k in found if d == 0})


def test_short_and_changed_items_are_all_found(spark):
    random.seed(12)
    word = lambda: random.choice(["the", "of", "and", "to", "in"]) if random.random() < 0.4 else "".join(random.choices(["ba", "ko", "ri", "tu", "ne", "sol", "mag", "fen"], k=4))
    items, docs, truth = [], [], set()
    for k in range(160):
        item = [word() for _ in range((6, 8, 15, 30)[k % 4])]
        kept = [w if k % 4 < 2 or random.random() < 0.65 else word() for w in item]
        words = [word() for _ in range(300)]
        at = random.randint(0, 300)
        words[at:at] = kept
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(words)))
        rare = {w for w in item if len(w) > 3} & set(kept)
        if rare and slow_lcs(item, kept) >= dc.LCS_SHARE * len(item) and slow_lcs(item[-8:], kept) >= dc.ANSWER_SHARE * len(item[-8:]):
            truth.add((k, k))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(truth) > 120 and truth <= {(r.doc_id, r.item_id) for r in got}
    assert all(r.cosine >= dc.COSINE and r.lcs_share >= dc.LCS_SHARE for r in got)


def test_an_answer_is_asked_of_items_that_have_one(spark):
    random.seed(13)
    word = lambda: "".join(random.choices(["ba", "ko", "ri", "tu", "ne", "sol", "mag", "fen"], k=4))
    item, answer = [word() for _ in range(45)], "forty two days"
    cut = [*(word() for _ in range(200)), *item[:36], *(word() for _ in range(200))]
    docs = spark.createDataFrame([(1, " ".join(cut)), (2, " ".join([*cut[:236], answer, *cut[236:]]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item), None), (8, " ".join(item), answer)], "item_id long, text string, answer string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench.drop("answer")).collect()} == {(1, 7), (1, 8), (2, 7), (2, 8)}
    got = dc.contaminated(docs, bench, answer_col="answer").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7), (2, 8)}


def test_blocks_of_the_benchmark_make_no_difference(planted, monkeypatch):
    docs, benchmark, *_ = planted
    whole = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(dc, "BLOCK_WORDS", 500)
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, benchmark).collect()} == whole


def test_partitions_make_no_difference(planted):
    docs, benchmark, *_ = planted
    rows = [{(r.doc_id, r.item_id, round(r.cosine, 4), r.lcs_share) for r in dc.contaminated(docs.repartition(n), benchmark).collect()} for n in (1, 64)]
    assert rows[0] == rows[1]


def test_long_texts_in_pieces():
    """A text that is cut has the matches of the whole one."""
    random.seed(14)
    word = lambda: "".join(random.choices(["ba", "ko", "ri", "tu", "ne", "sol", "mag", "fen"], k=4))
    bench = [(k, " ".join(word() for _ in range(20 + k)), None) for k in range(30)]
    items = dc.Items.of(bench)
    words = [word() for _ in range(9000)]
    for k, at in enumerate(sorted(random.sample(range(8000), 30))):
        words[at : at + 20 + k] = bench[k][1].split()
    text = " ".join(words)
    terms, numbers = dc.Runs(items.numbers).read(text)
    made, counts = dc.sketch(dc._passages([terms]), np.arange(len(dc._passages([terms])), dtype=np.uint64))
    search = dc.Search(items, dc.space_of(made, counts, 561))
    whole = {k: share for _, k, _, share, _ in search.matches([(terms, numbers)])}
    pieces = search.pieces(len(terms), 64)
    assert len(pieces) == 9 and all(b - a <= (64 + 2 * 5 + 2) * dc.STEP for a, b in pieces)
    cut = {}
    for a, b in pieces:
        for _, k, _, share, _ in search.matches([(terms[a:b], numbers[a:b])]):
            cut[k] = max(share, cut.get(k, 0))
    assert cut == whole and len(whole) >= 25


def test_empty_sides(planted):
    docs, benchmark, *_ = planted
    assert dc.contaminated(docs.limit(0), benchmark).count() == 0
    assert dc.contaminated(docs, benchmark.limit(0)).count() == 0
    kept = dc.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in dc.contaminated(docs, benchmark).collect()}


def test_sketch_keeps_the_large_directions():
    rng = np.random.default_rng(3)
    topics = rng.integers(0, dc.TERMS, (3, 40))
    passages = np.stack([rng.choice(topics[k % 3], dc.LENGTH) for k in range(3000)]).astype(np.int32)
    made, counts = dc.sketch(passages, np.arange(len(passages), dtype=np.uint64))
    assert counts.sum() == sum(len(set(p)) for p in passages)
    weighted = np.zeros((len(passages), dc.TERMS), np.float32)
    np.add.at(weighted, (np.arange(len(passages))[:, None], passages), 1)
    weighted /= np.linalg.norm(weighted, axis=1, keepdims=True)
    exact = np.linalg.eigh(weighted.T[np.unique(passages)] @ weighted[:, np.unique(passages)])[1][:, -3:]
    found = np.linalg.svd(made[:, np.unique(passages)], full_matrices=False)[2][:3].T
    assert np.linalg.svd(exact.T @ found)[1].min() > 0.95
    assert dc.space_of(made, counts, len(passages)).project.shape == (dc.TERMS, dc.RANK)
