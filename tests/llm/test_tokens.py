"""Operators 4, 6 and 10 against the tokenizer libraries and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import pfor, token_count, unigram
from larkspur.llm.queries import vocabulary

ODD = [None, "", " ", "\n\n", "a", "It's <|endoftext|> we'll  see\x1c\x85 12345 漢字 \U0001f642!!\n\t x", "The CAFÉ ñ ẛ̣", "x" * 5000, "word " * 3000, "A.\n\nB  c"]
SCHEMA = "n_tokens string, doc_id long, text string, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(5)
    made = ["".join(random.choice([" ", "\n", "the", "ing", "'s", "!!", "é", "7", "Qu", "<|", "漢"]) for _ in range(random.randint(0, 60))) for _ in range(150)]
    rows = [("clash", i - 3, x, 1) for i, x in enumerate(ODD + made)] + [("clash", None, "no id", 1), ("clash", 4, "same id", 1), ("clash", 4, "same id", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_counts_equal_the_library(docs):
    lib = library("byte_bpe_50k.json")
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect())
    assert sorted((str(a), b, c, d) for a, b, c, d in token_count.token_counts(docs, vocabulary("byte_bpe_50k.json")).collect()) == want


def test_counts_of_no_rows(docs):
    assert token_count.token_counts(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_files_hold_what_the_library_gives(spark, docs):
    lib = library("word_bpe_49k.json")
    rows = [(r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    want, start = [], 0
    for doc, ids in rows:
        want.append((str(doc), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = pfor.round_trip(spark, docs, vocabulary("word_bpe_49k.json")).collect()
    assert sorted((str(a), b, c, d) for a, b, c, d in got) == sorted(want)


def test_several_ranges_and_files(spark, docs, monkeypatch):
    monkeypatch.setattr(pfor, "RANGE_DOCS", 20)
    scratch = pfor.Scratch(spark)
    files = scratch.table(pfor.write_files(docs, vocabulary("word_bpe_49k.json"), scratch.path("ids")), "files")
    assert files.count() > 3
    back = pfor.read_files(pfor.with_starts(files)).orderBy("start").collect()
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back[:-1])]).tolist()
    assert all(len(r.token_ids) == r.n_tokens for r in back)


def test_no_documents_no_files(spark, docs):
    assert pfor.round_trip(spark, docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("top", [0, 1, 255, 70_000, 2**32 - 1])
@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(top, size):
    rng = np.random.default_rng(size)
    ids = np.where(rng.random(size) < 0.05, rng.integers(0, top + 1, size), rng.integers(0, min(top, 99) + 1, size)).astype(np.uint32)
    file = pfor.File(pfor.encode_file([7, None], [size // 3, size - size // 3], ids))
    assert file.doc_ids == [7, None] and np.array_equal(file.ids(0, size), ids)
    assert np.array_equal(file.document(1), ids[size // 3 :])


def test_files_are_small():
    ids = np.random.default_rng(1).integers(100, 356, 1 << 16).astype(np.uint32)
    assert len(pfor.encode_file([1], [1 << 16], ids)) < 1.1 * (1 << 16)


@pytest.fixture(scope="module")
def pieces():
    return unigram.Vocabulary.load(vocabulary("piece_bpe_32k.model"))


def brute(v, text):
    """Best sum of scores over all cuts, by a dictionary of pieces."""
    known = {p: s for p, s, k in zip([x.decode().replace(" ", "▁") if k == unigram.NORMAL else "" for x, k in zip(v.pieces, v.kinds, strict=True)], v.scores, v.kinds, strict=True) if k == unigram.NORMAL}
    low = min(known.values()) - unigram.UNKNOWN_PENALTY
    text = "▁" + text.replace(" ", "▁")
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 50), end):
            score = known.get(text[begin:end], low if end - begin == 1 else None)
            if score is not None and (best[end] is None or best[begin] + score > best[end]):
                best[end] = best[begin] + score
    return best[-1], low


def test_paths_are_best(pieces):
    model = unigram.Unigram(pieces)
    random.seed(2)
    for _ in range(60):
        text = "".join(random.choice([" ", "the", "tion", "er", "x", "ñ", "Q", "\n", ".", "漢", "\U0001f642"]) for _ in range(random.randint(1, 25)))
        want, low = brute(pieces, text)
        got, at, ids = 0.0, 0, model.encode(text).tolist()
        while at < len(ids):
            if pieces.kinds[ids[at]] == unigram.BYTE:
                lead = pieces.pieces[ids[at]][0]
                at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                got += low
            else:
                got += pieces.scores[ids[at]]
                at += 1
        assert got == pytest.approx(want, rel=1e-12)


def test_unigram_round_trip(docs, pieces):
    rows = unigram.round_trips(docs, pieces).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    back = unigram.decode_documents(unigram.encode_documents(docs, pieces, keep=["doc_id", "bucket", "n_tokens"]), pieces)
    assert back.columns == ["doc_id", "bucket", "n_tokens", "token_ids", "text"]
    a = back.select("doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).collect()
    b = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert unigram.round_trips(docs.limit(0), pieces).count() == 0
    marked = docs.limit(1).withColumn("text", F.lit("a▁b"))
    assert [r.round_trip for r in unigram.round_trips(marked, pieces).collect()] == [False]


def test_trie_finds_exactly_its_keys():
    random.seed(4)
    keys = sorted({bytes(random.choices(b"abc\xff\x00", k=random.randint(1, 6))) for _ in range(400)})
    base, check, value = unigram.double_array(keys, list(range(len(keys))))

    def find(key):
        state = 0
        for b in key:
            to = base[state] + b + 1
            if to >= len(check) or check[to] != state:
                return -1
            state = to
        return value[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"q") == -1 for k in keys)
