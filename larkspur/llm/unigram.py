"""Unigram segmentation over a sentencepiece vocabulary: Viterbi on a double-array trie, and back to text.

Blanks become the marker U+2581 (one more goes in front of a text). Of all ways to cut the marked text into pieces
the one with the highest sum of log scores is taken; on ties the one whose last piece starts earlier. A character that
no piece covers is cut off alone at ten below the lowest score and falls back to its UTF-8 bytes. No piece has a
marker behind another character, or a line feed, so the best path of a text is the best paths of its chunks
(markers and what follows them, or a line feed), and a worker remembers the paths of chunks.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembering, blocks, hold, ship, texts, tidy

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks whose paths a worker remembers; beyond that those not seen among as many new ones are forgotten.
REMEMBERED = 250_000
#: Places of the trie's arrays that are tried at once.
WINDOW = 1024
NORMAL, UNKNOWN, CONTROL, BYTE, UNUSED = range(5)


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: state s goes by byte b to t = base[s] + b + 1 if check[t] == s; value[t] is a key's value or -1."""
    size = 64 * len(keys) + 4 * WINDOW
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    order = sorted(range(len(keys)), key=keys.__getitem__)
    dense = 1  # hardly a place below is free for several children
    todo = [(0, 0, len(order), 0)]
    while todo:
        state, low, high, depth = todo.pop()
        while low < high and len(keys[order[low]]) == depth:
            value[state] = values[order[low]]
            low += 1
        children: list[tuple[int, int, int]] = []
        at = low
        while at < high:
            byte, begin = keys[order[at]][depth], at
            while at < high and keys[order[at]][depth] == byte:
                at += 1
            children.append((byte + 1, begin, at))
        if not children:
            continue
        head = children[0][0]
        begin = max(dense, head + 1)
        while True:
            fits = free[begin : begin + WINDOW].copy()
            for c, _, _ in children[1:]:
                fits &= free[begin + c - head : begin + c - head + WINDOW]
            slot = int(fits.argmax())
            if fits[slot]:
                break
            begin += WINDOW
        if free[dense : dense + WINDOW].mean() < 0.05:
            dense += WINDOW
        base[state] = begin + slot - head
        for c, low, high in children:
            to = base[state] + c
            check[to], free[to] = state, False
            todo.append((int(to), low, high, depth + 1))
    end = int(np.flatnonzero(~free)[-1]) + 1
    return base[:end], check[:end], value[:end]


@dataclass
class Vocabulary:
    """What a worker needs: the trie, and each piece's bytes, score and kind."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    pieces: list[bytes]
    scores: list[float]
    kinds: list[int]
    unknown: int
    byte_ids: list[int]
    chunked: bool

    @classmethod
    def from_pieces(cls, pieces: list[str], scores: list[float], kinds: list[int]) -> Vocabulary:
        normal = [i for i, k in enumerate(kinds) if k == NORMAL and pieces[i]]
        base, check, value = double_array([pieces[i].encode() for i in normal], normal)
        byte_ids = [-1] * 256
        for i, k in enumerate(kinds):
            if k == BYTE:
                byte_ids[int(pieces[i][3:-1], 16)] = i
        inner = any(MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i] for i in normal)
        out = [bytes([byte_ids.index(i)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else pieces[i].replace(MARK, " ").encode() for i, k in enumerate(kinds)]
        return cls(base, check, value, out, scores, kinds, kinds.index(UNKNOWN) if UNKNOWN in kinds else 0, byte_ids, not inner)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Pieces and log scores of a sentencepiece .model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        kind = lambda i: UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i) else BYTE if model.is_byte(i) else UNUSED if model.is_unused(i) else NORMAL
        return cls.from_pieces([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [kind(i) for i in ids])


class Unigram(Remembering):
    """Maps a chunk to the packed ids of its best path, found when first asked."""

    def __init__(self, v: Vocabulary):
        super().__init__(REMEMBERED)
        self.v = v
        self.wide = np.dtype("<u2" if len(v.pieces) <= 1 << 16 else "<u4")
        slack = [0] * 300
        self.base, self.check, self.value = v.base.tolist() + slack, v.check.tolist() + [-1] * 300, v.value.tolist() + slack
        self.unknown_score = min((s for s, k in zip(v.scores, v.kinds, strict=True) if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.byte_kind = np.array([k == BYTE for k in v.kinds])

    def make(self, chunk: str) -> bytes:
        return np.array(self.path(chunk.encode("utf-8", "replace")), self.wide).tobytes()

    def path(self, data: bytes) -> list[int]:
        """Ids of the best path over UTF-8 bytes."""
        base, check, value, scores = self.base, self.check, self.value, self.v.scores
        size = len(data)
        best = [None] * (size + 1)
        best[0] = 0.0
        start, piece = [0] * (size + 1), [-1] * (size + 1)
        at = 0
        while at < size:
            head = data[at]
            step = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
            here, state, end, covered = best[at], 0, at, False
            while end < size:
                to = base[state] + data[end] + 1
                if check[to] != state:
                    break
                state, end = to, end + 1
                found = value[state]
                if found >= 0:
                    score = here + scores[found]
                    if best[end] is None or score > best[end]:
                        best[end], start[end], piece[end] = score, at, found
                    covered = covered or end == at + step
            if not covered:
                end, score = at + step, here + self.unknown_score
                if best[end] is None or score > best[end]:
                    best[end], start[end], piece[end] = score, at, -1
            at += step
        ids: list[int] = []
        end = size
        while end:
            begin = start[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                fallback = [self.v.byte_ids[b] for b in reversed(data[begin:end])]
                ids += [self.v.unknown] if -1 in fallback else fallback
            end = begin
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, self.wide)
        marked = MARK + text.replace(" ", MARK)
        chunks = self.cut.findall(marked) if self.v.chunked else [marked]
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), self.wide)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for: markers are blanks but for the one put in front; bad byte runs become U+FFFD."""
        text = b"".join(map(self.v.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ready: dict[str, Unigram] = {}


def ready(key: str, v: Vocabulary) -> Unigram:
    """The worker's tokenizer, with what it remembers from earlier tasks."""
    if key not in _ready:
        hold(_ready.clear)
        _ready[key] = Unigram(v)
    return _ready[key]


def _shared(docs: DataFrame, vocabulary: str | Vocabulary):
    """The vocabulary, sent to each executor once: its size is that of the pieces, whatever the corpus."""
    v = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary.load(vocabulary)
    ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(v), hashlib.md5(pickle.dumps(v)).hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str | Vocabulary, text_col: str = "text", ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text, unless given) and `ids_col` array<int>, one row per row.

    A null or empty text has no ids. A column of `docs` called like `ids_col` is replaced. Repeated rows, null ids and
    empty tables pass through; a text of any length is one task's work on one row, in linear time and memory.
    """
    sent, key = _shared(docs, vocabulary)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, text_col)]
    source = docs.select(text_col, *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]), f"`{ids_col}` array<int>"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ready(key, sent.value)
        for whole in batches:
            for batch in blocks(whole, 0, 4 << 20):
                rows = [model.encode(x) for x in texts(batch, 0)]
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
                ids = np.concatenate(rows or [np.empty(0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=[*keep, ids_col])

    return source.mapInArrow(tidy(encode), schema)


def decode_documents(frame: DataFrame, vocabulary: str | Vocabulary, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """All columns of `frame` but a former `text_col`, and the text of `ids_col` (null ids: empty text)."""
    sent, key = _shared(frame, vocabulary)
    keep = [c for c in frame.columns if c not in (text_col,)]
    source = frame.select(*keep)
    at = keep.index(ids_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), f"`{text_col}` string"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ready(key, sent.value)
        for whole in batches:
            for batch in blocks(whole, at):
                made = [model.decode(np.array(x or [], np.int64)) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*keep, text_col])

    return source.mapInArrow(tidy(decode), schema)


def round_trips(docs: DataFrame, vocabulary: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text and decodes the ids: id, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), text_crc32 (of the decoded text's UTF-8), round_trip (the text came back; one with
    U+2581 of its own does not). Edge cases as for `encode_documents`."""
    sent, key = _shared(docs, vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ready(key, sent.value)
        for whole in batches:
            for batch in blocks(whole, 1, 4 << 20):
                rows = texts(batch, 1)
                ids = [model.encode(x) for x in rows]
                back = [model.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(model.byte_kind[x].sum()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.encode("utf-8")) for x in back], pa.int64()),
                        pa.array([x == y for x, y in zip(rows, back, strict=True)], pa.bool_()),
                    ],
                    names=[id_col, "n_tokens", "n_byte_tokens", "ids_crc32", "text_crc32", "round_trip"],
                )

    source = docs.select(F.col(id_col), F.col(text_col))
    return source.mapInArrow(tidy(digest), f"`{id_col}` {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, text_crc32 long, round_trip boolean")
