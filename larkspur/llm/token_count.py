"""Token counts of a byte-level BPE vocabulary, without making the tokens.

A text is cut at added tokens and by the vocabulary's word pattern. Each word starts as its UTF-8 bytes in a
linked list; a heap gives the adjacent pair of lowest rank (the leftmost on ties), which is merged, until no pair
has a rank. The count is the initial symbols less the merges; no identifiers come into being.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Remembering, blocks, hold, ship, texts

#: Fixed value: the word pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a worker remembers; beyond that those not seen among as many new ones are forgotten.
REMEMBERED = 350_000
SHIFT = 32


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter(Remembering):
    """Maps a word to its number of tokens, counting it when first asked."""

    def __init__(self, path: str):
        super().__init__(REMEMBERED)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.first = [vocabulary[s] for _, s in sorted(byte_symbols().items())]
        #: (left id, right id), packed -> (rank, id of the merged symbol), packed
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] << SHIFT | vocabulary[right]] = rank << SHIFT | vocabulary[left + right]
        self.split = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.words = regex.compile(PATTERN)

    def make(self, word: str) -> int:
        return self.count_symbols(word.encode("utf-8", "replace"))

    def count_symbols(self, data: bytes) -> int:
        size = len(data)
        if size == 1:
            return 1
        ranks, first = self.ranks, self.first
        symbol = [first[b] for b in data]
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            merge = ranks.get(symbol[i] << SHIFT | symbol[i + 1])
            if merge is not None:
                heap.append(((merge >> SHIFT) << SHIFT | i, merge))
        heapify(heap)
        merges = 0
        while heap:
            key, merge = heappop(heap)
            i = key & 0xFFFFFFFF
            j = after[i]
            if j >= size or symbol[i] < 0 or ranks.get(symbol[i] << SHIFT | symbol[j]) != merge:
                continue  # one of the two was merged meanwhile
            merges += 1
            symbol[i], symbol[j] = merge & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                new = ranks.get(symbol[i] << SHIFT | symbol[k])
                if new is not None:
                    heappush(heap, ((new >> SHIFT) << SHIFT | i, new))
            h = before[i]
            if h >= 0:
                new = ranks.get(symbol[h] << SHIFT | symbol[i])
                if new is not None:
                    heappush(heap, ((new >> SHIFT) << SHIFT | h, new))
        return size - merges

    def count(self, text: str) -> int:
        if self.split is not None and "<" in text and (cuts := len(self.split.findall(text))):
            return cuts + sum(sum(map(self.__getitem__, self.words.findall(x))) for x in self.split.split(text))
        return sum(map(self.__getitem__, self.words.findall(text)))


_ready: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _ready:
        hold(_ready.clear)
        _ready[path] = MergeCounter(path)
    return _ready[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `vocabulary` is the path of a byte-level BPE .json file, to be found on every machine. A null text is empty: zero
    tokens. Null ids, repeated ids and repeated rows pass through, one row each; an empty table gives an empty table;
    other columns of `docs` are not read. Texts are taken whole, each in one task; rows need no exchange.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = counter(vocabulary).count
        for whole in batches:
            for batch in blocks(whole, 1):
                rows = texts(batch, 1)
                tokens = [find(x) for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x.encode("utf-8")) for x in rows], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
