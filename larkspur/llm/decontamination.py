"""Benchmark passages in documents, by latent semantic retrieval with exact checks.

Documents are cut into passages of LENGTH words, a new one every STEP words. Terms (hashed to TERMS) are weighted by
their share of a passage's norm and their inverse passage frequency. A distributed randomised SVD gives the latent
space: the transposed matrix times a sparse random test matrix (each passage is added, with a random sign, to one of
SKETCH rows) is summed over all passages of all documents, and the small sketch's right singular vectors, scaled by
their singular values, project terms. Passages and benchmark items meet by cosine there; candidates are then checked by
the longest common subsequence of the item's words and the words around the passage, and the same for its answer, if it
has one.
A short or much changed item is a small part of a passage that holds it, and its cosine low. So passages under the bar
are checked too, for the items that no closer passage of their text matches; there the item's words that are near, not
the whole passage, must be at the bar, which only words that are nearly all common fail.

A common subsequence of the least length needs so many of an item's words near the passage; a passage with too few of
an item's rarer words near it is not held against that item, which loses nothing.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Remembering, Scratch, blocks, drop_places, hold, placed, ship, texts, tidy

LENGTH, STEP = 32, 16
TERMS, SKETCH, RANK = 1 << 13, 128, 96
COSINE, LCS_SHARE, ANSWER_SHARE = 0.5, 0.6, 0.5
#: A term in more than this share of passages is common.
COMMON = 0.05
#: Benchmark words that are searched for at once; a larger benchmark takes several turns.
BLOCK_WORDS = 400_000
#: Words that a worker remembers; beyond that those not seen among as many new ones are forgotten.
REMEMBERED = 100_000
EDGES = re.compile(r"^\W+|\W+$")


def term_of(word: str) -> int:
    return zlib.crc32(word.encode()) & (TERMS - 1)


def words_of(text: str) -> list[str]:
    """Runs without white space, lower-cased, without the signs at their ends."""
    return [w for x in text.lower().split() if (w := EDGES.sub("", x))]


class Runs(Remembering):
    """Maps a lower-cased run without white space to its word's number in the benchmark (0 if none) and term, packed; -1 without a word."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__(REMEMBERED)
        self.numbers = numbers

    def make(self, run: str) -> int:
        word = run if run.isalnum() else EDGES.sub("", run)
        return self.numbers.get(word, 0) << 16 | term_of(word) if word else -1

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and numbers of a text's words."""
        runs = text.lower().split()
        packed = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        packed = packed[packed >= 0]
        return (packed & 0xFFFF).astype(np.uint16), (packed >> 16).astype(np.uint32)


_runs: dict[str, Runs] = {}


def runs_for(key: str, numbers: dict[str, int]) -> Runs:
    """What the worker remembers of earlier tasks on the same block of the benchmark."""
    if key not in _runs:
        hold(_runs.clear)
        _runs[key] = Runs(numbers)
    return _runs[key]


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of each text filled up to whole steps with -1, one after the other, and the number of steps of each."""
    steps = np.array([-(-len(x) // STEP) for x in rows], np.int64)
    out = np.full(int(steps.sum()) * STEP, -1, np.int32)
    at = np.concatenate([[0], np.cumsum(steps)]) * STEP
    for x, a in zip(rows, at, strict=False):
        out[a : a + len(x)] = x
    return out.reshape(-1, STEP), steps


def _passages(rows: list[np.ndarray]) -> np.ndarray:
    """(n, LENGTH) terms of the passages of all texts, -1 where there is no word; the last step of a text is in the passage before it."""
    grid, steps = _padded(rows)
    if not len(grid):
        return np.empty((0, LENGTH), np.int32)
    following = np.vstack([grid[1:], np.full((1, STEP), -1, np.int32)])
    ends = np.cumsum(steps[steps > 0]) - 1
    following[ends] = -1
    both = np.hstack([grid, following])
    alone = np.zeros(len(grid), bool)
    alone[ends[steps[steps > 0] > 1]] = True
    return both[~alone]


def drawn(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The random test matrix: row and sign of each passage, by its key alone (the steps are those of splitmix64)."""
    x = keys + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(8)).astype(np.int64) % SKETCH, np.where(x & np.uint64(1), 1.0, -1.0)


def sketch(passages: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What passages add to the sketch (SKETCH, TERMS), without weights of terms, and to the terms' passage counts."""
    ordered = np.sort(passages, axis=1)
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    counts = np.bincount(ordered[new & (ordered >= 0)], minlength=TERMS)
    # a passage's norm: the root of the sum of squared counts
    run = np.cumsum(new.ravel()) - 1
    times = np.bincount(run[ordered.ravel() >= 0], minlength=run[-1] + 1 if len(run) else 0)
    first = np.flatnonzero(new.ravel())
    norms = np.sqrt(np.maximum(np.bincount(first // LENGTH, (times**2).astype(np.float64), len(passages)), 1))
    row, sign = drawn(keys)
    sign = sign / norms
    real = passages >= 0
    at = (row[:, None] * TERMS + passages)[real]
    return np.bincount(at, np.broadcast_to(sign[:, None], passages.shape)[real], SKETCH * TERMS).reshape(SKETCH, TERMS), counts


@dataclass
class Space:
    """project: (TERMS, RANK), with the terms' weights in it; common: terms in more than COMMON of the passages."""

    project: np.ndarray
    common: np.ndarray

    def place(self, passages: np.ndarray) -> np.ndarray:
        """Unit vectors of passages; zero for those without terms."""
        return self._unit(np.vstack([self.known[passages[a : a + 1024]].sum(axis=1) for a in range(0, len(passages), 1024)] or [self.project[:0]]))

    def place_pairs(self, steps: np.ndarray, chosen: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Unit vectors of the passages that begin at the chosen steps; goes_on: whether the next step is of the same text."""
        use = np.zeros(len(steps) + 1, bool)
        use[chosen] = True
        use[chosen[goes_on[chosen]] + 1] = True
        at = np.flatnonzero(use)
        sums = np.zeros((len(steps) + 1, self.project.shape[1]), np.float32)
        for a in range(0, len(at), 256):
            sums[at[a : a + 256]] = self.known[steps[at[a : a + 256]]].sum(axis=1)
        return self._unit(sums[chosen] + sums[chosen + 1] * goes_on[chosen, None])

    @property
    def known(self) -> np.ndarray:
        """The projection, and zeros for no term at -1."""
        if not hasattr(self, "_known"):
            self._known = np.vstack([self.project, np.zeros((1, self.project.shape[1]), np.float32)])
        return self._known

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _sums(frame: DataFrame, spark: SparkSession) -> np.ndarray:
    """The sum of vectors (part, data binary of float64) by part, in two rounds, so that no task adds up all tasks' sketches at once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(data, np.float32).astype(np.float64)
                held[part] = held[part] + values if part in held else values
        for part, values in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values.astype(np.float32).tobytes()], pa.binary())], names=["part", "data"])

    spread = frame.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(8))).repartition(32, "part", "salt").select("part", "data").mapInArrow(add, "part int, data binary")
    rows = spread.repartition(16, "part").mapInArrow(add, "part int, data binary").collect()  # SKETCH + 1 rows of TERMS numbers: 4 MB
    out = np.zeros((SKETCH + 1, TERMS))
    for r in rows:
        out[r.part] = np.frombuffer(r.data, np.float32)
    return out


def latent_space(tokens: DataFrame) -> Space:
    """The space of all passages of `tokens` (id, terms binary of unsigned 16-bit integers)."""
    spark = tokens.sparkSession

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros((SKETCH, TERMS)), np.zeros(TERMS)
        for whole in batches:
            for batch in blocks(whole, 1, 1 << 20):
                rows = [np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]
                passages = _passages(rows)
                if len(passages):
                    # a passage's part of the test matrix follows from its document and place: neither the partitions nor a task that runs again change it
                    many = [max(1, -(-len(x) // STEP) - 1) if len(x) else 0 for x in rows]
                    keys = np.repeat(np.array([zlib.crc32(repr(x).encode()) << 32 for x in batch.column(0).to_pylist()], np.uint64), many)
                    place = np.arange(len(keys)) - np.repeat(np.cumsum(many) - many, many)
                    made, seen = sketch(passages, keys + place.astype(np.uint64))
                    total += made
                    counts += seen
        n = float(counts.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH + 1), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in [*total, counts]], pa.binary())], names=["part", "data"])

    sums = _sums(tokens.select("id", "terms").mapInArrow(tidy(collect), "part int, data binary"), spark)
    many = tokens.select(F.sum(F.greatest(F.lit(1), F.ceil(F.length("terms") / (2 * STEP)) - 1)).alias("n")).first()["n"] or 0
    return space_of(sums[:SKETCH], sums[SKETCH], int(many))


def space_of(sketched: np.ndarray, counts: np.ndarray, passages: int) -> Space:
    weight = np.log((passages + 1.0) / (counts + 1.0)) + 0.01
    _, values, rows = np.linalg.svd(sketched * weight, full_matrices=False)
    keep = min(RANK, max(1, int((values > values[0] * 1e-6).sum())))
    project = (rows[:keep].T / np.maximum(values[:keep], 1e-9)) * weight[:, None]
    scale = np.abs(project).max() or 1.0
    return Space((project / scale).astype(np.float32), counts > COMMON * max(1, passages))


def lcs(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit of the item in parallel."""
    places: dict[int, int] = {}
    for i, x in enumerate(item):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for x in words:
        y = row & places.get(x, 0)
        if y:
            row = (row + y | row - y) & full
    return len(item) - row.bit_count()


@dataclass
class Items:
    """A block of the benchmark, shorter items first: known words, and each item's words and answer (by number) and terms."""

    ids: list
    numbers: dict[str, int]
    words: list[list[int]]
    answers: list[list[int]]
    terms: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        numbers: dict[str, int] = {}
        number = lambda ws: [numbers.setdefault(w, len(numbers) + 1) for w in ws]
        rows = sorted(rows, key=lambda r: len(words_of(r[1])))
        split = [words_of(text) for _, text, _ in rows]
        return cls([r[0] for r in rows], numbers, [number(w) for w in split], [number(words_of(r[2] or "")) for r in rows], [np.array([term_of(x) for x in w], np.uint16) for w in split])


class Search:
    """A block of the benchmark in the latent space, ready to be held against texts."""

    def __init__(self, items: Items, space: Space):
        self.items, self.space = items, space
        padded = np.full((len(items.terms), max(map(len, items.terms), default=0)), -1, np.int32)
        for k, t in enumerate(items.terms):
            padded[k, : len(t)] = t
        self.placed = space.place(padded)
        #: How many steps an item's words reach before and after a passage.
        self.reach = np.array([-(-len(t) // STEP) for t in items.terms], np.int64)
        rare = np.zeros(len(items.numbers) + 1, bool)
        for w, n in items.numbers.items():
            rare[n] = not space.common[term_of(w)]
        sizes = [len(w) for w in items.words]
        #: How many of its rarer words a match of each item has near it at least.
        self.needs = np.array([np.ceil(LCS_SHARE * n) - (~rare[np.array(w, int)]).sum() for n, w in zip(sizes, items.words, strict=True)], np.int64)
        owners: list[list[int]] = [[] for _ in range(len(items.numbers) + 1)]
        for k, w in enumerate(items.words):
            for n in set(w):
                if rare[n]:
                    owners[n].append(k)
        self.owner = np.array([k for o in owners for k in o], np.int64)
        self.many = np.array([len(o) for o in owners], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.many)])[:-1]

    def pieces(self, words: int, room: int) -> list[tuple[int, int]]:
        """Where a text of so many words is cut for `room` steps at once: each piece reaches as far into its neighbours as words near a passage do."""
        if words <= room * STEP:
            return [(0, words)]
        beyond = (int(self.reach.max(initial=0)) + LENGTH // STEP) * STEP
        return [(max(0, a - beyond), min(words, a + room * STEP + beyond)) for a in range(0, words, room * STEP)]

    def enough(self, numbers: np.ndarray) -> np.ndarray:
        """(steps, items): whether the words near the passage that begins at a step are enough of an item's rarer words."""
        steps = len(numbers) // STEP
        at = np.flatnonzero(self.many[numbers])
        many = self.many[numbers[at]]
        owner = self.owner[np.repeat(self.first[numbers[at]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        width = len(self.needs)
        found = np.bincount(np.repeat(at // STEP, many) * width + owner, minlength=steps * width).reshape(steps, width).astype(np.int32)
        upto = np.vstack([np.zeros((1, width), np.int32), np.cumsum(found, axis=0, dtype=np.int32)])
        start = np.arange(steps)
        out = np.empty((steps, width), bool)
        for reach in np.unique(self.reach):
            k = slice(*np.searchsorted(self.reach, [reach, reach + 1]))
            own = upto[:, k]
            out[:, k] = own[np.minimum(steps, start + LENGTH // STEP + reach)] - own[np.maximum(0, start - reach)] >= self.needs[k]
        return out

    def shared(self, k: int, near: set[int]) -> float:
        """The cosine of an item and those of its words that are near a passage."""
        at = np.fromiter(map(near.__contains__, self.items.words[k]), bool, len(self.items.words[k]))
        return float(self.space.place(self.items.terms[k][at][None].astype(np.int32))[0] @ self.placed[k])

    def matches(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, float, float, float]]:
        """Matches in texts of (terms, numbers): place of the text, number of the item, cosine, shares of its words and of its answer's that stand in order.

        Texts are laid one after the other, so that a few array operations serve many of them; words of a neighbour can
        only let a passage through to the exact checks, which see its own text alone.
        """
        grid, steps = _padded([t for t, _ in texts])
        if not len(grid):
            return []
        numbers = np.zeros(grid.size, np.uint32)
        numbers[grid.ravel() >= 0] = np.concatenate([n for _, n in texts])
        owner = np.repeat(np.arange(len(texts)), steps)
        first = np.cumsum(steps) - steps
        goes_on = np.append(owner[1:] == owner[:-1], False)
        enough = self.enough(numbers)
        enough[~goes_on & (steps[owner] > 1)] = False  # the last step of a text is in the passage before it
        chosen = np.flatnonzero(enough.any(axis=1))
        if not len(chosen):
            return []
        cosines = self.space.place_pairs(grid, chosen, goes_on) @ self.placed.T
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        close, held = cosines >= COSINE, enough[chosen]
        matched: set[tuple[int, int]] = set()
        # those below COSINE come last, for items that no closer passage of the text matches
        far = ((p, k) for p, k in zip(*np.nonzero(~close & held), strict=True) if (int(owner[chosen[p]]), k) not in matched)
        for p, k in chain(zip(*np.nonzero(close & held), strict=True), far):
            item, own = self.items.words[k], int(owner[chosen[p]])
            size, start = len(item), int(chosen[p] - first[own]) * STEP
            near = texts[own][1][max(0, start - size) : start + LENGTH + size]
            near = near[near > 0].tolist()
            if not close[p, k] and sum(map(set(near).__contains__, item)) < LCS_SHARE * size:
                continue
            share = lcs(item, near) / size
            if share < LCS_SHARE:
                continue
            answer = self.items.answers[k]
            right = lcs(answer, near) / len(answer) if answer else 1.0
            if right < ANSWER_SHARE:
                continue
            cosine = cosines[p, k] if close[p, k] else self.shared(k, set(near))
            if cosine >= COSINE and ((own, k) not in best or (share, cosine) > best[own, k][1::-1]):
                best[own, k] = (float(cosine), share, right)
                if close[p, k]:
                    matched.add((own, k))
        return [(own, int(k), *v) for (own, k), v in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """A row for each document and benchmark item that is in it: id, item, cosine, lcs_share, answer_share (of the best place; 1 for an item
    without an answer, against which only its own words are held).

    Words are runs without white space, lower-cased and without signs at their ends. Null and empty texts match nothing, nor do items
    without a word. Repeated rows and ids on either side give a row each. The benchmark is the query set, held against
    all passages in blocks of BLOCK_WORDS words; an empty one, or no documents, gives no rows. Texts are tokenised once;
    terms and the numbers of benchmark words go to the shared folder, and both passes over them need no exchange but of
    sketches.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, cosine double, lcs_share double, answer_share double"

    def turns() -> Iterator[Items]:
        rows, size = [], 0
        answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
        for r in benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"), answer.alias("a")).toLocalIterator():
            if words := words_of(r.t or ""):
                rows.append((r.i, r.t, r.a))
                size += len(words)
                if size >= BLOCK_WORDS:
                    yield Items.of(rows)
                    rows, size = [], 0
        if rows:
            yield Items.of(rows)

    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    space, out = None, spark.createDataFrame([], schema)
    for items in turns():
        sent = spark.sparkContext.broadcast(items)  # BLOCK_WORDS and one item's words at most

        key = hashlib.md5(pickle.dumps(items.numbers)).hexdigest()

        def tokenise(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            read = runs_for(key, sent.value.numbers).read
            for whole in batches:
                for batch in blocks(whole, 1, 4 << 20):
                    found = [read(x) for x in texts(batch, 1)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], names=["id", "terms", "numbers"])

        tokens = scratch.table(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(tokenise), f"id {kind}, terms binary, numbers binary"), "tokens")
        space = space or latent_space(tokens)
        placed = spark.sparkContext.broadcast(space)  # TERMS times RANK numbers: 3 MB

        def search(batches: Iterator[pa.RecordBatch], sent=sent, placed=placed) -> Iterator[pa.RecordBatch]:
            ready = Search(sent.value, placed.value)
            room = max(64, 800_000 // max(1, len(ready.items.ids)))
            for batch in batches:
                docs, terms, numbers = (c.to_pylist() for c in batch.columns)
                pieces = [(i, a, b) for i, x in enumerate(terms) for a, b in ready.pieces(len(x) // 2, room)]
                turn = np.cumsum([(b - a) // STEP + 1 for _, a, b in pieces]) // room
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for t in np.unique(turn):
                    some = [pieces[p] for p in np.flatnonzero(turn == t)]
                    for own, k, *rest in ready.matches([(np.frombuffer(terms[i], np.uint16)[a:b], np.frombuffer(numbers[i], np.uint32)[a:b]) for i, a, b in some]):
                        key = (some[own][0], k)
                        if key not in best or (rest[1], rest[0]) > (best[key][1], best[key][0]):
                            best[key] = tuple(rest)
                got = [(docs[i], ready.items.ids[k], *rest) for (i, k), rest in best.items()]
                columns = [list(c) for c in zip(*got, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], item_type), *(pa.array(c, pa.float64()) for c in columns[2:])], names=[id_col, item_col, "cosine", "lcs_share", "answer_share"])

        out = out.union(scratch.table(tokens.mapInArrow(tidy(search), schema), "matches"))
        scratch.drop(tokens)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose ids no benchmark item is in, all columns. What goes is told by the places of rows: no text is exchanged."""
    scratch = Scratch(docs.sparkSession)
    rows = placed(docs, scratch)
    goes = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__lk_id")).distinct()
    return drop_places(rows, rows.join(goes, F.col(id_col).eqNullSafe(F.col("__lk_id")), "left_semi"), scratch)
