"""Repeated runs of lines, and texts without their later copies.

The corpus is one sequence of lines with words, by document and line. A suffix is what of a document follows from a line
on. Prefix doubling ranks the suffixes by their first 2^k lines: rank 0 is a line's place in the order of all lines
that occur twice or more; rank k + 1 of a suffix is the place of (its rank k, the rank k of the suffix 2^k lines on) in
the sorted order of all such pairs that occur twice or more. A pair of one place only begins no longer repeated run, so
its suffix has no higher rank. Each round is a window over documents, a count of pairs, a sort by range of the pairs
that are left, and a join back; ranks go to the shared folder. Ranks ascend as the suffixes do: the suffixes of one rank
k are a stretch of the suffix array, those with 2^k lines or more in common.

For any n, the suffixes that have the same n lines in front, the interval of longest common prefix n or more, are those
of equal rank k here and equal rank k at n - 2^k lines on, for the largest 2^k up to n. A run is worth deleting if it
has `min_words` words. Each line of a repeated run of so many words is in the shortest such run that starts there, or in
the shortest that ends there or starts before; so these two per line are all whose intervals are looked up, and their
union is the union of all maximal repeated runs. The member of an interval that comes first stays, the others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import PLACE, Scratch, blocks, by_place, placed, ship, tidy

#: Words that a run needs to be deleted, unless another number is asked for; 1 deletes every repeated line.
MIN_WORDS = 50


def windows(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the shortest runs of `min_words` words that start or end at each of a stretch's lines."""
    n = len(words)
    before = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(before, before[:-1] + min_words)  # for each start, the end of its shortest run
    starts = np.searchsorted(before, before[1:] - min_words, side="right") - 1  # for each end
    forward = np.flatnonzero(ends <= n)
    backward = np.flatnonzero(starts >= 0)
    both = np.unique(np.stack([np.concatenate([forward, starts[backward]]), np.concatenate([ends[forward], backward + 1])], axis=1), axis=0)
    return both[:, 0], both[:, 1] - both[:, 0]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line with words: id, t (hash of the whole text), i (its place among these), at (its place among all), h1, h2, w (words)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                rows, hashes, places, counts, whole_text = [], [], [], [], []
                for row, data in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    if not data:
                        continue
                    key = xxhash.xxh64_intdigest(data, 42)
                    for at, line in enumerate(data.split(b"\n")):
                        if w := len(line.split()):
                            rows.append(row)
                            hashes.append(xxhash.xxh3_128_digest(line))
                            places.append(at)
                            counts.append(w)
                            whole_text.append(key)
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                row = np.array(rows, np.int64)
                change = np.flatnonzero(np.diff(row, prepend=-1))
                i = np.arange(len(row)) - np.repeat(change, np.diff(np.append(change, len(row))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(np.array(whole_text, np.uint64).view(np.int64)), pa.array(i, pa.int32()), pa.array(places, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(counts, pa.int32())],
                    names=["id", "t", "i", "at", "h1", "h2", "w"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(split), f"id {kind}, t long, i int, at int, h1 long, h2 long, w int")


def _ranked(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that occur twice or more, and rank: ascending as they do.

    A table of its own, so that adaptive execution can split the rows of a very frequent pair among tasks.
    """
    often = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    # the number of a sorted partition above, of its row below: in the order of the pairs
    return scratch.table(often.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()), "ranks")


def ranks(lines: DataFrame, scratch: Scratch, most_lines: int) -> list[DataFrame]:
    """For each k with 2^k <= `most_lines`, until no pair is left: (id, t, i, rank) of the suffixes whose first 2^k lines occur
    twice or more. `lines` (id, t, i, a, b) has a row for each line that may be in a repeated run, (a, b) its name."""
    out: list[DataFrame] = []
    pairs = lines
    while True:
        classes = _ranked(pairs, scratch)
        out.append(scratch.table(pairs.join(classes, ["a", "b"]).select("id", "t", "i", "rank"), "suffixes"))
        scratch.drop(classes)
        reach = 1 << len(out) - 1
        if 2 * reach > most_lines:
            return out
        on = Window.partitionBy("id", "t").orderBy("i").rangeBetween(reach, reach)
        pairs = out[-1].select("id", "t", "i", F.col("rank").alias("a"), F.first("rank").over(on).alias("b")).where(F.col("b").isNotNull())
        pairs = scratch.table(pairs, "pairs")
        if pairs.isEmpty():
            return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to delete: id, t (xxhash64 of the text), cuts array<struct<first int, last int>>, disjoint and ascending, of line numbers from 0."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    lines = scratch.table(_lines(docs, id_col, text_col), "lines")
    often = scratch.table(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "often")
    again = lines.join(often, ["h1", "h2"], "left_semi").dropDuplicates(["id", "t", "i"])
    # repeated lines side by side are a stretch; one of too few words holds no run of enough
    of = Window.partitionBy("id", "t")
    again = again.withColumn("stretch", F.col("i") - F.row_number().over(of.orderBy("i")))
    again = again.withColumn("words", F.sum(F.col("w").cast("long")).over(Window.partitionBy("id", "t", "stretch"))).where(F.col("words") >= min_words)
    again = scratch.table(again.select("id", "t", "i", "at", "w", "stretch", F.col("h1").alias("a"), F.col("h2").alias("b")), "again")
    # the shortest run of enough words has so many lines at most
    longest = again.groupBy("id", "t", "stretch").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    levels = ranks(again.select("id", "t", "i", "a", "b"), scratch, min(int(longest), min_words))
    parts = [again.select("id", "t", F.lit(-1).alias("k"), "i", F.struct(F.col("at").cast("long").alias("at"), F.col("w").alias("w")).alias("x"))]
    parts += [s.select("id", "t", F.lit(k).alias("k"), "i", F.struct(F.col("rank").alias("at"), F.lit(0).alias("w")).alias("x")) for k, s in enumerate(levels)]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionAll(part)
    # a document's lines and ranks: fewer than its bytes
    gathered = united.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("k", "i", "x.at", "x.w"))).alias("lines"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 2):
                got: list[tuple] = []
                for row, (k, i, at, w) in _arrays(batch.column(2)):
                    base = i[k < 0]
                    size = int(base[-1]) + 1
                    # rank k of the suffix at each line; 0 where it has none, as ranks count from 1 here
                    rank = np.zeros((int(k.max()) + 1, size), np.int64)
                    rank[k[k >= 0], i[k >= 0]] = at[k >= 0] + 1
                    line, words = np.zeros(size, np.int64), np.zeros(size, np.int64)
                    line[base], words[base] = at[k < 0], w[k < 0]
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(base) != 1) + 1, [len(base)]])
                    for low, high in zip(base[edges[:-1]], base[edges[1:] - 1] + 1, strict=True):
                        start, length = windows(words[low:high], min_words)
                        start = start + low
                        level = np.frexp(length.astype(np.float64))[1] - 1
                        known = level < len(rank)
                        start, length, level = start[known], length[known], level[known]
                        here, on = rank[level, start], rank[level, start + length - (1 << level)]
                        both = (here > 0) & (on > 0)
                        start, length, here, on = start[both], length[both], here[both], on[both]
                        last = start + length - 1
                        got.append((np.full(len(start), row), start, last, line[start], line[last], length, here, on))
                if got:
                    own, *rest = (np.concatenate(x) for x in zip(*got, strict=True))
                    own = pa.array(own)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x, pa.int32()) for x in rest[:5]), *(pa.array(x) for x in rest[5:])], names=["id", "t", "i", "j", "first", "last", "n", "a", "b"])

    found = scratch.table(gathered.mapInArrow(tidy(look_up), f"id {kind}, t long, i int, j int, first int, last int, n int, a long, b long"), "runs")
    scratch.drop(lines, often, again, *levels)
    intervals = scratch.table(found.groupBy("n", "a", "b").agg(F.min(F.struct("id", "t", "first")).alias("earliest"), F.count("*").alias("many")).where("many > 1").drop("many"), "intervals")
    later = found.join(intervals, ["n", "a", "b"]).where(F.struct("id", "t", "first") > F.col("earliest"))
    marked = later.groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("i", "j", "first", "last"))).alias("cuts"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for cuts in batch.column(2).to_pylist():
                out: list[dict] = []
                end = -2
                for cut in cuts:
                    if cut["i"] > end + 1:
                        out.append({"first": cut["first"], "last": cut["last"]})
                    else:
                        out[-1]["last"] = max(out[-1]["last"], cut["last"])
                    end = max(end, cut["j"])
                merged.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, pa.list_(CUT))], names=["id", "t", "cuts"])

    out = scratch.table(marked.mapInArrow(join_up, f"id {kind}, t long, cuts array<struct<first:int,last:int>>"), "cuts")
    scratch.drop(found, intervals)
    return out


CUT = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def _arrays(lists: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The fields of each list of structs."""
    flat = lists.flatten()
    fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)]
    ends = np.cumsum(lists.value_lengths().to_numpy())
    for row, (low, high) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
        yield row, [x[low:high] for x in fields]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, the text without later copies of repeated runs, and `__lk_cuts` (null where nothing was deleted).

    Lines end at \\n and are equal byte by byte; those without a word belong to no run, and go if they stand between
    two deleted lines. The first copy, by id (nulls first), hash of the text and line, stays; what repeats inside one text is a copy too.
    Rows of equal id and text are one document and get one result. A null text stays null and an empty one empty; a text
    of later copies only becomes empty. An empty table gives an empty table. Cuts go to the places of rows: no text is exchanged.
    """
    scratch = Scratch(docs.sparkSession)
    rows = placed(docs, scratch)
    cuts = repeated_runs(docs, min_words, id_col, text_col)
    # both sides grow with the corpus, and neither has texts
    verdicts = rows.select(F.col(id_col).alias("__lk_id"), F.xxhash64(text_col).alias("__lk_t"), *PLACE).join(cuts, F.col("__lk_id").eqNullSafe(F.col("id")) & (F.col("__lk_t") == F.col("t"))).select(*PLACE, "cuts")
    at = docs.columns.index(text_col)

    def cut(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        text, cuts = batch.column(at), [None] * batch.num_rows
        mask = np.zeros(batch.num_rows, bool)
        for numbers, verdicts in found:
            mask[numbers] = True
            for k, x in zip(numbers.tolist(), verdicts.column("cuts").to_pylist(), strict=True):
                cuts[k] = x
        if mask.any():
            left = []
            for k in np.flatnonzero(mask).tolist():
                lines = text[k].as_py().split("\n")
                for x in reversed(cuts[k]):
                    del lines[x["first"] : x["last"] + 1]
                left.append("\n".join(lines))
            text = pc.replace_with_mask(text, pa.array(mask), pa.array(left, text.type))
        return pa.RecordBatch.from_arrays([*(text if k == at else c for k, c in enumerate(batch.columns)), pa.array(cuts, pa.list_(CUT))], names=[*batch.schema.names, "__lk_cuts"])

    cuts_type = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))
    return by_place(rows, verdicts, scratch, cut, StructType([*docs.schema.fields, StructField("__lk_cuts", cuts_type)]))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, text, n_lines (of the text as it was; null: 0), n_removed (lines), first_removed, last_removed (line numbers of each cut)."""
    lines = F.greatest(F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)), F.lit(0)).cast("long")
    found = dedup_lines(docs.select(id_col, text_col, lines.alias("n_lines")), min_words, id_col, text_col)
    length = F.aggregate("__lk_cuts", F.lit(0).cast("long"), lambda x, c: x + c["last"] - c["first"] + 1)
    none = F.array().cast("array<int>")
    return found.select(id_col, text_col, "n_lines", F.coalesce(length, F.lit(0)).alias("n_removed"), F.coalesce(F.col("__lk_cuts")["first"], none).alias("first_removed"), F.coalesce(F.col("__lk_cuts")["last"], none).alias("last_removed"))
