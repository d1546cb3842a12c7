"""SimHash near-duplicates, found over an inverted index of positional bytes.

A fingerprint is 8 bytes, each with its position. Two that differ in at most 2 bits share at least 6 positional bytes,
and so two of the four neighbouring byte pairs. The index lists each different fingerprint under its six choices of two
byte pairs (4 positional bytes a posting, so that postings stay short at any corpus size). Pairs that meet in a posting
get the tally of all positional bytes that they share; those with fewer than 6 go, the others are verified bit by bit.

A posting of more than MOST fingerprints gives no pairs. Its members are linked exactly by another way: two
fingerprints differ in at most 2 bits just if some value differs from either in at most 1, so each member goes to the 65
values around it, at most 65 members meet at a value, and all of them are linked to the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLACE, Scratch, blocks, drop_places, placed, ship, tidy
from .components import components

BITS, BYTES, DIFFER = 64, 8, 2
#: Positional bytes that two linked fingerprints share at least.
SHARED = BYTES - DIFFER
#: Fingerprints in a posting that are paired with each other.
MOST = 8
#: Parts that the rows of a fingerprint are counted in first.
SALTS = 16
SEED = 42


def fingerprint(data: bytes, words_in_shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of UTF-8 text; 0 for one without a word."""
    words = data.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    width = min(words_in_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for low in range(0, n, 1 << 15):
        high = min(n, low + (1 << 15))
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[low:high], starts[low + width : high + width], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """(id, fp bigint) of every row, and its place if `docs` has places; a null text is one without words."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    place = [c for c in PLACE if c in docs.columns]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                made = [fingerprint(x or b"", words_in_shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), *batch.columns[2:]], names=["id", "fp", *place])

    return docs.select(F.col(id_col), F.col(text_col), *place).mapInArrow(tidy(make), ", ".join([f"id {kind}, fp bigint", *(f"{c} bigint" for c in place)]))


def shared_bytes(x: Column, y: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    different = x.bitwiseXOR(y)
    return sum(F.when(F.shiftrightunsigned(different, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(BYTES))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between different fingerprints `fp`: all that meet in short postings, a star for each value of the others.

    Every two fingerprints that differ in at most 2 bits are linked, or connected over links through a third.
    """
    part = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(part(i), 16)).bitwiseOR(part(j)) for n, (i, j) in enumerate(combinations(range(4), 2))]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    met = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    postings = index.join(met, "key")
    short = postings.where(F.col("n") <= MOST).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = short.select(F.explode(F.flatten(F.transform("fps", lambda x, i: F.transform(F.filter("fps", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    near = pairs.where((shared_bytes(F.col("a"), F.col("b")) >= SHARED) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DIFFER))
    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    long = postings.where(F.col("n") > MOST).select("fp").distinct()
    around = long.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("value"))
    stars = around.groupBy("value").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, BITS + 1)).alias("b"))
    return near.union(stars).distinct()


def _labelled(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, words_in_shingle: int) -> DataFrame:
    """`fingerprints` of every row, and component_id."""
    rows = scratch.table(fingerprints(docs, id_col, text_col, words_in_shingle), "fingerprints")
    # in two steps, so that what many tasks have counted of one fingerprint does not meet in one task at once
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("fp", "salt").agg(F.min("id").alias("first"))
    first = scratch.table(salted.groupBy("fp").agg(F.min("first").alias("first")), "first")
    roots = scratch.table(components(links(first.select("fp")), scratch), "roots")
    labelled = first.join(roots, F.col("fp") == F.col("node"))
    least = labelled.groupBy("root").agg(F.min("first").alias("least"))
    # a table of its own, so that adaptive execution can split the rows of a very frequent fingerprint among tasks
    label = first.join(roots.join(least, "root").select(F.col("node").alias("fp"), "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(scratch.table(label, "labels"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id (the least id that links reach, itself included).

    Equal fingerprints are one node, so copies cost no pairs. Texts without words, null ones too, have fingerprint zero
    and are linked like any other. Null ids count for no component_id; where a component has no other it is null.
    Repeated ids and rows each keep their row. An empty table gives an empty table; other columns are not read. Texts
    are read once; the join of rows to fingerprints is left to adaptive execution, which splits a fingerprint that
    holds a large share of the rows.
    """
    found = _labelled(docs.select(id_col, text_col), Scratch(docs.sparkSession), id_col, text_col, words_in_shingle)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """The rows of `docs` that stay when one of each component does: that of the least id (one of them, if rows share it).

    Documents whose ids are null stay if nothing with an id is near them. All columns are kept. What goes is told by
    the places of rows: no text is exchanged.
    """
    scratch = Scratch(docs.sparkSession)
    rows = placed(docs, scratch)
    found = scratch.table(_labelled(rows, scratch, id_col, text_col, words_in_shingle), "near")
    place = F.struct(*PLACE)
    # a row for each component, in a table of its own, so that adaptive execution can split the rows of an id that very many share
    first = scratch.table(found.where("id = component_id").groupBy("component_id").agg(F.min(place).alias("first")), "first")
    again = found.where("id = component_id").join(first, "component_id").where(place > F.col("first"))
    goes = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(*PLACE).union(again.select(*PLACE))
    return drop_places(rows, goes, scratch)
