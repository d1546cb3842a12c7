"""What the operators of this subpackage share: scratch tables, code shipping, folds, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

__all__ = ["PLACE", "WORD", "Remembering", "Scratch", "blocks", "by_place", "delete", "drop_places", "held_out", "hold", "least_hashes", "let", "placed", "shared_dir", "ship", "store_of", "texts", "tidy"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, on a local master, one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("larkspur.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("larkspur.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs no recomputation of what came before.

    `drop` removes those that nothing will read again; the others go when the application ends, or with `end_since`.
    """

    #: All that have not ended, oldest first.
    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/larkspur/{uuid.uuid4().hex}"
        self.opened.append(self)
        atexit.register(self.end)

    @classmethod
    def end_since(cls, mark: int) -> None:
        """Ends what was opened since there were `mark` of them, once a result made with it is written."""
        for scratch in cls.opened[mark:]:
            scratch.end()

    def end(self) -> None:
        if self in self.opened:
            self.opened.remove(self)
        try:
            if self.spark.sparkContext._jsc is not None:
                delete(self.spark, self.base)
        except Exception:  # noqa: BLE001  the JVM may be gone by then; nothing is left to clean with
            pass

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        frame.write.parquet(at)
        out = self.spark.read.schema(frame.schema).parquet(at)
        out._larkspur_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            delete(self.spark, frame._larkspur_path)


#: A row's place: the hash of its file's path, and its number in that file.
PLACE = ["__lk_file", "__lk_row"]
#: Rows of a file whose verdicts are kept together.
CHUNK_BITS = 16


def placed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of `docs` and their places, the same whenever they are read.

    `docs` is used as it is where it is a scan of Parquet files, filtered or projected; anything else is written to the
    shared folder first.
    """
    places = lambda frame: frame.select("*", F.xxhash64(frame.metadataColumn("_metadata")["file_path"]).alias(PLACE[0]), frame.metadataColumn("_metadata")["row_index"].alias(PLACE[1]))
    node, plain = docs._jdf.queryExecution().analyzed(), True
    while plain and node.children().size() == 1:
        plain, node = node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic(), node.children().head()
    if plain and node.nodeName() == "LogicalRelation":
        try:
            return places(docs)
        except AnalysisException:  # files of a kind that has no row numbers
            pass
    return places(scratch.table(docs, "placed"))


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _chunk_of(file: Column, row: Column) -> Column:
    return F.concat_ws("_", F.hex(file), F.shiftright(row, CHUNK_BITS).cast("string"))


class _Verdicts:
    """A worker's view of a table of verdicts: the chunk that was asked for last."""

    def __init__(self, uri: str):
        self.store, self.base = store_of(uri)
        self.key, self.found = None, None

    def chunk(self, key: str) -> pa.Table | None:
        if key != self.key:
            files = [f for f in self.store.get_file_info(fs.FileSelector(f"{self.base}/__lk_chunk={key}", allow_not_found=True)) if f.path.endswith(".parquet")]
            parts = [pq.ParquetFile(self.store.open_input_file(f.path)).read() for f in files]
            self.key, self.found = key, pa.concat_tables(parts).sort_by(PLACE[1]) if parts else None
        return self.found

    def matches(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Table]]:
        """For each chunk of a batch's rows (the last three columns: chunk, file, row): which rows have a verdict, and the verdicts in that order."""
        keys, rows = batch.column(batch.num_columns - 3).dictionary_encode(), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        of = keys.indices.to_numpy(zero_copy_only=False)
        for n, key in enumerate(keys.dictionary.to_pylist()):
            verdicts = self.chunk(key)
            if verdicts is not None:
                mine = np.flatnonzero(of == n)
                there = verdicts.column(PLACE[1]).to_numpy()
                at = np.minimum(np.searchsorted(there, rows[mine]), len(there) - 1)
                hit = there[at] == rows[mine]
                yield mine[hit], verdicts.take(pa.array(at[hit]))


def by_place(docs: DataFrame, verdicts: DataFrame, scratch: Scratch, apply: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema) -> DataFrame:
    """The rows of `docs` (as of `placed`) with `apply` done to each batch of them, which gets the batch without places
    and a list of (numbers of rows, their verdicts).

    `verdicts` has a row for each place that has one, and holds no text: it alone is exchanged, by chunks of 2^16 rows
    of a file, and written to the shared folder; each task then reads the chunks of the rows that it has. The texts stay
    where they are read, however many rows there are.
    """
    ship(docs.sparkSession)
    path = scratch.path("verdicts")
    dealt = verdicts.withColumn("__lk_chunk", _chunk_of(*map(F.col, PLACE))).hint("rebalance", "__lk_chunk")
    dealt.write.partitionBy("__lk_chunk").parquet(path)
    rows = docs.select(*(c for c in docs.columns if c not in PLACE), _chunk_of(*map(F.col, PLACE)).alias("__lk_chunk"), *PLACE)
    width = len(rows.columns) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Verdicts(path)
        for whole in batches:
            for batch in blocks(whole, None):
                yield apply(batch.select(range(width)), list(known.matches(batch)))

    return rows.mapInArrow(tidy(run), schema)


def drop_places(docs: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of `docs` (as of `placed`) whose places are not among `places`."""
    columns = [c for c in docs.columns if c not in PLACE]

    def keep(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        stays = np.ones(batch.num_rows, bool)
        for rows, _ in found:
            stays[rows] = False
        return batch.filter(pa.array(stays))

    return by_place(docs, places.select(*PLACE), scratch, keep, docs.select(*columns).schema)


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that no model is fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def least_hashes(frame: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows: those of the least hashes of their keys, the same on every run.

    Where there are more, a bound on the hash leaves about that many before the sort, so that no task or driver gets
    `most` rows from every partition.
    """
    place = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    total = frame.count()
    if total > most:
        share = 1.1 * most / total + 1000 / total
        frame = frame.where(place <= min(int(share * 2.0**63), 2**63 - 1))
    return frame.orderBy(place, *keys).limit(most)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def texts(batch: pa.RecordBatch, column: int) -> list[str]:
    """A column's strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def blocks(batch: pa.RecordBatch, column: int | None, limit: int = 8 << 20):
    """Slices of the batch whose column (None: all) holds about `limit` bytes, so that long texts don't add up in a worker."""
    sizes = batch.nbytes if column is None else batch.column(column).nbytes
    rows = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, sizes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def trim() -> None:
    """Gives memory that this worker has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """A function over Arrow batches that trims its worker when a task is done: workers wait for tasks beside others that run."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied


_held: list = []


def hold(release) -> None:
    """Called by what makes a worker remember much: the last to have done so gives its memory back with `release`."""
    while _held:
        _held.pop()()
        trim()
    _held.append(release)


class Remembering(dict):
    """A dictionary that makes what it lacks by `make` and keeps what was asked for among the last `most` to twice as many new keys."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.old = {}
