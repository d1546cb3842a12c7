"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of whole documents, one after the other, in blocks of 256. A block keeps its least id, and each
id's distance from it in as many bits as nine tenths of the distances need; what the longer ones have above those bits
stands in the block's exception list. An index has the start of each block, and a table the id and the number of ids of
each document, so that any document can be read from its blocks alone.

Layout, little-endian: magic, then the blocks, then the index (u64 starts, and the end of the last block), the
document table (i64 ids, u8 flags for null ids, u32 counts), and a footer (u64 place of the index, u64 number of
blocks, u64 number of documents, u64 number of ids, magic). A block: u32 least id, u8 width, u8 0, u16 number of
exceptions, 32 bytes for each of the low bits (all ids' lowest bits first), u8 positions of the exceptions, u32 high parts of the exceptions.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembering, Scratch, blocks, hold, ship, store_of, texts, tidy
from .token_count import byte_symbols

MAGIC = b"LKPFOR01"
BLOCK = 256
HEADER = np.dtype([("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])
#: Share of a block's distances that the packed width must hold.
PERCENTILE = 0.9
#: A file is closed when it holds this many ids.
FILE_IDS = 4 << 20
#: Ids that are packed at once, whole blocks.
PACKED = 1 << 19
#: Documents that one range of ids holds on average, up to so many ranges; beyond these the documents of a wide range. A
#: range is sorted outside of memory, and written in several files where it holds more than FILE_IDS ids.
RANGE_DOCS, RANGES, WIDE_RANGE_DOCS = 8192, 10_000, 1_000_000
#: Words whose ids a worker remembers; beyond that those not seen among as many new ones are forgotten.
REMEMBERED = 300_000


def _pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids, and the size of each."""
    total = len(ids)
    n = -(-total // BLOCK)
    values = np.empty(n * BLOCK, np.int64)
    values[:total] = ids
    if n:
        values[total:] = ids[-1]  # the last block is filled up; the counts say where it ends
    values = values.reshape(n, BLOCK)
    least = values.min(axis=1, initial=1 << 40) if n else np.empty(0, np.int64)
    away = (values - least[:, None]).astype(np.uint32)
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    fits = np.partition(away, rank, axis=1)[:, rank] if n else np.empty(0, np.uint32)
    width = np.where(fits > 0, np.floor(np.log2(np.maximum(fits, 1).astype(np.float64))) + 1, 0).astype(np.int64)
    high = (away.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, place = np.nonzero(high)
    many = np.bincount(row, minlength=n)
    sizes = HEADER.itemsize + BLOCK // 8 * width + 5 * many
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(int(starts[-1]), np.uint8)
    head = np.zeros(n, HEADER)
    head["least"], head["width"], head["exceptions"] = least, width, many
    out[starts[:-1, None] + np.arange(HEADER.itemsize)] = head.view(np.uint8).reshape(n, HEADER.itemsize)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        low = away[at].astype(np.uint16 if w <= 16 else np.uint32)
        packed = np.concatenate([np.packbits(((low >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(w)], axis=1)
        out[starts[at, None] + HEADER.itemsize + np.arange(packed.shape[1])] = packed
    if len(row):
        first = np.concatenate([[0], np.cumsum(many)])[row]
        lists = starts[row] + HEADER.itemsize + BLOCK // 8 * width[row]
        order = np.arange(len(row)) - first
        out[lists + order] = place.astype(np.uint8)
        at = lists + many[row] + 4 * order
        out[at[:, None] + np.arange(4)] = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), sizes


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one file; ids: all documents' ids, one after the other."""
    packed = [_pack(ids[a : a + PACKED]) for a in range(0, len(ids), PACKED)]
    starts = len(MAGIC) + np.concatenate([[0], np.cumsum(np.concatenate([s for _, s in packed] or [np.empty(0, np.int64)]))]).astype(np.int64)
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    footer = np.array([starts[-1], len(starts) - 1, len(doc_ids), len(ids)], "<u8")
    return b"".join([MAGIC, *(b for b, _ in packed), starts.astype("<u8").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.array(counts, "<u4").tobytes(), footer.tobytes(), MAGIC])


class File:
    """A file's index and documents; `ids` unpacks any range of its ids from the blocks that hold it."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a file of patched frame-of-reference blocks")
        self.data = np.frombuffer(data, np.uint8)
        index, n, docs, self.total = (int(x) for x in np.frombuffer(data[-40:-8], "<u8"))
        self.starts = np.frombuffer(data, "<u8", n + 1, index).astype(np.int64)
        at = index + 8 * (n + 1)
        raw, nulls = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(raw, nulls, strict=True)]
        self.counts = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
        self.ends = np.cumsum(self.counts)

    def ids(self, begin: int, end: int) -> np.ndarray:
        if end <= begin:
            return np.empty(0, np.uint32)
        first, last = begin // BLOCK, (end - 1) // BLOCK + 1
        starts = self.starts[first:last]
        head = self.data[starts[:, None] + np.arange(HEADER.itemsize)].reshape(-1).view(HEADER)
        width, many = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
        out = np.zeros((len(starts), BLOCK), np.uint32)
        for w in np.unique(width[width > 0]):
            at = np.flatnonzero(width == w)
            packed = self.data[starts[at, None] + HEADER.itemsize + np.arange(BLOCK // 8 * w)]
            kind = np.uint16 if w <= 16 else np.uint32
            low = np.zeros((len(at), BLOCK), kind)
            for b in range(w):
                low |= np.left_shift(np.unpackbits(packed[:, BLOCK // 8 * b : BLOCK // 8 * (b + 1)], axis=1, bitorder="little"), b, dtype=kind)
            out[at] = low
        if many.any():
            row = np.repeat(np.arange(len(starts)), many)
            order = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lists = starts[row] + HEADER.itemsize + BLOCK // 8 * width[row]
            high = self.data[(lists + many[row] + 4 * order)[:, None] + np.arange(4)].reshape(-1).view("<u4")
            place = self.data[lists + order].astype(np.int64)
            out[row, place] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
        out += head["least"][:, None]
        return out.reshape(-1)[begin - first * BLOCK : end - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids(int(self.ends[k] - self.counts[k]), int(self.ends[k]))


#: Characters whose lower case is one character that no normalization changes, and how the vocabulary's pre-tokenizer cuts a text of these.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class WordIds(Remembering):
    """Maps a word of lower-cased plain text to its packed ids, as the library's model gives them.

    A text of plain characters without added tokens is cut as the vocabulary's pre-tokenizer does; any other text takes
    the library's whole way.
    """

    def __init__(self, path: str):
        super().__init__(REMEMBERED)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model.tokenize
        self.wide = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        symbols = byte_symbols()
        self.symbols = str.maketrans({chr(c): "".join(symbols[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)})

    def make(self, word: str) -> bytes:
        return array(self.wide, [x.id for x in self.model(word if word.isascii() else word.translate(self.symbols))]).tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return array(self.wide, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, CUT.findall(text.lower())))


_ready: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _ready:
        hold(_ready.clear)
        _ready[path] = WordIds(path)
    return _ready[path]


def ranges_of(rows: int) -> int:
    """Ranges of ids for so many rows: as many more as there are more rows, at any size."""
    return max(1, min(-(-rows // RANGE_DOCS), RANGES), -(-rows // WIDE_RANGE_DOCS))


def write_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends `end_id` to each, and writes files of blocks under `folder` (a URI that all machines
    reach) in ascending order of `id_col` (an integer; nulls first, equal ids by a hash and the order of their token ids).

    The result is the list of files, lazily: doing it is what writes them. Columns: id_range, part, path, n_docs, n_ids.
    Ids are sent, not texts, and once, each range to a task of its own; ranges come from quantiles of the ids alone, so a
    source that holds a third of all rows is spread like any other, and an id (or null) of more rows than a range holds is
    spread over several ranges by the hash. A task that runs twice writes the same bytes to the same name. A null or
    empty text has the end id only. An empty table gives no file.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    rows = ids.agg(F.count("*").alias("all"), F.count("id").alias("known")).first()
    n = ranges_of(rows["known"])
    nulls = ranges_of(rows["all"] - rows["known"]) if rows["all"] > rows["known"] else 0
    cuts = ids.agg(F.percentile_approx("id", [(k + 1) / n for k in range(n - 1)], 20 * n).alias("cuts")).first()["cuts"] if n > 1 else []
    cuts = np.sort(np.array(cuts or [], np.int64))

    wide = np.dtype(word_ids(vocabulary).wide)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(vocabulary)
        for whole in batches:
            for batch in blocks(whole, 1, 4 << 20):
                own = batch.column(0).to_pylist()
                end = array(known.wide, [end_id]).tobytes()
                made = [known.encode(x) + end for x in texts(batch, 1)]
                number, part = np.array([x or 0 for x in own], np.int64), np.array([zlib.crc32(x) for x in made], np.int64)
                at = np.searchsorted(cuts, number, side="left")
                same = np.searchsorted(cuts, number, side="right") - at  # an id that is several cuts has as many ranges
                at += nulls + (part * np.maximum(same, 1) >> 32)
                none = np.array([x is None for x in own], bool)
                at[none] = part[none] * nulls >> 32
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), pa.array(made, pa.binary())], names=["id_range", "id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(lambda: None)  # the words that the tasks before remembered are of no more use
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        docs_in, held, size, at, part = [], [], 0, None, 0

        def flush() -> pa.RecordBatch:
            counts = [len(x) // wide.itemsize for x in held]
            data = encode_file(docs_in, counts, np.frombuffer(b"".join(held), wide))
            name = f"ids-{at:06d}-{part:06d}.pfor"
            temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(data)
            store.move(temporary, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"id_range": pa.array([at], pa.int32()), "part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([len(held)], pa.int64()), "n_ids": pa.array([sum(counts)], pa.int64())})

        for batch in batches:
            for k, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (k != at or size >= FILE_IDS * wide.itemsize):
                    yield flush()
                    part, docs_in, held, size = (part + 1 if k == at else 0), [], [], 0
                elif k != at:
                    part = 0
                at = k
                docs_in.append(doc)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(tidy(encode), "id_range int, id long, ids binary")
    return made.repartitionById(nulls + n, "id_range").sortWithinPartitions("id_range", "id", "ids").mapInArrow(tidy(write), "id_range int, part int, path string, n_docs long, n_ids long")


def with_starts(files: DataFrame) -> DataFrame:
    """The list of files and `start`, the number of ids in all files before each."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("id_range").agg(F.sum("n_ids").alias("range_ids"))  # a row for each range: one for 8192 to a million documents
    ranges = ranges.select("id_range", F.coalesce(F.sum("range_ids").over(before.orderBy("id_range")), F.lit(0)).alias("range_start"))
    within = F.coalesce(F.sum("n_ids").over(before.partitionBy("id_range").orderBy("part")), F.lit(0))
    return files.select("*", within.alias("within")).join(F.broadcast(ranges), "id_range").select(*files.columns, (F.col("range_start") + F.col("within")).alias("start"))


def read_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), and token_ids array<int> unless left out. `files` as of `with_starts`."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(lambda: None)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = store_of(path)
                with store.open_input_stream(name) as source:
                    file = File(source.read())
                step = max(1, len(file.counts) // max(1, file.total >> 19))
                for k in range(0, len(file.counts), step):
                    last = min(len(file.counts), k + step)
                    begin, end = int(file.ends[k] - file.counts[k]), int(file.ends[last - 1])
                    ids = file.ids(begin, end)
                    lows = file.ends[k:last] - file.counts[k:last] - begin
                    raw, highs = memoryview(ids.astype("<u4").tobytes()), lows + file.counts[k:last]
                    columns = [
                        pa.array(file.doc_ids[k:last], pa.int64()),
                        pa.array(start + begin + lows, pa.int64()),
                        pa.array(file.counts[k:last], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lows.tolist(), highs.tolist(), strict=True)], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(lows, highs[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"][: len(columns)])

    return files.select("path", "start").mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids)


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes the files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(spark)
    files = scratch.table(write_files(docs, vocabulary, scratch.path("ids"), end_id), "files")
    n = files.count()
    return read_files(with_starts(files).repartition(max(1, min(n, 10_000), n // 100)), with_ids=False)
