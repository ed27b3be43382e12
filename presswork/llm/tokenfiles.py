"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes apart from the data.

A file is a run of blocks, each ended by a line feed. A block holds whole documents in ascending order of their ids:

    magic ``PWT2`` | documents d, control bytes c, data bytes b (u32 each) | base (u64): ids of all documents before
    the block | crc32 of the rest (u32) | d document ids (i64) | d lengths (u32) | c control bytes | b data bytes

The upper bit of a length marks a document without an id.

An id is stored as its rank by frequency, in one to four little-endian bytes; a control byte has the lengths of four
ids of one document, two bits each. Blocks are decoded by table lookup on control bytes. ``ranks`` (a table kept beside the files)
turns ranks into ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.llm.batches import filled, slices
from presswork.llm.tokens import END, TOKEN_SLICE, WORD_BPE, binaries, ragged, with_end, word_tokens
from presswork.shared import shared_path, written

MAGIC, HEAD = b"PWT2", struct.Struct("<4sIIIQI")
#: Ids in a block, at least (a longer document is one block), and bytes of a file, about.
BLOCK_IDS, FILE_BYTES = 1 << 18, 32 << 20
#: Ids of a range on average; a range is sorted and written by one task.
PART_IDS = 1 << 24
#: Rows drawn for each range to bound it (eight bytes each).
SAMPLED = 64
#: Words that a worker keeps with their ids.
WORDS = 400_000
#: Where documents without an id stand: before all others.
NO_ID, UNNAMED = -(1 << 63), 1 << 31

#: For each control byte: how many bytes each of its four ids has beyond the first.
MORE = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)
#: For these numbers: which of four bytes are used, as four booleans in one value.
USED = np.array([0x01, 0x0101, 0x010101, 0x01010101], "<u4")


def _taken(lengths: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """Which fields of the documents' control bytes stand for an id; the last byte of a document may have up to three others."""
    free = 4 * quads - lengths
    taken = np.ones(4 * int(quads.sum()), bool)
    taken[ragged(4 * np.cumsum(quads) - free, free)] = False
    return taken


def encode_ranks(ranks: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control bytes and data bytes of each document's unsigned 32-bit ranks."""
    ranks, lengths = np.ascontiguousarray(ranks, "<u4"), lengths.astype(np.int64)
    more = (ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF).view(np.uint8) + (ranks > 0xFFFFFF).view(np.uint8)
    quads = -(-lengths // 4)
    fields = np.zeros(4 * int(quads.sum()), np.uint8)
    fields[_taken(lengths, quads)] = more
    control = fields[::4] | fields[1::4] << 2 | fields[2::4] << 4 | fields[3::4] << 6
    data = ranks.view(np.uint8)[USED.take(more).view(bool)]
    cuts = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[np.concatenate([[0], np.cumsum(lengths)])]
    return binaries(control, quads), binaries(data, np.diff(cuts) + lengths)


def decode_ranks(control: bytes, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """The ranks back, one document after another; each control byte looks up its four lengths."""
    lengths = lengths.astype(np.int64)
    more = MORE.take(np.frombuffer(control, np.uint8), axis=0).reshape(-1)[_taken(lengths, -(-lengths // 4))]
    out = np.zeros(4 * len(more), np.uint8)
    out[USED.take(more).view(bool)] = np.frombuffer(data, np.uint8)
    return out.view("<u4")


def encode_block(keys: list[int | None], lengths: list[int], control: bytes, data: bytes, base: int) -> bytes:
    marked = [n | (UNNAMED if k is None else 0) for k, n in zip(keys, lengths)]
    body = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(marked, "<u4").tobytes() + control + data
    return HEAD.pack(MAGIC, len(keys), len(control), len(data), base, zlib.crc32(body)) + body


def decode_blocks(content: bytes) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Of each block of a file: document ids, lengths, ranks, base. Raises where a block is damaged."""
    at = 0
    while at < len(content):
        magic, docs, n_control, size, base, crc = HEAD.unpack_from(content, at)
        at += HEAD.size
        end = at + 12 * docs + n_control + size
        body = content[at:end]
        if magic != MAGIC or zlib.crc32(body) != crc or content[end : end + 1] != b"\n":
            raise ValueError(f"damaged block that begins at byte {at - HEAD.size}")
        marked = np.frombuffer(body, "<u4", docs, 8 * docs)
        keys, lengths = pa.array(np.frombuffer(body, "<i8", docs), mask=marked >= UNNAMED), marked & (UNNAMED - 1)
        data = 12 * docs + n_control
        yield keys, lengths, decode_ranks(body[12 * docs : data], body[data:], lengths), base
        at = end + 1


def tokenized(df: DataFrame, tokenizer: str = WORD_BPE, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, tie, n_tokens, ids)``, ids as little-endian unsigned integers of 16 bits if the vocabulary allows, else
    32; ``tie`` is their crc32.

    Each task ends with one row of ``n_tokens`` 0, whose ``ids`` count its ids (each id in 32 bits, then each count in
    64 bits), so that frequencies need no further pass.
    """
    width = id_type(tokenizer)
    names = ["doc_id", "tie", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            texts = filled(batch.column(1))
            for low, high in slices(texts, TOKEN_SLICE):
                flat, lengths = with_end(texts.slice(low, high - low), tokenizer, end, WORDS)
                found = np.bincount(flat, minlength=len(total))
                found[: len(total)] += total
                total = found
                ids = binaries(flat.astype(width), lengths)
                ties = pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), ties, pa.array(lengths), ids], names)
            pa.default_memory_pool().release_unused()
        used = np.flatnonzero(total)
        counts = used.astype("<u4").tobytes() + total[used].astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([0]), pa.array([counts], pa.binary())], names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, tie long, n_tokens long, ids binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            n = len(counts) // 12
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(counts, "<u4", n).astype(np.int64)), pa.array(np.frombuffer(counts, "<i8", n, 4 * n))], ["id", "n"])


def id_type(tokenizer: str) -> str:
    return "<u2" if word_tokens(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


class Ranges:
    """Ranges of document ids, about equal in documents; the documents of an id that fills several are dealt by ``tie``.

    ``cuts``: quantiles of the ids. An id that is several of them gets a range of its own, cut into as many parts.
    """

    def __init__(self, cuts: list[int]):
        ids, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        hot = ids[times > 1]
        self.bounds = np.unique(np.concatenate([ids, hot[hot > NO_ID] - 1]))
        self.cut = np.ones(len(self.bounds) + 1, np.int64)
        self.cut[np.searchsorted(self.bounds, hot)] = times[times > 1]
        self.first = np.cumsum(self.cut) - self.cut
        self.parts = int(self.cut.sum())

    def part(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, ids)
        return (self.first[at] + (ties * self.cut[at] >> 32)).astype(np.int32)


def _cuts(ids: DataFrame, wanted: int) -> list[int]:
    """Bounds of ``wanted`` ranges that hold about equally many rows, by some SAMPLED rows for each."""
    if wanted < 2:
        return []
    share = min(1.0, SAMPLED * wanted / max(1, ids.count()))
    found = np.sort(ids.sample(share, 13).toArrow().column("id").to_numpy())
    return found[np.arange(1, wanted) * len(found) // wanted].tolist() if len(found) else []


def write_files(df: DataFrame, path: str, tokenizer: str = WORD_BPE, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenize all rows and write ``path/blocks`` (the files) and ``path/ranks`` (rank, id, n).

    Files and their blocks are in ascending order of ids; null ids come first, the smallest long among them, and rows
    with one id in the order of a checksum of their ids. Null texts are empty; an empty text is the end id alone; an empty table gives no blocks. The
    ids are written once as a table, so texts are tokenized once. Only encoded documents are shuffled, by ranges of ids
    whose bounds and sums (two numbers for each PART_IDS ids) go through the driver, as a sort's own bounds do.
    """
    spark = df.sparkSession
    width = id_type(tokenizer)
    made = written(tokenized(df, tokenizer, END, doc_id, text), "token-ids")
    rows = made.where("n_tokens > 0")

    counts = made.where("n_tokens = 0").select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # The vocabulary bounds these rows, so one window may rank them and each task may hold them.
    ranks = counts.select((F.row_number().over(W.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id", "n")
    ranks.write.parquet(f"{path}/ranks")
    table = spark.read.parquet(f"{path}/ranks").toPandas()
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.uint32)
    rank_of[table["id"].to_numpy(np.int64)] = table["rank"].to_numpy(np.uint32)

    wanted = max(1, round(int(table["n"].sum()) / PART_IDS))
    cuts = _cuts(rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")), wanted)
    ranges = Ranges(cuts)
    shared, dealt = spark.sparkContext.broadcast(rank_of), spark.sparkContext.broadcast(ranges)

    def place(batch: pa.RecordBatch) -> np.ndarray:
        return dealt.value.part(pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(), batch.column("tie").to_numpy())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ranges.parts, np.int64)
        for batch in batches:
            np.add.at(sums, place(batch), batch.column("n_tokens").to_numpy())
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["part", "n"])

    sums = rows.select("doc_id", "tie", "n_tokens").mapInArrow(count, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(ranges.parts, np.int64)
    held[sums.column("part").to_numpy()] = sums.column("n").to_numpy()
    bases = spark.sparkContext.broadcast(np.cumsum(held) - held)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                ids = np.frombuffer(b"".join(some.column("ids").to_pylist()), width)
                control, data = encode_ranks(shared.value[ids], some.column("n_tokens").to_numpy())
                columns = [pa.array(place(some)), some.column("doc_id"), some.column("tie"), some.column("n_tokens"), control, data]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "tie", "n_tokens", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, part, base = 0, None, 0

        def block() -> pa.RecordBatch:
            keys, lengths, control, data = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array([encode_block(keys, lengths, b"".join(control), b"".join(data), base)], pa.binary())], ["block"])

        for batch in batches:
            for p, *row in zip(*(batch.column(n).to_pylist() for n in ("part", "doc_id", "n_tokens", "control", "data"))):
                if held and (p != part or count >= BLOCK_IDS):
                    yield block()
                    base += count
                    held, count = [], 0
                if p != part:
                    part, base = p, int(bases.value[p])
                held.append(tuple(row))
                count += row[1]
        if held:
            yield block()

    encoded = rows.mapInArrow(encode, "part int, doc_id long, tie long, n_tokens long, control binary, data binary")
    ordered = encoded.repartitionById(ranges.parts, "part").sortWithinPartitions("part", "doc_id", "tie", "control", "data")
    content = ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string"))
    # A block is BLOCK_IDS ids of at most five bytes or a longer document, which is a file of its own size at least.
    content.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BYTES // (5 * BLOCK_IDS)).text(f"{path}/blocks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document of the files, ids as little-endian unsigned integers."""
    table = spark.read.parquet(f"{path}/ranks").toPandas()
    id_of = np.zeros(max(1, len(table)), np.uint32)
    id_of[table["rank"].to_numpy(np.int64)] = table["id"].to_numpy(np.uint32)
    shared = spark.sparkContext.broadcast(id_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for keys, lengths, ranks, base in decode_blocks(content.as_py()):
                    lengths = lengths.astype(np.int64)
                    columns = [keys, pa.array(base + np.cumsum(lengths) - lengths), pa.array(lengths), binaries(shared.value[ranks].astype("<u4"), lengths)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("content")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(df: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Write the files in the shared folder and read them back."""
    path = shared_path(df.sparkSession, "token-files")
    write_files(df, path, tokenizer)
    return read_files(df.sparkSession, path)
