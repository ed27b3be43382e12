"""SimHash fingerprints, compared bit by bit across whole blocks.

A block holds one bit plane for each fingerprint bit. For many fingerprints at once, the planes that differ are
added into carry-save counters kept as bit vectors; a pair that passes the radius is marked, and a row of a block is
abandoned once all its pairs are marked. Candidate blocks come from the pigeonhole rule, which loses no pair: of
``bands`` parts of a fingerprint, two within the radius agree in at least ``bands - radius``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm.batches import append_columns
from presswork.operators.components import connected_components
from presswork.shared import written

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints compared as one block, and in how many rows at a time.
BLOCK, TILE = 4096, 256
#: Fingerprints that a bucket may hold on average before more bands are taken, and bands at most.
BUCKET_MEAN, MOST_BANDS = 16, 8


def fingerprints(texts: pa.Array) -> list[np.ndarray]:
    """The fingerprints of texts as signed longs."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        words = text.encode().lower().split()
        if words:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[:-1] + 1).tolist()]
            last = ends[SHINGLE - 1 :].tolist() or [len(line)]
            hashes += [digest(line[s:e], SEED) for s, e in zip(starts, last)]
            sizes[i] = len(last)
    out, some = np.zeros(len(texts), np.uint64), np.flatnonzero(sizes)
    if len(some):
        h = np.array(hashes, np.uint64)
        starts = np.cumsum(sizes[some]) - sizes[some]
        ones = np.empty((len(some), BITS), np.int64)
        for b in range(BITS):
            ones[:, b] = np.add.reduceat((h >> np.uint64(b) & np.uint64(1)).astype(np.int32), starts)
        major = 2 * ones > sizes[some][:, None]
        out[some] = (major.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return [out.view(np.int64)]


def add_fingerprint(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``simhash`` (long): each bit is the majority of the XXH64 hashes of the text's lower-cased 3-word shingles."""
    return append_columns(df, text, [T.StructField("simhash", T.LongType())], fingerprints, drop)


def close_pairs(prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """For each fingerprint that has later ones within the radius: its place and theirs."""
    n = len(prints)
    words = -(-n // 64)
    bits = (prints[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
    planes = np.zeros((BITS, words * 8), np.uint8)
    planes[:, : -(-n // 8)] = np.packbits(bits, axis=1, bitorder="little")
    planes = planes.view(np.uint64)
    digits = max(1, int(radius).bit_length())
    full, places = ~np.uint64(0), np.arange(words * 64)
    for first in range(0, n, TILE):
        rows = np.arange(first, min(first + TILE, n))
        begin = first // 64  # earlier columns were compared before
        skip = (places[None, begin * 64 :] <= rows[:, None]) | (places[None, begin * 64 :] >= n)
        over = np.packbits(skip, axis=1, bitorder="little").view(np.uint64)
        # The counters start so that the carry out of the last digit marks radius + 1 differences.
        counters = [np.full(over.shape, full if (2**digits - 1 - radius) >> d & 1 else np.uint64(0)) for d in range(digits)]
        for b in range(BITS):
            carry = planes[b, begin:][None, :] ^ np.where(bits[b, rows], full, np.uint64(0))[:, None]
            for d in range(digits):
                carry, counters[d] = carry & counters[d], counters[d] ^ carry
            over |= carry
            if b % 8 == 7:
                open_rows = (over != full).any(axis=1)
                if not open_rows.all():
                    rows, over, counters = rows[open_rows], over[open_rows], [c[open_rows] for c in counters]
                    if not len(rows):
                        break
        for row, left in zip(rows, over):
            near = np.flatnonzero(np.unpackbits((~left).view(np.uint8), bitorder="little"))
            yield int(row), near + begin * 64


def _forest(nodes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) that connect what a block's close pairs connect."""
    root = np.arange(len(nodes))
    for row, near in close_pairs(prints):
        met = np.unique(root[np.append(near, row)])
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition; small buckets share a block, as more pairs compared do no harm."""

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        a, b = _forest(rows["node"], rows["print"])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    kind = np.dtype([("bucket", np.int64), ("node", np.int64), ("print", np.uint64)])
    held = np.empty(0, kind)
    for batch in batches:
        rows = np.empty(batch.num_rows, kind)
        for name in kind.names:
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False).view(kind[name])
        held = np.concatenate([held, rows])
        while len(held) > BLOCK:
            last = held["bucket"][BLOCK]
            cut = int(np.searchsorted(held["bucket"], last)) or int(np.searchsorted(held["bucket"], last, "right"))
            if cut == len(held) and held["bucket"][0] == last:
                break  # a bucket that may go on in the next batch
            yield edges(held[:cut])
            held = held[cut:]
    if len(held):
        yield edges(held)


def bands_for(n: int) -> int:
    """Bands for ``n`` distinct fingerprints: as few as keep the buckets small (4 bands have keys of 16 bits, 6 of 32)."""
    return next((b for b in range(RADIUS + 1, MOST_BANDS) if n <= BUCKET_MEAN << BITS * (b - RADIUS) // b), MOST_BANDS)


def link_edges(prints: DataFrame, bands: int = RADIUS + 1, most: int = BLOCK // 2) -> DataFrame:
    """Edges ``(a, b)`` between rows of ``prints(node, print)``, distinct prints, that connect all within the radius.

    Each block gives a spanning forest and not all its pairs. A bucket of more than ``most`` rows is dealt into
    parts, and each two of its parts are compared as one block, so no task holds more than two parts.
    """
    width = [BITS * (i + 1) // bands - BITS * i // bands for i in range(bands)]
    shift = [sum(width[:i]) for i in range(bands)]
    parts = [f"(shiftrightunsigned(print, {s}) & {(1 << w) - 1}L)" for s, w in zip(shift, width)]
    keys = [f"xxhash64({k}, {', '.join(parts[i] for i in chosen)})" for k, chosen in enumerate(combinations(range(bands), bands - RADIUS))]
    rows = prints.select("node", "print", F.expr(f"explode(array({', '.join(keys)}))").alias("bucket"))
    sizes = rows.groupBy("bucket").count().where("count > 1")
    rows = rows.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("count") / most).cast("int"))
    rows = rows.withColumn("part", F.expr("cast(pmod(xxhash64(print, 7), parts) as int)"))
    cells = rows.select("node", "print", "bucket", "parts", "part", F.expr("explode(sequence(0, parts - 1))").alias("other")).where("parts = 1 or part <> other")
    cells = cells.select("node", "print", F.expr("if(parts = 1, bucket, xxhash64(bucket, least(part, other), greatest(part, other)))").alias("bucket"))
    return cells.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare, "a long, b long")


def near_groups(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Add ``component_id``: the smallest id that a document reaches over links of fingerprints (``simhash``).

    Equal fingerprints link, so repeated rows and copies share a component. A null id gets a component and links others,
    but names none; where all ids that are reached are null, it is null. An empty table stays empty. A column of the table named
    ``component_id`` is replaced. ``df`` is read more than once; hand in a written table.
    """
    nodes = written(df.groupBy(F.col("simhash").alias("print")).agg(F.min(doc_id).alias("least")), "prints")
    found = connected_components(link_edges(nodes.select(F.col("print").alias("node"), "print"), bands_for(nodes.count())))
    known = nodes.join(found, nodes.print == found.node, "left").select(F.col("print").alias("simhash"), "least", F.coalesce("component", "print").alias("component"))
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    return df.drop("component_id").join(known.join(named, "component").select("simhash", "component_id"), "simhash", "left")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, simhash, component_id)`` for every row; see add_fingerprint and near_groups."""
    return near_groups(written(add_fingerprint(df.select(doc_id, text), text, drop=(text,)), "simhash"), doc_id)


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row, with its own columns, of every group of near copies: that of the smallest id.

    Of rows with that id, the one stays whose text has the least hash. Rows without an id stay, as nothing names them.
    """
    first = near_duplicates(df, text, doc_id).where(F.col(doc_id) == F.col("component_id")).select(doc_id).distinct()
    same = df.join(first, doc_id, "left_semi").groupBy(F.col(doc_id).alias("__id"))
    named = same.agg(F.min_by(F.struct(*df.columns), F.xxhash64(F.coalesce(text, F.lit("")))).alias("__row")).select("__row.*")
    return named.unionByName(df.where(F.col(doc_id).isNull()))
