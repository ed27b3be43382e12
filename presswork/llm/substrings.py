"""Removal of passages that earlier documents hold, by relative Lempel-Ziv parsing against reference blocks.

The corpus is its own reference. A reference block holds, for one anchor, the windows of ``WINDOW`` words around that
anchor, indexed by their hashes, each with the first place (least document, then least word) where it stands. Anchors
are minimizers: of each window the five words whose hash is least. A window can only stand in the block of its own
anchor, so to look there is to look in every block.

Each document is cut at its anchors, and its stretches are parsed against their blocks from left to right: a factor
begins at a window that an earlier document holds and runs on as long as the text goes on alike at the factor's source.
Factors of under thirteen words can't count, so windows are the parse's least unit. They overlap by twelve words, so the
windows that cross from one factor to the next are looked up as all others: these are the checks at the boundaries. When
a document is put together, factors whose sources adjoin are joined, and the words under all factors are removed.

Stretches that repeat within a slice of the input are factored there, so what a passage that most documents share adds
to a shuffle grows with the slices and not with the documents. Blocks that would hold many windows, of a phrase that
stands in many surroundings, are told beforehand by a sample; their stretches are cut into single windows, each of which
makes a block of its own. A block that the sample misses gives the same result, in one larger block. Stretches travel
packed by buckets of blocks; a bucket is about BUCKET_WINDOWS windows and is parsed by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.batches import filled, slices, words_of
from presswork.llm.tokens import ragged
from presswork.shared import written

WINDOW, ANCHOR = 13, 5
#: Windows of a stretch at most; longer ones, of text that repeats itself, are cut.
STRETCH = 255
#: Windows in a block from which it is cut into single windows, and the share of the stretches (1 in so many) that tells.
HOT_WINDOWS, SAMPLE = 1 << 18, 64
#: Windows of a bucket, about (a window takes some 60 bytes while its bucket is parsed).
BUCKET_WINDOWS = 2_000_000
#: Bytes of a window's hash that travel, beside the eight of its anchor's.
HASH_BYTES = 6
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
FACTOR = "struct<start: long, windows: long, source_id: long, source_start: long>"


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _ODD + h[j : j + n]
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def _runs(texts: pa.Array, hot: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Stretches of texts: where their windows begin in ``windows``, how many they are, their text, their place in it,
    their anchor, the stretch they were cut from, a hash of the whole; and the hashes of all windows."""
    n, codes, vocabulary = words_of(texts)
    if len(codes) < WINDOW:
        return None
    hashes = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in vocabulary], np.uint64)[codes]
    owner = np.repeat(np.arange(len(n)), n)
    windows = _rolled(hashes, WINDOW)
    count = len(windows)
    low = _rolled(hashes, ANCHOR)
    anchors = low[:count].copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(anchors, low[j : j + count], out=anchors)
    at = np.flatnonzero(owner[:count] == owner[WINDOW - 1 :])
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (anchors[at[1:]] != anchors[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % STRETCH == 0
    stretch = np.cumsum(new)
    single = np.isin(anchors[at], hot)
    new |= single
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    index = np.arange(len(at)) - np.repeat(first, size)
    anchor = anchors[at[first]]
    whole = np.add.reduceat(windows[at] * (_MIX + np.uint64(2) * index.astype(np.uint64)), first) ^ anchor
    anchor = np.where(single[first], anchor ^ windows[at[first]] * _MIX, anchor)
    text = owner[at[first]]
    return at[first], size, text, at[first] - (np.cumsum(n) - n)[text], anchor, stretch[first], whole, windows


def _spread(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h * _ODD >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


#: What is packed of a stretch: ``key`` is its anchor, or the source's document where it is a copy within its slice;
#: ``source`` is the source's place then. A copy travels without hashes.
PACKED = np.dtype([("key", "<u8"), ("doc", "<i8"), ("check", "<i8"), ("start", "<u4"), ("source", "<u4"), ("size", "u1"), ("copy", "u1")])


def _pack(rows: np.ndarray, windows: np.ndarray) -> bytes:
    """Stretches and their hashes; fields are stored byte by byte, so that what is alike stands together."""
    fields = [np.ascontiguousarray(rows[name]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for name in PACKED.names]
    return len(rows).to_bytes(4, "little") + b"".join(fields) + np.ascontiguousarray(windows.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _unpack(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at = int.from_bytes(content[:4], "little"), 4
    rows = np.empty(n, PACKED)
    for name in PACKED.names:
        width = PACKED[name].itemsize
        rows[name] = np.ascontiguousarray(np.frombuffer(content, np.uint8, n * width, at).reshape(width, n).T).view(PACKED[name])[:, 0]
        at += n * width
    windows = np.zeros(((len(content) - at) // HASH_BYTES, 8), np.uint8)
    windows[:, :HASH_BYTES] = np.frombuffer(content, np.uint8, -1, at).reshape(-1, HASH_BYTES)
    return rows, windows.view("<u8")[:, 0]


def _packed(doc_ids: np.ndarray, checks: np.ndarray, texts: pa.Array, hot: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """Stretches of a slice, packed by buckets. Copied single windows that adjoin, and whose sources do, are joined."""
    found = _runs(texts, hot)
    if found is None:
        return None
    at, size, text, start, anchor, stretch, whole, windows = found
    docs = doc_ids[text]
    order = np.lexsort((start, docs, whole))
    lead = np.ones(len(order), bool)
    lead[1:] = whole[order[1:]] != whole[order[:-1]]
    source = np.empty(len(order), np.int64)
    source[order] = order[lead][np.cumsum(lead) - 1]
    copied = docs > docs[source]
    joined = copied[1:] & copied[:-1] & (stretch[1:] == stretch[:-1]) & (docs[source][1:] == docs[source][:-1]) & (np.diff(start[source]) == size[:-1])
    begin = np.flatnonzero(np.append(True, ~joined))
    rows = np.empty(len(begin), PACKED)
    rows["size"] = np.add.reduceat(size, begin)
    at, text, source, copied = at[begin], text[begin], source[begin], copied[begin]
    rows["doc"], rows["check"], rows["start"], rows["copy"] = docs[begin], checks[text], start[begin], copied
    rows["key"] = np.where(copied, docs[source].view(np.uint64), anchor[begin])
    rows["source"] = np.where(copied, start[source], 0)
    bucket = _spread(np.where(copied, (rows["doc"].view(np.uint64) ^ rows["start"].astype(np.uint64) << np.uint64(40)) * _MIX, rows["key"] * _MIX), buckets)
    order = np.argsort(bucket, kind="stable")
    rows, at, bucket = rows[order], at[order], bucket[order]
    known = np.where(rows["copy"], 0, rows["size"]).astype(np.int64)
    hashes = windows[ragged(at, known)]
    edges = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
    ends = np.append(edges[1:], len(rows))
    sums = np.concatenate([[0], np.cumsum(known)])
    content = [_pack(rows[a:b], hashes[sums[a] : sums[b]]) for a, b in zip(edges.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(content, pa.binary())], ["bucket", "stretches"])


def _cut(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = filled(batch.column("text"))
        ids, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "check"))
        for low, high in slices(texts):
            if (made := _packed(ids[low:high], checks[low:high], texts.slice(low, high - low), hot, buckets)) is not None:
                yield made


def _sampled(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """``(anchor, windows)`` of one in ``share`` stretches, those that repeat within a slice taken once."""
    for batch in batches:
        texts, ids = filled(batch.column("text")), batch.column("doc_id").to_numpy(zero_copy_only=False)
        for low, high in slices(texts):
            if (found := _runs(texts.slice(low, high - low), np.empty(0, np.uint64))) is not None:
                _, size, text, start, anchor, _, whole, _ = found
                once = np.unique(whole, return_index=True)[1]
                drawn = ((ids[low:high][text[once]].astype(np.uint64) * _ODD ^ start[once].astype(np.uint64)) * _MIX) >> np.uint64(40)
                chosen = once[drawn % np.uint64(share) == 0]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[chosen].view(np.int64)), pa.array(size[chosen])], ["anchor", "windows"])


def _measured(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Anchors whose blocks hold HOT_WINDOWS windows or more, by a sample; and the number of all windows, about."""
    share = SAMPLE
    drawn = written(rows.mapInArrow(lambda batches: _sampled(batches, share), "anchor long, windows long"), "anchor-sample")
    sums = drawn.groupBy("anchor").agg(F.sum("windows").alias("windows")).where(F.col("windows") * share >= HOT_WINDOWS)
    hot = np.sort(sums.select("anchor").toArrow().column(0).to_numpy().view(np.uint64))
    return hot, share * (drawn.agg(F.sum("windows")).first()[0] or 0)


def _parse(rows: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Factors of a bucket's stretches against the blocks of the bucket: ``doc_id, check, factor``."""
    order = np.lexsort((rows["start"], rows["doc"]))
    known = np.where(rows["copy"], 0, rows["size"]).astype(np.int64)
    begins = (np.cumsum(known) - known)[order]
    rows, known = rows[order], known[order]
    windows = windows[ragged(begins, known)]
    row = np.repeat(np.arange(len(rows)), known)
    index = np.arange(len(row)) - np.repeat(np.cumsum(known) - known, known)
    place = rows["start"][row].astype(np.int64) + index
    # The index of the blocks: equal windows stand together, the first place before the others.
    mixed = (rows["key"][row] ^ windows * _ODD) * _MIX
    order = np.argsort(mixed, kind="stable")
    key, sorted_windows = rows["key"][row[order]], windows[order]
    lead = np.ones(len(order), bool)
    lead[1:] = (key[1:] != key[:-1]) | (sorted_windows[1:] != sorted_windows[:-1])
    source = np.empty(len(order), np.int64)
    source[order] = order[lead][np.cumsum(lead) - 1]
    docs = rows["doc"][row]
    hit = np.flatnonzero(docs > docs[source])
    # A factor runs on while the next window's source is the next window of its source.
    origin, at = docs[source[hit]], place[source[hit]]
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]]) | (origin[1:] != origin[:-1]) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    copies = np.flatnonzero(rows["copy"])
    owner = np.concatenate([row[hit[begin]], copies])
    parts = (
        np.concatenate([place[hit[begin]], rows["start"][copies]]),
        np.concatenate([np.diff(np.append(begin, len(hit))), rows["size"][copies]]),
        np.concatenate([origin[begin], rows["key"][copies].view(np.int64)]),
        np.concatenate([at[begin], rows["source"][copies]]),
    )
    factor = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in parts], ["start", "windows", "source_id", "source_start"])
    return pa.RecordBatch.from_arrays([pa.array(rows["doc"][owner]), pa.array(rows["check"][owner].astype(np.int64)), factor], ["doc_id", "check", "factor"])


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of a task's bucket."""
    held = [_unpack(content.as_buffer().to_pybytes()) for batch in batches for content in batch.column("stretches")]
    if held:
        found = _parse(np.concatenate([rows for rows, _ in held]), np.concatenate([windows for _, windows in held]))
        for low in range(0, found.num_rows, 1 << 16):
            yield found.slice(low, 1 << 16)


def factors(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, check, factors)``: of each document with factors, their starts, lengths in windows, and sources (array
    of FACTOR; a factor of n windows is n + 12 words). ``check`` is a hash of the text, of 64 bits, and tells rows with one
    id apart."""
    rows = _keyed(df, doc_id, text).where("doc_id is not null").select("doc_id", "check", "text")
    hot, windows = _measured(rows)
    buckets = max(1, df.sparkSession.sparkContext.defaultParallelism, -(-windows // BUCKET_WINDOWS))
    cut = rows.mapInArrow(lambda batches: _cut(batches, hot, buckets), "bucket int, stretches binary")
    found = cut.repartitionById(buckets, "bucket").select("stretches").mapInArrow(_factor, f"doc_id long, check long, factor {FACTOR}")
    return found.groupBy("doc_id", "check").agg(F.collect_list("factor").alias("factors"))


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("check"), whole.alias("text"))


def joined(found: list[dict]) -> list[tuple[int, int, int, int]]:
    """Factors in order, those joined whose sources adjoin as they do: ``(start, words, source_id, source_start)``."""
    out: list[list[int]] = []
    for f in sorted(found, key=lambda f: f["start"]):
        start, words = f["start"], f["windows"] + WINDOW - 1
        last = out[-1] if out else None
        if last and start == last[0] + last[1] - WINDOW + 1 and (f["source_id"], f["source_start"] - start) == (last[2], last[3] - last[0]):
            last[1] = start + words - last[0]
        else:
            out.append([start, words, f["source_id"], f["source_start"]])
    return [tuple(f) for f in out]


def covered(n: int, found: list[dict] | None) -> np.ndarray:
    """Which of n words the factors cover."""
    out = np.zeros(n, bool)
    for start, words, _, _ in joined(found or []):
        out[start : start + words] = True
    return out


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` and, if asked for, ``kept`` (the kept words joined by spaces).

    A word is removed if a window of 13 words that covers it, of one document, also starts in a document with a
    smaller id. Null and empty texts have no words. Rows with one id never match each other: repeated rows get equal
    results. A null id neither loses words nor makes others lose them. An empty table stays empty.
    """

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sums, kept_text = [], [], [], []
            for whole, found in zip(batch.column("text"), batch.column("factors").to_pylist()):
                words = whole.as_py().encode().split()
                kept = words
                if found:
                    kept = [w for w, out in zip(words, covered(len(words), found).tolist()) if not out]
                joined = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                sums.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept_text.append(joined.decode())
            columns, names = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept_text, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = _keyed(df, doc_id, text).join(factors(df, doc_id, text), ["doc_id", "check"], "left").select("doc_id", "text", "factors")
    return joined.mapInArrow(put_together, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else ""))
