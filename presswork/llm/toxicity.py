"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic text and one on windows of ordinary text. Most of toxic
text is ordinary too, so the toxic dictionary is pruned to what sets it apart: of its words, the beginnings that follow
many more different words in toxic than in ordinary text. (Copies of one text add no new contexts, so they don't pass for
evidence.) The toxic side compresses with the ordinary dictionary and the pruned one behind it, the other side with the
ordinary one padded to the same length, so that all else costs the same. Every window of a text is compressed on both
sides; where the toxic side is shorter, it resembles toxic text. A logistic curve, fitted and then shifted to the best
threshold on labelled rows, turns a document's differences into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.batches import filled

#: Bytes of a window, cut after a word, of the dictionaries as they are trained, and of the toxic one when pruned.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, PRUNED_BYTES = 64, 8_000, 32_000, 4_000
#: Of each training: bytes of a segment, and of the pieces that segments are chosen by.
ORDINARY_COVER, TOXIC_COVER = (128, 6), (16, 6)
#: Labelled rows of each class that are fitted on (about; taken by a hash of their ids), and their longest texts.
FIT_ROWS, FIT_BYTES = 2000, 1 << 16
#: A difference in bytes that counts as a toxic window.
CLEAR = 3
#: How much more finding a toxic document counts than leaving a clean one alone.
BETA = 1.5
#: Word beginnings that set toxic text apart: their lengths, the least contexts (also as a share of the toxic texts),
#: and how many times more contexts a text than in ordinary ones.
STEMS, STEM_CONTEXTS, STEM_SHARE, STEM_RATIO = (4, 5, 6, 8, 10), 4, 0.02, 10.0


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def windows(text: str, shift: int = 0) -> list[bytes]:
    """Windows of a text; ``shift`` makes the first one shorter, so that others begin elsewhere."""
    raw, out, low, size = text.lower().encode(), [], 0, WINDOW - shift
    while low < len(raw):
        high = raw.find(b" ", low + size)
        high = min(len(raw) if high < 0 else high, low + 2 * WINDOW)
        out.append(raw[low:high])
        low, size = high, WINDOW
    return out


def _trained(samples: list[bytes], size: int, cover: tuple[int, int]) -> bytes:
    """The content of a dictionary trained on windows."""
    try:
        return zstandard.train_dictionary(size, samples, k=cover[0], d=cover[1]).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b" ".join(samples)[-size:]


def _contexts(texts: list[str], only: set[str]) -> dict[str, set[str]]:
    """The words that each of some word beginnings follows."""
    out: dict[str, set[str]] = {}
    for text in texts:
        words = text.lower().split()
        for before, word in zip(["", *words], words):
            for n in STEMS:
                if len(word) >= n and word[:n] in only:
                    out.setdefault(word[:n], set()).add(before)
    return out


def _pruned(dictionary: bytes, toxic: list[str], ordinary: list[str]) -> bytes:
    """Beginnings of a dictionary's words that set toxic text apart, the most frequent last, where references to them
    are shortest."""
    held = {word[:n] for word in dictionary.decode("utf-8", "ignore").split() for n in STEMS if len(word) >= n}
    least = max(STEM_CONTEXTS, STEM_SHARE * len(toxic))
    mine = {s: c for s, c in _contexts(toxic, held).items() if len(c) >= least}
    theirs = _contexts(ordinary, set(mine))
    marked = [s for s, c in mine.items() if len(c) / len(toxic) >= STEM_RATIO * (len(theirs.get(s, ())) + 0.5) / len(ordinary)]
    return "".join(f" {s}" for s in sorted(marked, key=lambda s: (len(mine[s]), s))).encode()[-PRUNED_BYTES:]


class Scorer:
    """Compresses windows; one for each task."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        settings = zstandard.ZstdCompressionParameters(
            window_log=15, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        )
        pair = []
        for content in (ordinary + bytes(len(toxic)), ordinary + toxic):
            data = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=settings)
            pair.append(zstandard.ZstdCompressor(dict_data=data, compression_params=settings).compress)
        self.ordinary, self.toxic = pair

    def features(self, text: str) -> list[float]:
        ordinary, toxic = self.ordinary, self.toxic
        found = [len(ordinary(w)) - len(toxic(w)) for w in windows(text) + windows(text, WINDOW // 2)]
        if not found:
            return [0.0] * 7
        top = sorted(found, reverse=True)[:3] + [0, 0]
        clear = [d for d in found if d >= CLEAR]
        against = -sum(d for d in found if d <= -CLEAR)
        return [float(top[0]), float(top[1]), float(top[2]), float(np.log1p(sum(clear))), -float(np.log1p(against)), len(clear) / len(found), float(np.log1p(len(found)))]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """A model from a bounded sample of labelled rows that aren't held out; None where a class has no rows.

    Rows with a null id, text or label are left out. The sample is at most about FIT_ROWS texts of each class.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).distinct()
    counts = dict(known.groupBy("__label").count().collect())
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("__label") == 1, F.lit(min(1.0, FIT_ROWS / counts[1]))).otherwise(F.lit(min(1.0, FIT_ROWS / counts[0])))
    chosen = known.where(F.expr("pmod(xxhash64(__id, 11), 1000000)") < share * 1_000_000)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    texts = texts.where(F.octet_length("__text") <= FIT_BYTES).join(F.broadcast(chosen), "__id")  # at most 2 * FIT_ROWS or so
    rows = sorted(texts.select("__id", "__text", "__label").collect())
    toxic, ordinary = [t for _, t, y in rows if y == 1], [t for _, t, y in rows if y == 0]
    if not toxic or not ordinary:
        return None
    plain = [w for t in ordinary for w in windows(t)]
    marked = _trained(sorted({w for t in toxic for w in windows(t)}), TOXIC_BYTES, TOXIC_COVER)
    model = Model(_pruned(marked, toxic, ordinary), _trained(plain[:: 1 + len(plain) // 8000], ORDINARY_BYTES, ORDINARY_COVER), ())
    scorer = Scorer(model.toxic, model.ordinary)
    x = np.array([scorer.features(t) for t in toxic + ordinary])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    # Of the rows that the sample stands for, as many are ordinary for each toxic one as among all labelled rows.
    model.weights = tuple(_calibrate(x, y, (counts[0] / len(ordinary)) / (counts[1] / len(toxic))))
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, ordinary: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, then the intercept moved so that 0.5 is the best threshold by
    the F measure of BETA, where a row of label 0 counts ``ordinary`` times."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weights, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (balance * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        weights += np.linalg.solve(hessian, x.T @ (balance * (y - p)) - ridge @ weights)
    margin = x @ weights
    edges = np.unique(margin)
    cuts = np.append((edges[1:] + edges[:-1]) / 2, edges[-1] + 1) if len(edges) > 1 else edges + 1
    right = np.array([(y[margin >= c] == 1).sum() for c in cuts])
    picked = right + ordinary * np.array([(y[margin >= c] == 0).sum() for c in cuts])
    f = (1 + BETA**2) * right / (picked + BETA**2 * y.sum())
    weights[0] -= float(np.median(cuts[f == f.max()]))
    return weights


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row, from its text alone; null and empty texts have no windows.

    Without a model every score is 0. Rows aren't compared, so repeated rows get equal scores; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.toxic, model.ordinary) if model else None
        for batch in batches:
            values = [0.0] * batch.num_rows
            if scorer:
                x = np.array([[1.0, *scorer.features(t.as_py())] for t in filled(batch.column(1))])
                values = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")
