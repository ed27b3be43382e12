"""Language-model scores by a log-bilinear model, trained with noise-contrastive estimation.

Tokens are counted over the whole training part. The most frequent ones are classes of their own; the others share
classes by how they end. The probability of a token is that of its class after the classes before it, by the log-bilinear model,
times that of the token within its class, by the counts (each one more, and one for all unseen tokens of the class), so
the probabilities of all tokens sum to one.

The model begins as the class frequencies and is trained in rounds, each over its own share of the training documents, so
every one is used once: each task takes steps over its documents, and the tasks' parameters are averaged, weighted by
tokens. What is trained is of one size for any corpus; the counts grow with the corpus and never leave the executors: of
them, a bounded table of frequent tokens is broadcast, and other tokens of a document meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.batches import filled, slices
from presswork.shared import written

#: The end of a text as a token; no word holds a line end.
END = "\n"
#: Tokens that are classes of their own, classes of the others, and token lengths in bytes up to which one may be frequent.
FREQUENT, SHARED, LONGEST = 383, 128, 64
#: Tokens whose counts are broadcast (some 80 bytes each at most).
BROADCAST_TOKENS = 1 << 18
#: Classes before a token that the model looks at, and its dimension.
CONTEXT, DIMENSION = 4, 16
#: Rounds of training, tokens of a step, noise samples of a step, and the rate.
ROUNDS, STEP, NOISE, RATE = 3, 1024, 64, 0.15
#: Parts of the parameters that are averaged apart, tokens scored at a time, and bytes of text worked on at a time.
PARTS, SCORED, SLICE = 16, 512, 8 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts without nulls: the tokens of each (words of the lower-cased text, and the end), all their codes, and the
    distinct tokens."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(texts)), size)
    solid = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not solid.all():
        flat, owner = flat.filter(pa.array(solid)), owner[solid]
    coded = flat.dictionary_encode()
    n = np.bincount(owner, minlength=len(texts)).astype(np.int64) + 1
    codes = np.empty(int(n.sum()), np.int32)
    ends = np.cumsum(n) - 1
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[inner] = coded.indices.to_numpy(zero_copy_only=False)
    codes[ends] = len(coded.dictionary)
    return n, codes, pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])])


def endings(words: pa.Array) -> np.ndarray:
    """The class, by their last two bytes, of tokens that aren't frequent (from 0)."""
    raw = words.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"\0", np.uint8)
    ends = offsets[1:]
    long = np.diff(offsets) > 1
    last, before = data[np.maximum(ends - 1, 0)].astype(np.int64), np.where(long, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return (last * 131 + before * 31) % SHARED


@dataclass
class Vocabulary:
    """Frequent tokens with their counts, the most frequent first; tokens and distinct tokens of the training part, in all
    and by shared class; and how many tokens each class has, of all classes."""

    tokens: pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    shared_total: np.ndarray
    shared_distinct: np.ndarray
    own: int = field(init=False)

    def __post_init__(self) -> None:
        self.own = min(FREQUENT, len(self.tokens))

    @property
    def class_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.own], self.shared_total]) + 1.0

    def classes(self, words: pa.Array, places: np.ndarray) -> np.ndarray:
        """Classes of distinct tokens that have these places among the frequent ones (-1: none)."""
        return np.where((places >= 0) & (places < self.own), places, self.own + endings(words)).astype(np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.tokens), -1).to_numpy(zero_copy_only=False)


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(token, n)`` of all tokens of a table's texts, counted by slices before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(0))
            for low, high in slices(texts, SLICE):
                _, codes, words = tokens_of(texts.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], ["token", "n"])
            pa.default_memory_pool().release_unused()

    return df.select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _summed(batches: Iterator[pa.RecordBatch], frequent: pa.Array) -> Iterator[pa.RecordBatch]:
    total, distinct = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for batch in batches:
        words, n = batch.column(0), batch.column(1).to_numpy()
        shared = np.flatnonzero(pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy(zero_copy_only=False) < 0)
        at = endings(words)[shared]
        total += np.bincount(at, n[shared], SHARED).astype(np.int64)
        distinct += np.bincount(at, minlength=SHARED)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED, dtype=np.int32)), pa.array(total), pa.array(distinct)], ["class", "total", "distinct"])


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a written table of counts. Of the frequent tokens as many whole steps of frequency (64 to a doubling)
    come to the driver as BROADCAST_TOKENS hold."""
    short = counts.where(F.octet_length("token") <= LONGEST).withColumn("step", F.expr("cast(floor(64 * log2(n)) as int)"))
    least, held = 1 << 30, 0
    for step, n in short.groupBy("step").count().orderBy(F.desc("step")).collect():  # 4096 steps at most
        held += n
        if held > BROADCAST_TOKENS:
            break
        least = step
    top = short.where(F.col("step") >= least).select("token", "n").toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    tokens = top.column("token").combine_chunks().cast(pa.string()) if len(top) else pa.array([], pa.string())
    frequent = tokens.slice(0, FREQUENT)
    made = counts.mapInArrow(lambda batches: _summed(batches, frequent), "class int, total long, distinct long")
    shared = {r["class"]: r for r in made.groupBy("class").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).collect()}
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    sums = [np.array([shared[c][name] if c in shared else 0 for c in range(SHARED)], np.int64) for name in ("total", "distinct")]
    return Vocabulary(tokens, top.column("n").to_numpy() if len(top) else np.zeros(0, np.int64), whole["total"], whole["distinct"], *sums)


class Bilinear:
    """A prediction is the sum of the representations of the classes before, each scaled by its place; a class's score is its
    product with the prediction, and a bias. ``flat`` holds all parameters, then the sums of their squared gradients."""

    def __init__(self, classes: int, flat: np.ndarray | None = None):
        d = DIMENSION
        shapes = {"read": (classes + 1, d), "scale": (CONTEXT, d), "made": (classes, d), "bias": (classes,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(2 * size, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for half in ("", "_seen"):
            for name, shape in shapes.items():
                n = int(np.prod(shape))
                setattr(self, name + half, self.flat[at : at + n].reshape(shape))
                at += n
        self.classes = classes

    @classmethod
    def begun(cls, class_counts: np.ndarray) -> Bilinear:
        """The class frequencies, and small representations."""
        model, random = cls(len(class_counts)), np.random.default_rng(5)
        model.bias[:] = np.log(class_counts / class_counts.sum())
        model.read[:-1] = random.normal(0, 0.1, model.read[:-1].shape)
        model.made[:] = random.normal(0, 0.1, model.made.shape)
        model.scale[:] = 1.0 / CONTEXT
        model.flat[len(model.flat) // 2 :] = 0.01
        return model

    def contexts(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The classes before each token within its text; the place before a text's begin is the class after the last. Each
        column lies in one piece."""
        out, begins = np.full((CONTEXT, len(classes)), self.classes, np.int32), np.cumsum(n) - n
        for i in range(CONTEXT):
            out[i, i + 1 :] = classes[: max(0, len(classes) - i - 1)]
            for j in range(i + 1):
                out[i, begins[n > j] + j] = self.classes
        return out.T

    def log_probabilities(self, classes: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of classes after those before them, normalised over all classes."""
        out, made = np.empty(len(classes)), np.vstack([self.made.T, self.bias[None]])
        # The bias is met by a further column, one in what is scaled for the first place and nothing elsewhere.
        scaled = [np.hstack([self.read * self.scale[i], np.full((len(self.read), 1), float(i == 0), np.float32)]) for i in range(CONTEXT)]
        held, each, rows = np.empty((SCORED, self.classes), np.float32), np.ones(self.classes, np.float32), np.arange(SCORED)
        for low in range(0, len(classes), SCORED):
            part = context[low : low + SCORED]
            h = scaled[0].take(part[:, 0], axis=0)
            for i in range(1, CONTEXT):
                h += scaled[i].take(part[:, i], axis=0)
            scores = np.matmul(h, made, out=held[: len(h)])
            own = scores[rows[: len(h)], classes[low : low + SCORED]].astype(float)
            with np.errstate(over="ignore"):
                sums = np.exp(scores, out=scores) @ each
            if not (sums.min() > 1e-30 and sums.max() < 1e30):  # powers over- or underflow
                scores = np.matmul(h, made, out=held[: len(h)])
                top = scores.max(axis=1, keepdims=True)
                scores -= top
                out[low : low + SCORED] = own - top[:, 0] - np.log(np.exp(scores, out=scores) @ each)
                continue
            out[low : low + SCORED] = own - np.log(sums)
        return out

    def _update(self, name: str, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
        values, seen = getattr(self, name), getattr(self, f"{name}_seen")
        seen[rows] += gradient * gradient
        values[rows] += RATE * gradient / np.sqrt(seen[rows])

    def _scattered(self, rows: np.ndarray, **gradients: np.ndarray) -> None:
        """Add up gradients of equal rows first."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # few classes, so they are sorted by digits
        ordered = rows[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        for name, gradient in gradients.items():
            self._update(name, ordered[first], np.add.reduceat(gradient.take(order, axis=0), first, axis=0))

    def step(self, classes: np.ndarray, context: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """One step of noise-contrastive estimation: tell each class from ``noise``, drawn by the class frequencies, of which
        all tokens of the step share the samples. ``log_noise``: logarithms of the noise's expected number of each class."""
        read = [self.read.take(context[:, i], axis=0) for i in range(CONTEXT)]
        h = read[0] * self.scale[0]
        for i in range(1, CONTEXT):
            h += read[i] * self.scale[i]
        rate = 1.0 / len(classes)
        made, others = self.made.take(classes, axis=0), self.made.take(noise, axis=0)
        own = np.einsum("ij,ij->i", h, made) + self.bias[classes] - log_noise[classes]
        up = ((1.0 / (1.0 + np.exp(np.clip(own, -30, 30)))) * rate).astype(np.float32)
        down = h @ others.T
        down += self.bias[noise] - log_noise[noise]
        np.clip(np.negative(down, out=down), -30, 30, out=down)
        np.exp(down, out=down)
        down += 1.0
        np.divide(-1.0, down, out=down)
        down *= rate
        back = up[:, None] * made + down @ others
        self._scattered(np.concatenate([classes, noise]), made=np.concatenate([up[:, None] * h, down.T @ h]), bias=np.concatenate([up, down.sum(axis=0)]))
        self._scattered(context.T.ravel(), read=np.concatenate([back * self.scale[i] for i in range(CONTEXT)]))
        self._update("scale", slice(None), np.stack([np.einsum("ij,ij->j", back, r) for r in read]))


def _trained(rows: DataFrame, vocabulary: Vocabulary, model: Bilinear) -> Bilinear:
    """The average of what tasks make of a model over their rows, weighted by tokens; it is taken by parts on the executors."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary.tokens.slice(0, vocabulary.own), vocabulary.class_counts, model.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, class_counts, flat = shared.value
        known = Vocabulary(own, np.zeros(len(own), np.int64), 0, 0, np.zeros(SHARED), np.zeros(SHARED))
        mine, seen = Bilinear(len(class_counts), flat.copy()), 0
        share = class_counts / class_counts.sum()
        log_noise, task = np.log(NOISE * share).astype(np.float32), TaskContext.get().partitionId()
        random, edges = np.random.default_rng(17), np.cumsum(share)
        for batch in batches:
            texts = filled(batch.column(0))
            for low, high in slices(texts, SLICE):
                n, codes, words = tokens_of(texts.slice(low, high - low))
                classes = known.classes(words, known.places(words))[codes]
                order = random.permutation(len(classes))
                context, dealt = mine.contexts(classes, n).T.take(order, axis=1).T, classes[order]
                for begin in range(0, len(order), STEP):
                    noise = np.minimum(np.searchsorted(edges, random.random(NOISE)), len(share) - 1).astype(np.int32)
                    mine.step(dealt[begin : begin + STEP], context[begin : begin + STEP], noise, log_noise)
                seen += len(classes)
        if seen:
            parts = np.array_split(mine.flat.astype(float) * seen, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "task", "tokens", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, tokens, sums in zip(batch.column("part").to_pylist(), batch.column("tokens").to_pylist(), batch.column("sums")):
                values = np.frombuffer(sums.as_buffer(), float)
                if part in held:
                    held[part][0] += tokens
                    held[part][1] += values
                else:
                    held[part] = [tokens, values.copy()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([(v / t).tobytes() for t, v in held.values()], pa.binary())], ["part", "means"])

    made = rows.mapInArrow(run, "part int, task int, tokens long, sums binary").repartition("part").sortWithinPartitions("part", "task").select("part", "tokens", "sums")
    means = dict(made.mapInArrow(added, "part int, means binary").collect())  # one model
    if len(means) < PARTS:
        return model
    return Bilinear(model.classes, np.concatenate([np.frombuffer(means[p], float) for p in range(PARTS)]))


def spread(df: DataFrame) -> DataFrame:
    """The rows on as many partitions as there are cores, where the files have fewer splits; they are read several times, so they
    are written once then."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return written(df.repartition(cores), "texts") if df.rdd.getNumPartitions() < cores else df


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Vocabulary, Bilinear, DataFrame]:
    """The vocabulary, the model and all counts ``(token, n)`` from a table's rows that aren't held out. No such rows, or only
    empty texts, give a model all the same."""
    rows = df.where(~held_out(F.col(doc_id))).select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    counts = written(token_counts(rows), "token-counts")
    known = vocabulary(counts)
    model = Bilinear.begun(known.class_counts)
    for r in range(ROUNDS):
        model = _trained(rows.where(F.expr(f"pmod(xxhash64(coalesce(id, ''), 29), {ROUNDS}) = {r}")).select("text"), known, model)
    return known, model, counts


def score(df: DataFrame, fitted: tuple[Vocabulary, Bilinear, DataFrame], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row, by base 10.

    ``base_score`` is that of the counts alone, each one more. Null texts are empty: their end is one token. Repeated rows
    get equal scores, a null id is kept (and learnt from), other columns aren't read, an empty table stays empty.
    """
    known, model, counts = fitted
    shared = df.sparkSession.sparkContext.broadcast((known, model.flat))
    classes = model.classes
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, base double, part double, words array<string>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        model = Bilinear(classes, flat)
        logs = np.log10(known.counts + 1.0)
        room = np.log10(known.shared_total + known.shared_distinct + 1.0)
        for batch in batches:
            texts = filled(batch.column(1))
            for low, high in slices(texts, SLICE):
                n, codes, words = tokens_of(texts.slice(low, high - low))
                owner = np.repeat(np.arange(len(n)), n)
                places = known.places(words)
                kinds = known.classes(words, places)
                counted = places >= 0
                gain = np.where(counted, logs[np.maximum(places, 0)] if len(logs) else 0.0, 0.0)
                within = np.where(kinds >= known.own, gain - room[np.maximum(kinds - known.own, 0)], 0.0)
                in_text = kinds[codes]
                context = model.contexts(in_text, n)
                chances = model.log_probabilities(in_text, context) / np.log(10)
                base = np.bincount(owner, gain[codes], len(n))
                part = np.bincount(owner, chances + within[codes], len(n))
                found = np.bincount(owner, counted[codes], len(n)).astype(np.int64)
                rest = np.flatnonzero(~counted[codes])
                pair, times = np.unique(owner[rest].astype(np.int64) * len(words) + codes[rest], return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(len(n) + 1, dtype=np.int64) * len(words)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, values) for values in (words.take(pa.array(pair % len(words))), pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n), pa.array(found), pa.array(base), pa.array(part), *lists], ["doc_id", "n_tokens", "n_known", "base", "part", "words", "times"])
            pa.default_memory_pool().release_unused()

    made = written(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "token-scores")
    rare = made.where("size(words) > 0").select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("token"), F.col("t.times").alias("times"))
    met = rare.join(counts, "token").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("n_more"))
    whole = made.drop("words", "times").join(met, "row", "left").na.fill(0, ["more", "n_more"])
    room = float(np.log10(known.total + known.distinct + 1.0))
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("n_more")).cast("long").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(room)).alias("base_score"), (F.col("part") + F.col("more")).alias("score"),
    )
