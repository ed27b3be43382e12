"""Personal data: generators propose spans, boosted trees weigh them, calibrated thresholds select.

The base patterns (email, ip, card, phone) are always redacted. Beside them, generators of high recall propose
overlapping spans: number groups and their parts, addresses with spelled-out signs, keyed values. Gradient-boosted trees
score a proposal by its format and its context. They are fitted on proposals from a bounded sample of documents that
the base patterns and secret-like keys label weakly, and on altered copies of these documents, in which the base spans are
spelled in ways that the base patterns miss (signs of an email written out or set apart, phones without their country). Each
kind's threshold is the lowest that keeps its precision on proposals, plain and altered, that the fit did not see.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm.batches import append_columns

KINDS = ("email", "ip", "card", "phone", "secret")
#: Documents that are fitted on, about, their longest texts in bytes, and the precision that thresholds keep on unseen
#: proposals.
FIT_DOCS, FIT_BYTES, PRECISION = 4000, 1 << 16, 0.99
#: Proposals of a fitted document at most, taken evenly.
FIT_PROPOSALS = 128
TREES, DEPTH = 15, 4
#: Bins of probability in which thresholds are counted.
BINS = 1024
#: Digits of a phone without its area, and of the longest card: parts of number groups between these are proposed.
LEAST_DIGITS, MOST_DIGITS = 7, 19

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AFTER_LOCAL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_NUMBERS = re.compile(r"[+(]?[0-9][0-9 ()./-]{5,}[0-9]")
_GROUP = re.compile(r"[0-9]+")
_SIGN = re.compile(r" ?(?:@|\[at\]|\(at\)) ?")
_HOST = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{2,})+")
_KEYED = re.compile(r"[A-Za-z_-]{2,24}[\"']? ?[=:] ?(?:(?:Bearer|Basic|Token) )?(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"']{6,}))")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[ .-]?(?=[(0-9])")
_SIX = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}")
_SHORT_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])")
_AT, _DOT = re.compile(r" ?(?:\[at\]|\(at\)) ?| @ "), re.compile(r" ?(?:\[dot\]|\(dot\)) ?| \. ")
_SECRET_KEY = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|key|authorization)$")
_CONTEXT = (
    re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell)\b"),
    re.compile(r"(?i)\b(?:mail|email|e-mail|contact|write)\b"),
    re.compile(r"(?i)\b(?:card|visa|credit|account|iban)\b"),
    re.compile(r"(?i)\b(?:ip|host|server|address|addr)\b"),
)
N_FEATURES = 25


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, sorted; a match that fails its test is dropped without retries."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _AFTER_LOCAL.match(text, at) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _kind_of(part: str) -> int:
    digits = sum(c.isdigit() for c in part)
    if part.count(".") == 3 and digits == len(part) - 3 or ":" in part:
        return 1
    return 2 if digits >= 12 and not part.startswith(("+", "(")) and "(" not in part else 3


def _spelled(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, end, host)`` of addresses whose signs may be spelled out or set apart. From a sign the name is read
    backwards, up to where the last address ended, so names of any length cost no second reading."""
    last = 0
    for sign in _SIGN.finditer(text):
        start = sign.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, sign.end()) if start < sign.start() else None
        last = max(last, host.end() if host else sign.end())
        if host:
            yield start, host.end(), host.start()


def proposals(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, end, kind, generator)``, overlapping ones among them."""
    out: dict[tuple[int, int, int], int] = {}
    if "@" in text or "[at]" in text or "(at)" in text:
        for start, end, host in _spelled(text):
            out.setdefault((start, end, 0), 0)
            stop = re.search(r"\w\. ", text[host:end])  # the address may end where the sentence does
            if stop:
                out.setdefault((start, host + stop.start() + 1, 0), 0)
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            out.setdefault((*m.span(), _kind_of(m[0])), 1)
            groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
            for i, (low, _) in enumerate(groups):
                low -= low > m.start() and text[low - 1] in "+("
                digits = 0
                for j, (first, high) in enumerate(groups[i:]):
                    digits += high - first
                    if digits > MOST_DIGITS:
                        break
                    part = text[low:high]
                    if part.count("(") > part.count(")") and text[high : high + 1] == ")":
                        high, part = high + 1, part + ")"
                    if digits >= LEAST_DIGITS or j == 3 and high - low >= LEAST_DIGITS and part.count(".") == 3 and len(part) == digits + 3:
                        out.setdefault((low, high, _kind_of(part)), 1)
        if ":" in text:
            for m in _SIX.finditer(text):
                out.setdefault((m.start(), m.end(), 1), 2)
            for m in _SHORT_SIX.finditer(text) if "::" in text else ():
                out.setdefault((m.start(), m.end(), 1), 2)
    if "=" in text or ":" in text:
        for m in _KEYED.finditer(text):
            out.setdefault((m.start(), m.end(), 4), 3)
            out.setdefault((*m.span(m.lastindex), 4), 4)
    return [(s, e, k, g) for (s, e, k), g in out.items()]


def _normal(text: str, start: int, end: int, kind: int, generator: int) -> bool:
    """Whether a proposal that the base patterns can't match is an address in another form: an email with its signs
    spelled out or set apart, or a whole IPv6 address with a digit."""
    part = text[start:end]
    if generator == 0:
        plain = _DOT.sub(".", _AT.sub("@", part))
        return plain != part and base_spans(plain) == [(0, 0, len(plain))]
    if generator == 2 and _DIGIT.search(part) and not any(c.isalnum() or c == ":" for c in text[max(0, start - 1) : start] + text[end : end + 1]):
        try:
            return ipaddress.ip_address(part).version == 6
        except ValueError:
            return False
    return False


def _key(part: str) -> str:
    """The key of a keyed value."""
    return part.partition("=")[0].partition(":")[0].strip(" \"'")


def features(text: str, start: int, end: int, kind: int, generator: int) -> list[float]:
    """Format and context of a proposal."""
    part = text[start:end]
    digits = "".join(c for c in part if "0" <= c <= "9")
    groups = re.findall("[0-9]+", part)
    counts = Counter(part)
    entropy = -sum(n / len(part) * math.log2(n / len(part)) for n in counts.values())
    before, after = text[max(0, start - 24) : start], text[end : end + 1]
    key = _key(part) if generator == 3 else before.rstrip(" =:\"'").rpartition(" ")[2]
    return [
        float(kind), float(generator), float(len(part)), float(len(digits)), float(sum(c.isalpha() for c in part)),
        float(len(groups)), float(max(map(len, groups), default=0)), float(part.count(".")), float(part.count("-")),
        float(part.count(" ")), float("(" in part), float(part[:1] == "+"), float("@" in part),
        float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)), float(luhn(digits)) if digits else 0.0,
        float(14 <= len(digits) <= 19), float(10 <= len(digits) <= 15), entropy,
        float(before[-1:].isalnum() or before[-1:] in tuple("+(.-/@")), float(after.isalnum() or after in tuple(")/@-")),
        float(bool(_SECRET_KEY.search(key))), float(next((i + 1 for i, c in enumerate(_CONTEXT) if c.search(before)), 0)),
        float(sum(c.isupper() for c in part)), float(part[-4:].count(".") > 0),
        float(_normal(text, start, end, kind, generator)),
    ]


@dataclass
class Model:
    """Trees as arrays: feature (-1: leaf), threshold, left, right, value; and each kind's least probability."""

    trees: list[tuple[np.ndarray, ...]]
    weights: list[float]
    thresholds: dict[int, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = np.maximum(feature[at], 0)
                down = np.where(x[np.arange(len(x)), f] <= threshold[at], left[at], right[at])
                at = np.where(feature[at] < 0, at, down)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _label(base: list[tuple[int, int, int]], text: str, proposal: tuple[int, int, int, int]) -> float:
    """Whether a proposal is one of the spans, an address in another form, or a value of a secret-like key with a digit."""
    start, end, kind, generator = proposal
    if kind == 4:
        return float(generator == 3 and bool(_SECRET_KEY.search(_key(text[start:end]))) and bool(_DIGIT.search(text, start, end)))
    if (start, kind, end) in base:
        return 1.0
    return float(generator in (0, 2) and _normal(text, *proposal) and all(end <= s or start >= e for s, _, e in base))


def altered(text: str, base: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """A text whose base emails and phones are spelled otherwise, and where the base spans stand then. Spans that overlap
    an earlier one stay as they are and aren't listed."""
    out, spans, at, size = [], [], 0, 0
    for start, kind, end in base:
        if start < at:
            continue
        part = text[start:end]
        if kind == 0:
            at_sign, dot = ((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."))[len(part) % 3]
            name, _, host = part.partition("@")
            part = f"{name}{at_sign}{host.replace('.', dot)}"
        elif kind == 3:
            bare = _COUNTRY.sub("", part, count=1)
            part = bare if sum(c.isdigit() for c in bare) >= LEAST_DIGITS else part
        out += [text[at:start], part]
        size += start - at
        spans.append((size, kind, size + len(part)))
        size, at = size + len(part), end
    return "".join([*out, text[at:]]), spans


def _forms(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """A text with its spans, and altered if it has emails or phones."""
    base = base_spans(text)
    yield text, base
    if any(kind in (0, 3) for _, kind, _ in base):
        yield altered(text, base)


def _labelled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[float, tuple[int, int, int, int]]]:
    """Proposals with their labels, but for those that overlap a base span without being it, which are never chosen."""
    base = base_spans(text)
    found = [p for p in proposals(text) if (p[0], p[2], p[1]) in base or all(p[1] <= s or p[0] >= e for s, _, e in base)]
    return [(_label(spans, text, p), p) for p in found]


def _weak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for whole in batch.column(0).to_pylist():
            for text, spans in _forms(whole):
                found = _labelled(text, spans)
                rows += [(label, features(text, *p)) for label, p in found[:: 1 + len(found) // FIT_PROPOSALS]]
        columns = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.list_(pa.float64())))], ["label", "x"])


def _arrays(tree) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value = [], [], [], [], []
    todo = [(tree._java_obj.rootNode(), -1, left)]
    while todo:
        node, parent, side = todo.pop()
        here = len(feature)
        if parent >= 0:
            side[parent] = here
        inner = node.getClass().getSimpleName() == "InternalNode"
        feature.append(node.split().featureIndex() if inner else -1)
        threshold.append(node.split().threshold() if inner else 0.0)
        value.append(node.prediction())
        left.append(0)
        right.append(0)
        if inner:
            todo += [(node.leftChild(), here, left), (node.rightChild(), here, right)]
    return tuple(np.array(a, t) for a, t in ((feature, np.int64), (threshold, float), (left, np.int64), (right, np.int64), (value, float)))


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = FIT_DOCS) -> Model | None:
    """A model from proposals in about ``most`` documents of at most FIT_BYTES, chosen by a hash of their ids among those
    with a digit, an at sign (spelled out, too) or an equals sign; None where the proposals are all of one label. The
    thresholds are taken over all documents that the trees didn't see."""
    spark = df.sparkSession
    signs = df.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).where((F.octet_length("text") <= FIT_BYTES) & F.col("text").rlike(r"[0-9@=]|[\[(]at[\])]"))
    share = most / max(most, df.count())
    sampled = F.expr("pmod(xxhash64(coalesce(id, ''), 3), 1000000)") < share * 1_000_000
    fold = F.expr("cast(pmod(xxhash64(coalesce(id, ''), 5), 5) as int)")
    found = signs.where(sampled & (fold != 0)).select("text").mapInArrow(_weak, "label double, x array<double>").toArrow()  # 200 bytes a proposal
    if len(set(found.column("label").to_pylist())) < 2:
        return None
    frame = spark.createDataFrame(found).select("label", array_to_vector("x").alias("x")).repartition(4, "x")
    trees = GBTClassifier(featuresCol="x", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(frame)
    model = Model([_arrays(t) for t in trees.trees], list(trees.treeWeights), {})
    unseen = df.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(~(sampled & (fold != 0) & (F.octet_length("text") <= FIT_BYTES)))
    counted = unseen.select("text").mapInArrow(lambda batches: _counted(batches, model), "kind int, bin int, n long, positive long")
    counts = np.zeros((len(KINDS), BINS, 2))
    for row in counted.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).collect():
        counts[row["kind"], row["bin"]] = row["n"], row["positive"]
    model.thresholds = {kind: _threshold(counts[kind]) for kind in range(len(KINDS))}
    return model


def _counted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Proposals and positive ones by kind and bin of their probability."""
    for batch in batches:
        counts = np.zeros((len(KINDS), BINS, 2), np.int64)
        rows: list[tuple[int, float, list[float]]] = []

        def count() -> None:
            if rows:
                kinds, labels, x = (np.array(c) for c in zip(*rows))
                bins = np.minimum((model.probability(x) * BINS).astype(np.int64), BINS - 1)
                np.add.at(counts, (kinds, bins, 0), 1)
                np.add.at(counts, (kinds, bins, 1), labels.astype(np.int64))
                rows.clear()

        for whole in batch.column(0).to_pylist():
            for text, spans in _forms(whole):
                for label, p in _labelled(text, spans):
                    rows.append((p[2], label, features(text, *p)))
                    if len(rows) == 8192:
                        count()
        count()
        kind, bin_ = np.nonzero(counts[:, :, 0])
        columns = [pa.array(kind, pa.int32()), pa.array(bin_, pa.int32()), pa.array(counts[kind, bin_, 0]), pa.array(counts[kind, bin_, 1])]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "bin", "n", "positive"])


def _threshold(counts: np.ndarray) -> float:
    """The lowest bin of (proposals, positive ones) by probability from which precision stays; 0.95 where no document has
    a positive of the kind."""
    n, right = counts[::-1].cumsum(axis=0).T
    good = np.flatnonzero((right >= PRECISION * n) & (right > 0))
    return max(0.5, 1 - (good[-1] + 1) / BINS) if len(good) else 0.95


def find_spans(texts: list[str], model: Model | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text, sorted ``(start, kind, end)``. Selected proposals that overlap a base
    span, or a likelier proposal, are left out."""
    base = [base_spans(t) for t in texts]
    offered = [(i, p) for i, t in enumerate(texts) for p in proposals(t)] if model else []
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if offered:
        p = model.probability(np.array([features(texts[i], *q) for i, q in offered]))
        taken = [bytearray(len(t)) for t in texts]
        for i, spans in enumerate(base):
            for s, _, e in spans:
                taken[i][s:e] = b"\1" * (e - s)
        for j in sorted(range(len(offered)), key=lambda j: (offered[j][0], -p[j], offered[j][1][0] - offered[j][1][1], offered[j][1])):
            i, (start, end, kind, _) = offered[j]
            if p[j] >= model.thresholds[kind] and taken[i].find(1, start, end) < 0:
                added[i].append((start, kind, end))
                taken[i][start:end] = b"\1" * (end - start)
    return [(b, sorted(b + a)) for b, a in zip(base, added)]


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones joined, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


COUNTS = ("n_email", "n_ip", "n_card", "n_phone")


def detect(df: DataFrame, model: Model | None, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add base counts (longs), ``base_sha256`` and ``spans`` to every row.

    Places are code points, ends exclusive. A null text is empty. Rows aren't compared: repeated rows get equal
    results; an empty table stays empty. Columns of the table with these names are replaced.
    """

    def compute(texts: pa.Array) -> list:
        found = find_spans(texts.to_pylist(), model)
        counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
        digests = [hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in found]
        return [*counts, digests, [spell(every) for _, every in found]]

    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    return append_columns(df, text, fields, compute, drop)


def redacted(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows, with their own columns, their texts redacted. A null text becomes empty."""

    def compute(texts: pa.Array) -> list:
        whole = texts.to_pylist()
        return [[redact(t, every) for t, (_, every) in zip(whole, find_spans(whole, model))]]

    return append_columns(df, text, [T.StructField(text, T.StringType())], compute).select(*df.columns)
