"""Similarity of titles: an exact join by prefixes of rare letters, then bounds by bits, then matching blocks."""

from __future__ import annotations

import difflib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from presswork.shared import written

LOOKBACK_DAYS, SIMILAR = 7, 0.8
DAY = 86_400


@lru_cache(1 << 16)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-block ratio of two texts; a worker keeps the latest ratios, since headlines repeat."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Bits kept of a title: of each letter how often it stands there, up to REPEATS times, and which pairs of letters do.
REPEATS, LETTER_WORDS, PAIR_WORDS = 5, 3, 8
_SIGNS = [f"letters{i}" for i in range(LETTER_WORDS)] + [f"pairs{i}" for i in range(PAIR_WORDS)]


def _set_bits(at: set[int], words: int) -> list[int]:
    whole = sum(1 << i for i in at)
    return [int(x) for x in np.frombuffer(whole.to_bytes(8 * words, "little"), "<i8")]


@pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in _SIGNS]))
def signs(titles: pd.Series) -> pd.DataFrame:
    """Bits of what a title holds. What shares a bit with another counts as one, so a difference of bits is a difference of titles."""
    rows = []
    for title in titles:
        counts = Counter(title)
        letters = {i * REPEATS + k for i, c in enumerate(_LETTERS) for k in range(min(counts[c], REPEATS))}
        pairs = {zlib.crc32(title[i : i + 2].encode()) % (64 * PAIR_WORDS) for i in range(len(title) - 1)}
        rows.append(_set_bits(letters, LETTER_WORDS) + _set_bits(pairs, PAIR_WORDS))
    return pd.DataFrame(rows, columns=_SIGNS)


def _missing(own: str, other: str, kind: str, words: int) -> str:
    """SQL: how many bits of one side the other lacks."""
    return " + ".join(f"bit_count({own}{kind}{i} & ~{other}{kind}{i})" for i in range(words))


def common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of titles, pair by pair.

    Each row of ``a`` is kept in bits, of which one word after the other is advanced for all pairs at once, with
    carries; letters are told apart by their last byte, so a length can only come out too large.
    """
    x, y = (np.ascontiguousarray(s).view(np.uint32).reshape(len(s), -1) for s in (a, b))
    held, read = x > 0, y > 0
    x, y = x.astype(np.uint8), y.astype(np.uint8)
    words = -(-x.shape[1] // 64)
    x, held = (np.pad(m, ((0, 0), (0, words * 64 - m.shape[1]))) for m in (x, held))
    state = np.full((len(x), words), ~np.uint64(0))
    for j in range(y.shape[1]):
        equal = (x == y[:, j : j + 1]) & held & read[:, j : j + 1]
        at = np.packbits(equal, axis=1, bitorder="little").view("<u8")
        carry = np.zeros(len(x), np.uint64)
        for w in range(words):
            old, hit = state[:, w].copy(), state[:, w] & at[:, w]
            total = old + hit
            over = total < old
            total += carry
            over |= total < carry
            state[:, w] = total | (old & ~at[:, w])
            carry = over.astype(np.uint64)
    return (np.unpackbits((~state).view(np.uint8), axis=1, bitorder="little").astype(bool) & held).sum(1)


#: Pairs of which common subsequences are found at once.
PAIRS_AT_ONCE = 4096


def _ratios(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs of titles, those whose ratio is ``least`` or more. No ratio exceeds the one that the longest common
    subsequence would give, so only pairs that pass by it are matched block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = difflib.SequenceMatcher(None)
        for whole in batches:
            for start in range(0, len(whole), PAIRS_AT_ONCE):
                batch = whole.slice(start, PAIRS_AT_ONCE)
                new, old = (np.asarray(c.to_pylist(), np.str_) for c in batch.columns)
                bound = 2 * common_letters(new, old) >= least * (np.char.str_len(new) + np.char.str_len(old)) - 1e-9
                chosen, ratios, last = [], [], None
                for i in np.flatnonzero(bound).tolist():
                    if old[i] != last:
                        last = old[i]
                        matcher.set_seq2(str(last))
                    matcher.set_seq1(str(new[i]))
                    ratio = matcher.ratio()
                    if ratio >= least:
                        chosen.append(i)
                        ratios.append(ratio)
                kept = batch.take(pa.array(chosen, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ratios, pa.float64())], ["title", "earlier_title", "ratio"])

    return run


#: Repetitions of a letter that are ranked by how many titles hold them; further ones count as common.
RANKED = 64
#: Titles of a list of the index that one row meets in one task.
LIST_PART = 1024


def _letters(titles: pd.Series) -> Iterator[list[str]]:
    """The letters of a title, each with its number of earlier ones: no two are equal."""
    for title in titles:
        seen: Counter = Counter()
        made = []
        for c in title:
            made.append(f"{c}{seen[c]}")
            seen[c] += 1
        yield made


def rarity(titles: DataFrame) -> dict[str, int]:
    """Of every numbered letter (RANKED repetitions of each at most), how many titles hold it. The alphabet bounds it."""

    @pandas_udf("array<string>")
    def numbered(column: pd.Series) -> pd.Series:
        return pd.Series([[x for x in made if int(x[1:]) < RANKED] for made in _letters(column)])

    held = titles.select(F.explode(numbered("title")).alias("letter")).groupBy("letter").count()
    return dict(held.orderBy(F.desc("count"), "letter").limit(1 << 20).collect())


def with_prefix(titles: DataFrame, least: float, ranks: dict[str, int]) -> DataFrame:
    """Add ``prefix``: of a title's numbered letters, the rarest first, so many that two titles whose ratio is ``least`` share one.

    Two titles of n and o letters with that ratio have at least least / 2 * (n + o) numbered letters in common, and the other
    isn't shorter than least / (2 - least) times this one, so all but that many, and one, are enough."""
    shared = titles.sparkSession.sparkContext.broadcast(ranks)
    share = least / (2 - least)

    @pandas_udf("array<struct<letter: long, place: int>>")
    def rarest(column: pd.Series) -> pd.Series:
        known, out = shared.value, []
        for made in _letters(column):
            n = len(made)
            most = n - math.ceil(least / 2 * (n + math.ceil(share * n - 1e-9)) - 1e-9) + 1
            ordered = sorted(made, key=lambda x: (known.get(x, 1 << 60), x))[: max(most, 1)]
            out.append([{"letter": zlib.crc32(x.encode()), "place": i} for i, x in enumerate(ordered)])
        return pd.Series(out)

    return titles.withColumn("prefix", rarest("title"))


def title_index(titles: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``(id, title, n, prefix)`` and bits of the distinct titles of ``titles(title)``, kept: what candidate_titles looks them up by."""
    named = written(titles.select("title").where("title <> ''").distinct().withColumn("id", F.monotonically_increasing_id()), "titles")
    known = named.withColumn("s", signs("title")).select("id", "title", F.length("title").alias("n"), "s.*")
    return written(with_prefix(known, least, rarity(named)), "title-index")


def candidate_titles(df: DataFrame, least: float = SIMILAR, asked: DataFrame | None = None, index: DataFrame | None = None, after: bool = False) -> DataFrame:
    """``(title, earlier_title)``, distinct and unequal: a superset of the similar ones of ``df(title, stretch)`` that occur
    in one stretch, or the earlier in the stretch before. Where ``asked`` (title, stretch), part of ``df``, is given, only its
    titles are looked for; ``after``: in the next stretch too. ``index``: title_index of titles that ``df``'s are among. Where ``df`` has
    ``component`` (and ``asked`` too), only titles of different ones meet.

    An inverted index from stretches and rare numbered letters gives the pairs: only titles whose prefixes share a letter
    meet, where its places in both leave room for the common letters that the ratio needs. Long lists of the index are dealt
    into parts. Of what meets, bits bound the letters one title lacks of the other, and the pairs of neighbouring letters,
    of which at most the unmatched letters and one more break.
    """
    rows = df.where("title <> ''").distinct()
    known = title_index(rows, least) if index is None else index
    titles = known.select("id", "title")
    parted = ["component"] if "component" in df.columns else []
    listed = rows.join(known.select("title", "id", "n", "prefix", *_SIGNS), "title").select("id", "n", "stretch", *parted, *_SIGNS, F.explode("prefix").alias("p")).select("id", "n", "stretch", *parted, *_SIGNS, "p.letter", "p.place")
    listed = written(listed, "title-lists")
    lists = listed.groupBy("stretch", "letter").agg(F.ceil(F.count("*") / LIST_PART).cast("int").alias("parts"))
    old = listed.join(lists, ["stretch", "letter"]).withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)")).drop("parts")
    old = old.withColumnsRenamed({c: f"old_{c}" for c in ("id", "n", "place", *parted, *_SIGNS)})
    new = listed
    if asked is not None:
        wanted = asked.where("title <> ''").distinct().join(titles, "title").select("id", "stretch", *parted)
        new = listed.join(wanted, ["id", "stretch", *parted], "left_semi")
    near = [F.col("stretch"), F.col("stretch") - 1, *([F.col("stretch") + 1] if after else [])]
    new = new.withColumn("stretch", F.explode(F.array(*near)))
    new = new.join(lists, ["stretch", "letter"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    dealt = ["stretch", "letter", "part"]
    partitions = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = new.repartition(partitions, *dealt).join(old.repartition(partitions, *dealt), dealt)
    need = f"ceil({least / 2!r}D * (n + old_n) - 1e-9D)"
    fits = [f"{c} <> old_{c}" for c in parted]
    fits += [f"id <> old_id and n - place >= {need} and old_n - old_place >= {need}"]
    both = f"{least}D * (n + old_n) - 1e-9D"
    fits += [f"2 * ({n} - ({_missing(own, other, 'letters', LETTER_WORDS)})) >= {both}" for n, own, other in (("n", "", "old_"), ("old_n", "old_", ""))]
    # m matched letters in k runs hold m - k pairs, and k is at most the unmatched n + old_n - 2m, and one.
    fewest = f"{1.5 * least - 1}D * (n + old_n) - 1 - 1e-9D"
    fits += [f"{n} - 1 - ({_missing(own, other, 'pairs', PAIR_WORDS)}) >= {fewest}" for n, own, other in (("n", "", "old_"), ("old_n", "old_", ""))]
    pairs = met.where(" and ".join(fits)).select("id", "old_id").distinct()
    named = pairs.join(titles, "id").drop("id").join(titles.selectExpr("id as old_id", "title as earlier_title"), "old_id")
    return named.select("title", "earlier_title")


def verified(pairs: DataFrame, least: float = SIMILAR, even: bool = True) -> DataFrame:
    """``(title, earlier_title, ratio)`` of the pairs whose ratio is ``least`` or more, exactly. The longest common subsequence
    bounds it first. ``even``: work grows with pairs and not with bytes, so partitions aren't coalesced; for few pairs they may be."""
    partitions = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.xxhash64("title", "earlier_title") % (4 * partitions)
    rows = pairs.select("title", "earlier_title")
    dealt = (rows.repartition(partitions, by) if even else rows.repartition(by)).sortWithinPartitions("earlier_title")
    return dealt.mapInArrow(_ratios(least), "title string, earlier_title string, ratio double")


def stretched(df: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """``(title, stretch)`` of articles: stretches have the window's length."""
    return df.select(F.col("plain_title").alias("title"), F.expr(f"floor(unix_timestamp(published_at) / {days * DAY})").alias("stretch"))


def similar_titles(df: DataFrame, least: float = SIMILAR, days: int = LOOKBACK_DAYS) -> DataFrame:
    """``(title, earlier_title, ratio)`` of distinct cleaned titles that are similar and occur within the window: candidates
    (see candidate_titles), verified."""
    return verified(candidate_titles(stretched(df, days), least), least)
