"""The latest earlier article of a similar title, for each article, by shapes and in one order of time.

Titles that differ in their digits only have one shape (see shapes). A kind is a shape with its companies; kinds that may match are found
once for a stretch, of the window's length, and not title by title. What such kinds connect is a group. A group's articles of a stretch come
to one task in their order, behind the last of each title of the stretch before. An article looks back through those of a kind
it may match, from the latest on, and no further than what it has found already; where the first few aren't similar, all titles of
the two kinds are compared once, and the latest similar one is looked up. A task holds some thousands of articles at a time and the last of each title
before them, so what it takes grows with articles, and its memory with titles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.components import connected_components
from presswork.operators.shapes import LONG_BITS, _decided, _digits, _is_similar, patterns, row_patterns, shape
from presswork.operators.similar import candidate_titles, common_letters
from presswork.shared import written

#: Articles taken at once; steps back one by one; titles of two kinds that are compared in one block.
AT_ONCE, STEPS, CELLS = 1 << 16, 8, 1 << 22


def conflicts(a: str, b: str) -> str:
    """SQL: both sides name real companies, and none in common."""
    return f"(size({a}) > 0 and size({b}) > 0 and not arrays_overlap({a}, {b}))"


def may_match(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs of shapes, those whose longest common subsequence leaves room for the ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                new, old = (np.asarray(c.to_pylist(), np.str_) for c in batch.columns)
                fits = 2 * common_letters(new, old) >= least * (np.char.str_len(new) + np.char.str_len(old)) - 1e-9
                yield batch.filter(pa.array(fits))

    return run


def near_kinds(placed: DataFrame, asked: DataFrame, kinds: DataFrame, least: float, index: DataFrame | None = None) -> DataFrame:
    """``(kind, other)`` of kinds without conflict of which titles may be similar, each with itself too: the asked ones with those
    that occur in their stretch or the one before. ``placed`` and ``asked``: (kind, stretch); ``kinds``: (kind, shape, real_companies)."""
    named = [df.join(kinds, "kind").select(F.col("shape").alias("title"), "stretch").distinct() for df in (placed, asked)]
    pairs = candidate_titles(named[0], least, named[1], index).mapInArrow(may_match(least), "title string, earlier_title string")
    pairs = pairs.selectExpr("title as shape", "earlier_title as other_shape").unionByName(kinds.selectExpr("shape", "shape as other_shape").distinct())
    own = kinds.join(asked.select("kind").distinct(), "kind", "left_semi")
    other = kinds.selectExpr("kind as other", "shape as other_shape", "real_companies as other_companies")
    return written(own.join(pairs, "shape").join(other, "other_shape").where(f"not {conflicts('real_companies', 'other_companies')}").select("kind", "other"), "near-kinds")


class _Titles:
    """Titles of one kind: their digits, and where each is told."""

    def __init__(self, titles: list[str]):
        self.titles, self.digits = titles, _digits(titles)
        self.shape = "".join("0" if "0" <= c <= "9" else c for c in titles[0])


def _block(a: _Titles, b: _Titles, least: float, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Of all pairs of titles of two kinds, whether they are similar."""
    bits = a.digits.shape[1] * b.digits.shape[1]
    if bits > LONG_BITS:
        return np.array([[_is_similar(a.titles[i], b.titles[j], least) for j in columns.tolist()] for i in rows.tolist()])
    pair = lambda k: (a.titles[rows[k // len(columns)]], b.titles[columns[k % len(columns)]])
    return _decided(patterns(a.digits[rows], b.digits[columns]), bits, (a.shape, b.shape), least, pair)


def _one_by_one(a: _Titles, b: _Titles, least: float, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    bits = a.digits.shape[1] * b.digits.shape[1]
    if bits > LONG_BITS:
        return np.array([_is_similar(a.titles[i], b.titles[j], least) for i, j in zip(rows.tolist(), columns.tolist())], bool)
    return _decided(row_patterns(a.digits[rows], b.digits[columns]), bits, (a.shape, b.shape), least, lambda k: (a.titles[rows[k]], b.titles[columns[k]]))


def _look_back(best: np.ndarray, s: np.ndarray, told: np.ndarray, x: np.ndarray, y: np.ndarray, a: _Titles, b: _Titles, least: float, span: int) -> None:
    """Raise ``best`` of the places ``x`` to the latest earlier one among ``y`` of a similar title, within ``span``.

    Places are sorted; ``told`` is the number of a place's title among those of its kind."""
    at = np.searchsorted(y, x) - 1

    def open_(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = y[at]
        live = (at >= 0) & (other > best[x]) & (s[x] - s[other] <= span)
        return x[live], at[live]

    x, at = open_(x, at)
    for _ in range(STEPS):
        if not len(x):
            return
        hit = _one_by_one(a, b, least, told[x], told[y[at]])
        best[x[hit]] = y[at[hit]]
        x, at = open_(x[~hit], at[~hit] - 1)
    if not len(x):
        return
    # What is left: each of its titles with all of the other kind's, and the latest similar one before each place.
    rows, of = np.unique(told[x], return_inverse=True)
    columns, places = np.unique(told[y], return_inverse=True)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(len(rows) + 1))
    step = max(CELLS // len(columns), 1)
    for start in range(0, len(rows), step):
        alike = _block(a, b, least, rows[start : start + step], columns)
        for k in np.flatnonzero(alike.any(1)).tolist():
            mine = order[bounds[start + k] : bounds[start + k + 1]]
            last = np.maximum.accumulate(np.where(alike[k][places], np.arange(len(y)), -1))
            found, to = open_(x[mine], last[at[mine]])
            best[found] = y[to]


def _latest(least: float, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows by group, stretch and time, ``(article_id, earlier_id)``. Rows without a time tell of two kinds that may match, and come first."""

    def solve(rows: pa.Table, near: dict[int, list[int]]) -> tuple[pa.RecordBatch, pa.Table]:
        ids, s, kind = (rows.column(c).to_numpy() for c in ("article_id", "s", "kind"))
        asks = rows.column("asks").to_numpy().astype(bool)
        coded = rows.column("title").combine_chunks().dictionary_encode()
        text, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        kinds, of = np.unique(kind, return_inverse=True)
        both = of.astype(np.int64) * len(names) + text
        pairs, number = np.unique(both, return_inverse=True)
        first = np.searchsorted(pairs, np.arange(len(kinds) + 1) * len(names))
        told = number - first[of]
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(kinds) + 1))
        places = {k: order[ends[i] : ends[i + 1]] for i, k in enumerate(kinds.tolist())}
        made: dict[int, _Titles] = {}

        def titles(k: int) -> _Titles:
            if k not in made:
                i = int(np.searchsorted(kinds, k))
                made[k] = _Titles([names[int(p) % len(names)] for p in pairs[first[i] : first[i + 1]]])
            return made[k]

        best = np.full(len(ids), -1, np.int64)
        for k, x in places.items():
            x = x[asks[x]]
            if len(x):
                for other in (k, *(o for o in near.get(k, ()) if o != k)):
                    if other in places:
                        _look_back(best, s, told, x, places[other], titles(k), titles(other), least, span)
        found = np.flatnonzero(best >= 0)
        out = pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(ids[best[found]])], ["article_id", "earlier_id"])
        # The last of each title of a kind is all that later articles need.
        _, last = np.unique(number[::-1], return_index=True)
        kept = np.sort(len(ids) - 1 - last)
        kept = kept[s[kept] >= s[-1] - span]
        held = rows.take(pa.array(kept))
        return out, held.set_column(held.schema.get_field_index("asks"), "asks", pa.array(np.zeros(len(kept), bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, near, held, waiting, n = None, {}, None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, n
            if waiting:
                out, held = solve(pa.concat_tables([*([held] if held is not None else []), *waiting]), near)
                waiting, n = [], 0
                yield out

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "stretch")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if group != (key := tuple(keys[:, start].tolist())):
                    yield from flush()
                    group, near, held = key, {}, None
                part = batch.slice(start, end - start)
                mute = part.column("at").null_count
                for k, other in zip(part.column("kind").slice(0, mute).to_pylist(), part.column("article_id").slice(0, mute).to_pylist()):
                    near.setdefault(k, []).append(other)
                if mute < part.num_rows:
                    waiting.append(pa.Table.from_batches([part.slice(mute)]))
                    n += part.num_rows - mute
                if n >= AT_ONCE:
                    yield from flush()
        yield from flush()

    return run


def latest_similar(rows: DataFrame, asked: DataFrame, kinds: DataFrame, index: DataFrame, span: int, least: float) -> DataFrame:
    """``(article_id, earlier_id)``: of the asked articles, those that have an earlier one of a similar title within ``span``
    seconds, and the latest of these. ``rows`` and ``asked``: (article_id, at, s, kind, title)."""
    asks_all = asked is rows
    rows, asked = (df.withColumn("stretch", F.expr(f"floor(s / {span})")) for df in (rows, asked))
    placed = written(rows.select("kind", "stretch").distinct(), "latest-placed")
    wanted = placed if asks_all else written(asked.select("kind", "stretch").distinct(), "latest-asked")
    near = near_kinds(placed, wanted, kinds, least, index)
    groups = connected_components(near.selectExpr("kind as a", "other as b"))
    parts = written(kinds.select("kind").join(groups.withColumnRenamed("node", "kind"), "kind", "left").select("kind", F.coalesce("component", "kind").alias("part")), "latest-parts")
    own = rows.withColumn("asks", F.lit(True)) if asks_all else rows.join(asked.select("article_id", F.lit(True).alias("asks")), "article_id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    last = rows.groupBy("kind", "title", (F.col("stretch") + 1).alias("stretch")).agg(F.max(F.struct("at", "article_id", "s")).alias("l"))
    before = last.select("l.article_id", "l.at", "l.s", "kind", "title", "stretch", F.lit(False).alias("asks"))
    every = own.select(*before.columns).unionByName(before).join(parts, "kind")
    if not asks_all:
        every = every.join(wanted.join(parts, "kind").select("part", "stretch").distinct(), ["part", "stretch"], "left_semi")
    here = placed.union(placed.selectExpr("kind", "stretch + 1")).distinct().withColumnRenamed("kind", "other")
    told = near.where("kind <> other").join(wanted, "kind").join(here, ["other", "stretch"], "left_semi").join(parts, "kind")
    none = F.lit(None)
    told = told.select(F.col("other").alias("article_id"), none.cast("long").alias("at"), none.cast("long").alias("s"), "kind", none.cast("string").alias("title"), "stretch", F.lit(False).alias("asks"), "part")
    partitions = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.select(*told.columns).unionByName(told).repartition(partitions, "part", "stretch").sortWithinPartitions("part", "stretch", "at", "article_id")
    return dealt.mapInArrow(_latest(least, span), "article_id long, earlier_id long")


def kinds_of(articles: DataFrame) -> DataFrame:
    """``(kind, shape, real_companies)`` of the distinct kinds of articles."""
    return articles.groupBy("kind").agg(F.first("shape").alias("shape"), F.first("real_companies").alias("real_companies"))
