"""Similar titles by shapes: how many each title has, and what they connect, without a row for each pair.

Titles that differ in their digits only have one shape. The ratio of two titles depends on which of their letters are
equal, and not on what these are; so of two shapes it depends on which digit of the one equals which of the other. Such a
pattern is compared once, by matching blocks, and all pairs that have it are decided by a look-up. Shapes meet by the
candidates of similar titles: equal letters stay equal when digits become one letter, so no bound gets tighter.

Blocks of titles of two shapes are compared in an era, of ERA stretches, by bits of the stretches in which they occur. A pair
that has met in an earlier era isn't counted again.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.components import connected_components
from presswork.operators.similar import LOOKBACK_DAYS, SIMILAR, candidate_titles, stretched
from presswork.shared import written

#: Stretches of an era; titles of a shape that are compared in one block, and how many at once with such a block.
ERA, PART, AT_ONCE = 32, 2048, 256
#: Patterns that a table of bytes holds, and that a long does, in bits.
TABLE_BITS, LONG_BITS = 16, 64


def shape(title: str | Column) -> Column:
    """The title, each digit a zero."""
    return F.translate(title, "123456789", "000000000")


def _is_similar(a: str, b: str, least: float) -> bool:
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and matcher.ratio() >= least


@lru_cache(512)
def _table(a: str, b: str, least: float, bits: int) -> np.ndarray:
    """Of two shapes, what is known of each pattern: -1 nothing, else whether titles of it are similar."""
    return np.full(1 << bits, -1, np.int8)


def _digits(titles: list[str]) -> np.ndarray:
    return np.array([[ord(c) - 48 for c in t if "0" <= c <= "9"] for t in titles], np.uint8).reshape(len(titles), -1)


def patterns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of rows of digits: its bits tell which digit of the one equals which of the other."""
    bits = a.shape[1] * b.shape[1]
    kind = np.dtype(np.uint16 if bits <= TABLE_BITS else np.uint64)
    out = np.zeros((len(a), len(b)), kind)
    if bits:
        places = kind.type(1) << np.arange(b.shape[1]).astype(kind)
        held = np.stack([((b == d) * places).sum(1, dtype=kind) for d in range(10)])
        for i in range(a.shape[1]):
            out |= held[a[:, i]] << kind.type(i * b.shape[1])
    return out


def _decided(codes: np.ndarray, bits: int, shapes: tuple[str, str], least: float, pair: Callable[[int], tuple[str, str]]) -> np.ndarray:
    """Of patterns of two shapes, whether titles of them are similar; ``pair`` gives those at a place. One pair of a pattern is compared."""
    if bits <= TABLE_BITS:
        table = _table(*shapes, least, bits)
        new = np.flatnonzero(table[codes].ravel() < 0)
        for code, k in zip(*np.unique(codes.ravel()[new], return_index=True)):
            table[code] = _is_similar(*pair(int(new[k])), least)
        return table[codes] > 0
    _, first, back = np.unique(codes, return_index=True, return_inverse=True)
    return np.array([_is_similar(*pair(int(k)), least) for k in first])[back].reshape(codes.shape)


def similar_block(a: list[str], b: list[str], shapes: tuple[str, str], least: float) -> np.ndarray:
    """Of all pairs of titles of two shapes, whether they are similar."""
    x, y = _digits(a), _digits(b)
    bits = x.shape[1] * y.shape[1]
    if bits > LONG_BITS:
        return np.array([[_is_similar(s, t, least) for t in b] for s in a])
    return _decided(patterns(x, y), bits, shapes, least, lambda k: (a[k // len(b)], b[k % len(b)]))


def row_patterns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``patterns``, of rows of digits one by one."""
    bits = x.shape[1] * y.shape[1]
    codes = np.zeros(len(x), np.uint16 if bits <= TABLE_BITS else np.uint64)
    for i in range(bits):
        codes |= (x[:, i // y.shape[1]] == y[:, i % y.shape[1]]).astype(codes.dtype) << codes.dtype.type(i)
    return codes


def similar_rows(a: list[str], b: list[str], shapes: tuple[str, str], least: float) -> np.ndarray:
    """Of pairs of titles of two shapes, one by one, whether they are similar."""
    x, y = _digits(a), _digits(b)
    bits = x.shape[1] * y.shape[1]
    if bits > LONG_BITS:
        return np.array([_is_similar(s, t, least) for s, t in zip(a, b)])
    return _decided(row_patterns(x, y), bits, shapes, least, lambda k: (a[k], b[k]))


def similar_pairs(pairs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``(title, earlier_title)`` of the pairs that are similar, exactly; of each pattern one is compared in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, old, *shapes = (c.to_pylist() for c in batch.columns)
            groups: dict[tuple, list[int]] = {}
            for i, both in enumerate(zip(*shapes)):
                groups.setdefault(both, []).append(i)
            kept = [i for both, at in groups.items() for i in np.array(at)[similar_rows([new[i] for i in at], [old[i] for i in at], both, least)].tolist()]
            yield batch.select(["title", "earlier_title"]).take(pa.array(kept, pa.int64()))

    named = pairs.select("title", "earlier_title", shape("title").alias("shape"), shape("earlier_title").alias("other_shape"))
    return named.repartition("shape", "other_shape", F.xxhash64("title") % 8).mapInArrow(run, "title string, earlier_title string")


def spread(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a matrix of links: numbers of its rows and of its columns, -1 of those without a link."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for n, start in enumerate(np.flatnonzero(linked.any(1)).tolist()):
        front = np.array([start] if rows[start] < 0 else [], int)
        while len(front):
            rows[front] = n
            reached = linked[front].any(0) & (columns < 0)
            columns[reached] = n
            front = np.flatnonzero(linked[:, reached].any(1) & (rows < 0))
    return rows, columns


def _joint(a: dict, b: dict, era: int) -> np.ndarray:
    """Of all pairs of titles, whether the other occurs with the one in this era, and in none before it."""

    def words(side: dict, kind: str) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for i, held in enumerate(side["eras"]):
            for one in held:
                if one["era"] <= era:
                    out.setdefault(one["era"], np.zeros(len(side["eras"]), np.uint32))[i] = one[kind]
        return out

    own, near = words(a, "own"), words(b, "near")
    met = (own[era][:, None] & near[era][None, :]) != 0
    for before in own.keys() & near.keys() - {era}:
        met &= (own[before][:, None] & near[before][None, :]) == 0
    return met


def _counted(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of blocks of titles, rows of a title and its number of similar ones, and rows of two titles that are connected."""

    def block(row: dict) -> Iterator[tuple]:
        a, b = ({"titles": [t["title"] for t in row[c]], "eras": [t["eras"] for t in row[c]]} for c in ("titles", "other_titles"))
        met = _joint(a, b, row["era"])
        for start in range(0, len(met), AT_ONCE):
            part = slice(start, start + AT_ONCE)
            if met[part].any():
                met[part] &= similar_block(a["titles"][part], b["titles"], (row["shape"], row["other_shape"]), least)
        if row["shape"] == row["other_shape"]:
            at = {t: j for j, t in enumerate(b["titles"])}
            for i, t in enumerate(a["titles"]):
                if t in at:
                    met[i, at[t]] = False
        for i in np.flatnonzero(met.any(1)).tolist():
            yield a["titles"][i], None, int(met[i].sum())
        named: list[dict] = [{}, {}]
        for first, side, labels in zip(named, (a, b), spread(met)):
            for i in np.flatnonzero(labels >= 0).tolist():
                title = first.setdefault(int(labels[i]), side["titles"][i])
                if title != side["titles"][i]:
                    yield side["titles"][i], title, None
        for n, title in named[0].items():
            yield title, named[1][n], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                made = list(block(batch.slice(i, 1).to_pylist()[0]))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.string(), pa.int64()))], ["title", "other", "links"])

    return run


def _cells(rows: DataFrame) -> DataFrame:
    """``(era, shape, part, titles, own)`` of ``rows(title, stretch)``: titles of a shape in an era, PART or so at a time; ``own``: one
    of them occurs in the era, and not only just before it. ``near`` has a bit for each stretch a title occurs in or before."""
    places = F.explode(F.array(F.struct(F.col("stretch").alias("s"), F.lit(True).alias("own")), F.struct((F.col("stretch") + 1).alias("s"), F.lit(False).alias("own"))))
    placed = rows.withColumn("p", places).select("title", F.expr(f"floor(p.s / {ERA})").alias("era"), F.expr(f"shiftleft(1L, cast(pmod(p.s, {ERA}) as int))").alias("bit"), "p.own")
    eras = placed.groupBy("title", "era").agg(F.bit_or(F.when(F.col("own"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("own"), F.bit_or("bit").alias("near"))
    titles = eras.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("era", "own", "near"))).alias("eras")).withColumn("shape", shape("title"))
    each = written(titles.select("title", "shape", "eras", F.explode("eras").alias("e")).select("title", "shape", "eras", "e.era", "e.own"), "shape-titles")
    parts = each.groupBy("era", "shape").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = each.join(parts, ["era", "shape"]).withColumn("part", F.expr("pmod(xxhash64(title), parts)"))
    return dealt.groupBy("era", "shape", "part").agg(F.collect_list(F.struct("title", "eras")).alias("titles"), F.max(F.col("own") != 0).alias("own"))


def similar_classes(df: DataFrame, least: float = SIMILAR, days: int = LOOKBACK_DAYS) -> DataFrame:
    """``(title, class_id, links)`` of distinct cleaned titles: ``links`` is the number of pairs that similar_titles has of a title, and
    ``class_id`` the least title that pairs connect with it. Titles without a time occur with none."""
    every = written(stretched(df, days).where("title <> ''").distinct(), "shape-rows")
    cells = written(_cells(every.where("stretch is not null")), "shape-cells")
    shapes = cells.select(F.col("shape").alias("title"), F.col("era").alias("stretch")).distinct()
    near = candidate_titles(shapes, least).selectExpr("title as shape", "earlier_title as other_shape")
    near = near.unionByName(shapes.selectExpr("title as shape", "title as other_shape").distinct())
    other = cells.selectExpr("era", "shape as other_shape", "titles as other_titles")
    blocks = cells.where("own").drop("own").join(near, "shape").join(other, ["era", "other_shape"])
    # Work grows with pairs and not with bytes; patterns of two shapes are mostly compared in one task.
    partitions = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(partitions, "shape", "other_shape", "part").select("era", "shape", "other_shape", "titles", "other_titles")
    found = written(dealt.mapInArrow(_counted(least), "title string, other string, links long"), "shape-links")
    classes = connected_components(found.where("other is not null").selectExpr("title as a", "other as b").distinct()).withColumnRenamed("node", "title")
    links = found.where("links is not null").groupBy("title").agg(F.sum("links").alias("links"))
    joined = every.select("title").distinct().join(classes, "title", "left").join(links, "title", "left")
    return joined.select("title", F.coalesce("component", "title").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
