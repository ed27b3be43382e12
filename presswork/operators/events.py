"""Events by their founders: which article begins an event, and which founder every other article joins.

Articles are taken in order of time, then id. One joins the first founder it matches, or else founds an event itself: a
founder of the same address, of the same title hash, then, within the window and without conflict of companies, the latest
of a similar title, the latest of the same event type and a common company. Only founders are matched with, so an event
reaches as far as the window from its founder and doesn't drift on along later articles.

Stretches of the window's length are taken in their order, since what is earlier only matters: what matches a founder of before is
decided first, so an article is met in its own stretch alone. In a stretch this is a fixpoint: an article that no undecided earlier one
might match is a founder; all that match the new founders are decided with them; and so on with the rest. Titles might match by their
shapes (see shapes); true ratios are found only against founders. A round needs, of each key and stretch, the first and last undecided
time, and never the pairs of a group. The last few thousand articles of a stretch, a fixed number for any input, are taken one by one,
which spares the long tail of rounds over next to nothing.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.rules import CLUSTERABLE
from presswork.operators.dedup import conflicts
from presswork.operators.shapes import shape, similar_pairs
from presswork.operators.similar import DAY, LOOKBACK_DAYS, SIMILAR, candidate_titles
from presswork.shared import written

#: Rounds until which a job must have settled, and undecided articles that are taken one by one.
ROUNDS, LAST = 10_000, 2048
_LEGS = ("clean_url", "content_hash")
_EARLIER = "(founded, founder_id) < (t, article_id)"


def _at(t: str = "t", i: str = "article_id") -> Column:
    return F.struct(t, i)


def _prepared(df: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Articles in order of stretches, with their time in seconds (null: 0), stretch, event keys and kind; and the kinds, distinct
    shapes of titles with their companies."""
    rows = df.select(
        "article_id", F.coalesce(F.unix_timestamp("published_at"), F.lit(0)).alias("t"), *(F.nullif(F.col(c), F.lit("")).alias(c) for c in _LEGS),
        F.coalesce("plain_title", F.lit("")).alias("title"), F.array_sort("real_companies").alias("real_companies"),
        F.when(F.col("event_type").isin(*CLUSTERABLE), F.transform("real_companies", lambda c: F.concat("event_type", F.lit(":"), c))).alias("events"),
    )
    rows = rows.withColumn("stretch", F.expr(f"floor(t / {days * DAY})")).withColumn("shape", shape("title")).withColumn("kind", F.xxhash64("shape", "real_companies"))
    rows = written(rows.repartitionByRange("stretch", "article_id").sortWithinPartitions("stretch"), "event-articles")
    return rows, written(rows.where("title <> ''").select("kind", "shape", "real_companies").distinct(), "event-kinds")


def _near(rows: DataFrame, kinds: DataFrame, least: float) -> DataFrame:
    """``(kind, other)`` of kinds without conflict of which titles may be similar, kinds of one shape too."""
    pairs = candidate_titles(rows.select(F.col("shape").alias("title"), "stretch").distinct(), least).selectExpr("title as shape", "earlier_title as other_shape")
    same = kinds.selectExpr("shape", "shape as other_shape").distinct()
    other = kinds.selectExpr("kind as other", "shape as other_shape", "real_companies as other_companies")
    met = pairs.unionByName(same).join(kinds, "shape").join(other, "other_shape").where(f"not {conflicts('real_companies', 'other_companies')}")
    return written(met.select("kind", "other"), "event-near")


def _blocked(lead: DataFrame, left: DataFrame, near: DataFrame, window: int) -> DataFrame:
    """Ids of ``lead`` that an undecided earlier article might match within the window."""

    def spoken(keyed: DataFrame) -> DataFrame:
        return keyed.groupBy("key", "stretch").agg(F.min(_at()).alias("first"), F.max("t").alias("last"))

    def heard(said: DataFrame) -> DataFrame:
        """In a stretch, what is said in it and in the one before."""
        own = said.select("key", "stretch", "first", F.lit(None).cast("long").alias("last"))
        before = said.select("key", (F.col("stretch") + 1).alias("stretch"), F.lit(None).cast(said.schema["first"].dataType).alias("first"), "last")
        return own.unionByName(before).groupBy("key", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))

    late = f"first < struct(t, article_id) or last >= t - {window}"
    events = spoken(left.select("article_id", "t", "stretch", F.explode("events").alias("key")))
    by_event = lead.select("article_id", "t", "stretch", F.explode("events").alias("key")).join(heard(events), ["key", "stretch"]).where(late)
    titles = spoken(left.where("title <> ''").select("article_id", "t", "stretch", F.col("kind").alias("key")))
    asked = near.join(lead.select("kind").distinct(), "kind").select("kind", F.col("other").alias("key"))
    told = asked.join(titles, "key").select(F.col("kind").alias("key"), "stretch", "first", "last")
    by_title = lead.withColumnRenamed("kind", "key").join(heard(told), ["key", "stretch"]).where(late)
    return by_event.select("article_id").union(by_title.select("article_id")).distinct()


def _close(founders: DataFrame) -> DataFrame:
    """Founders as others, each in its own stretch and the next."""
    own = founders.select(F.col("article_id").alias("founder_id"), F.col("t").alias("founded"), F.col("title").alias("earlier_title"), F.col("kind").alias("other"), F.col("events").alias("its_events"), "stretch")
    return own.withColumn("stretch", F.explode(F.array("stretch", F.col("stretch") + 1)))


def _near_matches(rows: DataFrame, founders: DataFrame, near: DataFrame, least: float, window: int) -> DataFrame:
    """``(article_id, founder_id, founded, level)`` of articles and earlier founders whose titles are similar, without conflict. Only
    titles that occur in a stretch with a founder are compared."""
    close = _close(founders.where("title <> ''"))
    asked = rows.where("title <> ''").select("kind", "title", "stretch").distinct().join(near, "kind").join(close.select("other", "earlier_title", "stretch").distinct(), ["other", "stretch"])
    asked = written(asked.select("kind", "other", "title", "earlier_title", "stretch"), "event-asked")
    pairs = asked.where("title <> earlier_title").select("title", "earlier_title").distinct()
    true = asked.join(similar_pairs(pairs, least), ["title", "earlier_title"]).unionByName(asked.where("title = earlier_title"))
    met = rows.join(true, ["kind", "title", "stretch"]).join(close, ["other", "earlier_title", "stretch"]).where(f"{_EARLIER} and t - founded <= {window}")
    return met.select("article_id", "founder_id", "founded", F.lit(4).alias("level"))


def _key_matches(rows: DataFrame, founders: DataFrame, window: int) -> DataFrame:
    """``(article_id, founder_id, founded, level)`` of articles and earlier founders of their address, title hash or event."""
    every = None
    for level, key in enumerate(_LEGS, 2):
        own = founders.select(key, F.col("article_id").alias("founder_id"), F.col("t").alias("founded"))
        found = rows.join(own, key).where(_EARLIER).select("article_id", "founder_id", "founded", F.lit(level).alias("level"))
        every = found if every is None else every.unionByName(found)
    close = _close(founders).select("founder_id", "founded", "stretch", F.explode("its_events").alias("event"))
    told = rows.select("article_id", "t", "stretch", F.explode("events").alias("event")).join(close, ["event", "stretch"]).where(f"{_EARLIER} and t - founded <= {window}")
    return every.unionByName(told.select("article_id", "founder_id", "founded", F.lit(5).alias("level")))


def _rest(left: DataFrame, founders: DataFrame, near: DataFrame, least: float, window: int) -> DataFrame:
    """Articles that no founder decides."""
    left = written(left.join(_key_matches(left, founders, window).select("article_id").distinct(), "article_id", "left_anti"), "event-left")
    return written(left.join(_near_matches(left, founders, near, least, window).select("article_id").distinct(), "article_id", "left_anti"), "event-left")


def _slices(rows: DataFrame) -> list[tuple[int, int]]:
    """First and last stretch of runs of stretches, of one stretch or of LAST articles at most."""
    out: list[list[int]] = []
    for stretch, n in rows.groupBy("stretch").count().orderBy("stretch").collect():
        if out and out[-1][2] + n <= LAST:
            out[-1][1:] = [stretch, out[-1][2] + n]
        else:
            out.append([stretch, stretch, n])
    return [(first, last) for first, last, _ in out]


def _founders_in_order(rows: list[dict], least: float, window: int) -> list[int]:
    """Ids of the founders among a few articles, which are taken in their order."""
    founders: list[tuple[dict, set, set]] = []
    held: dict[str, set] = {leg: set() for leg in _LEGS}
    matcher, alike = difflib.SequenceMatcher(None), {}

    def similar(a: str, b: str) -> bool:
        if (a, b) not in alike:
            matcher.set_seqs(a, b)
            alike[a, b] = matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and matcher.ratio() >= least
        return alike[a, b]

    for row in sorted(rows, key=lambda r: (r["t"], r["article_id"])):
        companies, told = set(row["real_companies"] or ()), set(row["events"] or ())
        if any(row[leg] is not None and row[leg] in held[leg] for leg in _LEGS):
            continue
        near = [f for f in founders if row["t"] - f[0]["t"] <= window]
        if any(told & events or row["title"] and f["title"] and not (companies and theirs and not companies & theirs) and (row["title"] == f["title"] or similar(row["title"], f["title"])) for f, theirs, events in near):
            continue
        founders.append((row, companies, told))
        for leg in _LEGS:
            held[leg].add(row[leg])
    return [f["article_id"] for f, _, _ in founders]


def _last_founders(left: DataFrame, least: float, window: int) -> DataFrame:
    """The founders among LAST articles or fewer, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(_founders_in_order(rows, least, window), pa.int64())], ["article_id"])

    found = left.select("article_id", "t", *_LEGS, "title", "real_companies", "events").coalesce(1).mapInArrow(run, "article_id long")
    return left.join(found, "article_id", "left_semi")


def founders_of(df: DataFrame, days: int = LOOKBACK_DAYS, least: float = SIMILAR, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """``(article_id, event_id, level)`` of every article, founders with their own id and no level, and the number of rounds.

    ``df`` has article_id, published_at, clean_url, content_hash, plain_title, real_companies, event_type; ids are distinct.
    Null or empty addresses, hashes and titles match nothing; a null time counts as the first of all. No rows give no rows.
    """
    window = days * DAY
    rows, kinds = _prepared(df, days)
    near = _near(rows, kinds, least)
    founders, n = None, 0
    for low, high in _slices(rows):
        left = rows.where(f"stretch between {low} and {high}")
        if founders is not None:
            left = _rest(left, founders, near, least, window)
        while few := left.limit(LAST + 1).count():
            if n == rounds:
                raise RuntimeError(f"events did not settle in {rounds} rounds")
            n += 1
            if few <= LAST:
                new = _last_founders(left, least, window)
            else:
                lead = left
                for key in _LEGS:
                    first = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(_at()).alias("first"))
                    lead = lead.join(first, key, "left").where("first is null or first = struct(t, article_id)").drop("first").select(*rows.columns)
                new = lead.join(_blocked(lead, left, near, window), "article_id", "left_anti")
            new = written(new.select(*rows.columns), "event-founders")
            founders = new if founders is None else written(founders.unionByName(new), "event-founders")
            if few <= LAST:
                break
            left = _rest(left.join(new.select("article_id"), "article_id", "left_anti"), new, near, least, window)
    if founders is None:
        return rows.select("article_id", F.col("article_id").alias("event_id"), F.lit(None).cast("int").alias("level")), 0
    keyed = written(_key_matches(rows, founders, window), "event-keyed")
    others = rows.join(keyed.where("level < 4").select("article_id").distinct(), "article_id", "left_anti")
    every = keyed.unionByName(_near_matches(others, founders, near, least, window))
    # Of a level the latest founder; of addresses and hashes there is one.
    best = every.groupBy("article_id").agg(F.min(F.struct("level", (-F.col("founded")).alias("f"), (-F.col("founder_id")).alias("i"))).alias("best"))
    own = founders.select("article_id", F.lit(True).alias("own"))
    placed = rows.select("article_id").join(best, "article_id", "left").join(own, "article_id", "left")
    return placed.select("article_id", F.when(F.col("own"), F.col("article_id")).otherwise(-F.col("best.i")).alias("event_id"), F.when(F.col("own").isNull(), F.col("best.level")).alias("level")), n


def assign_events(df: DataFrame) -> DataFrame:
    """``(article_id, event_id, level)`` of every article: see founders_of. Levels: 2 address, 3 title hash, 4 similar title, 5 event."""
    return founders_of(df)[0]
