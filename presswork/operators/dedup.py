"""Exact levels of deduplication, event fingerprints, and title similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.functions.rules import CLUSTERABLE
from presswork.operators.components import connected_components
from presswork.operators.latest import conflicts, kinds_of, latest_similar
from presswork.operators.shapes import shape
from presswork.operators.similar import DAY, LOOKBACK_DAYS, SIMILAR, title_index, verified  # noqa: F401 (tests count through verified)
from presswork.shared import written

POOL_ROWS = 500
#: Kinds of titles within the shortest time that similar ones are looked for in, and how much longer the next one is.
NEAR_ROWS, SPAN_GROWTH = 512, 8


def first_of(df: DataFrame, key: str) -> DataFrame:
    """``(article_id, founder_id)``: of each row that isn't the first with its key, the first by time and id.

    The first of a key comes from a grouped minimum, combined before its shuffle; the join back splits hot keys. Rows
    with a null or empty key match nothing.
    """
    keyed = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    firsts = keyed.groupBy(key).agg(F.min(F.struct("published_at", "article_id")).alias("first"))
    joined = keyed.join(firsts, key).select("article_id", F.col("first.article_id").alias("founder_id"))
    return joined.where("article_id <> founder_id")


def event_links(df: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """``(article_id, earlier_id)``: the latest earlier story of the same event type and a shared company, in the window.

    Ties in time go by id. Linking each row to its predecessor, and not to all earlier ones, gives no pairs of a
    group; a hot group is dealt by stretches of the window's length, of which each knows the last row before it.
    """
    rows = df.where(F.col("event_type").isin(*CLUSTERABLE)).select("article_id", "published_at", "event_type", F.explode("real_companies").alias("company"))
    rows = rows.withColumn("stretch", F.expr(f"floor(unix_timestamp(published_at) / {days * DAY})"))
    at = F.struct("published_at", "article_id")
    inside = rows.withColumn("before", F.lag(at).over(W.partitionBy("event_type", "company", "stretch").orderBy("published_at", "article_id")))
    last = rows.groupBy("event_type", "company", (F.col("stretch") + 1).alias("stretch")).agg(F.max(at).alias("last"))
    found = inside.join(last, ["event_type", "company", "stretch"], "left").withColumn("before", F.coalesce("before", "last"))
    near = found.where(f"before is not null and unix_timestamp(published_at) - unix_timestamp(before.published_at) <= {days * DAY}")
    return near.groupBy("article_id").agg(F.max("before").alias("b")).select("article_id", F.col("b.article_id").alias("earlier_id"))


def _spans(rows: DataFrame, window: int) -> list[int]:
    """Seconds to look back, growing to the window. The first holds about NEAR_ROWS kinds of titles."""
    placed = rows.select("kind", F.expr(f"floor(s / {window})").alias("stretch")).distinct()
    n, stretches = placed.agg(F.count("*"), F.count_distinct("stretch")).first()
    if not n:
        return [window]
    spans, span = [], max(window * NEAR_ROWS * stretches // n, 60)
    while span * SPAN_GROWTH <= window:
        spans.append(span)
        span *= SPAN_GROWTH
    return [*spans, window]


def similar_links(df: DataFrame, days: int = LOOKBACK_DAYS, new: DataFrame | None = None, least: float = SIMILAR) -> DataFrame:
    """``(article_id, earlier_id)``: the latest earlier story whose title is similar (equal ones too), without conflict. Where
    ``new``, some of the articles of ``df``, is given, of these only.

    Where many kinds of titles occur in a window, articles look back a short time first, and only those that found nothing there a
    longer one, up to the window: what is found within a time is the latest of all. So the kinds that are compared grow with the articles, and
    not with the square of those of a week, unless few have anything similar near. See latest for how articles look back.
    """

    def timed(articles: DataFrame) -> DataFrame:
        told = articles.where("plain_title <> '' and published_at is not null").withColumn("shape", shape("plain_title"))
        kind = F.xxhash64("shape", F.array_sort("real_companies"), F.col("real_companies").isNull())
        return told.select("article_id", F.unix_micros("published_at").alias("at"), F.unix_timestamp("published_at").alias("s"), kind.alias("kind"), F.col("plain_title").alias("title"), "shape", "real_companies")

    whole = written(timed(df), "similar-articles")
    kinds = written(kinds_of(whole), "similar-kinds")
    rows, index = whole.drop("shape", "real_companies"), title_index(kinds.select(F.col("shape").alias("title")), least)
    left = rows if new is None or new is df else written(timed(new).drop("shape", "real_companies"), "similar-left")
    links = None
    for span in _spans(rows, days * DAY):
        found = written(latest_similar(rows, left, kinds, index, span, least), "similar-found")
        links = found if links is None else links.unionByName(found)
        if span < days * DAY:
            left = written(left.join(found, "article_id", "left_anti"), "similar-left")
            if left.isEmpty():
                break
    return links


def find_duplicates(df: DataFrame) -> DataFrame:
    """``(article_id, match_id, level)``: the match of the lowest level: 2 address, 3 title hash, 4 similar title, 5 event."""
    levels = [
        first_of(df, "clean_url").select("article_id", F.col("founder_id").alias("match_id"), F.lit(2).alias("level")),
        first_of(df, "content_hash").select("article_id", F.col("founder_id").alias("match_id"), F.lit(3).alias("level")),
        similar_links(df).select("article_id", F.col("earlier_id").alias("match_id"), F.lit(4).alias("level")),
        event_links(df).select("article_id", F.col("earlier_id").alias("match_id"), F.lit(5).alias("level")),
    ]
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.groupBy("article_id").agg(F.min_by("match_id", "level").alias("match_id"), F.min("level").alias("level"))


def exact_clusters(df: DataFrame) -> DataFrame:
    """``(article_id, cluster_id)`` of stories that equal addresses or title hashes connect, two at least."""
    edges = first_of(df, "clean_url").unionByName(first_of(df, "content_hash")).selectExpr("article_id as a", "founder_id as b")
    return connected_components(edges).selectExpr("node as article_id", "component as cluster_id")


def choose_primary(clustered: DataFrame) -> DataFrame:
    """``(cluster_id, primary_id, size)``: best tier, most sources, earliest, smallest id."""
    order = F.struct("tier", (-F.col("source_count")).alias("n"), "published_at", "article_id")
    return clustered.groupBy("cluster_id").agg(F.min(order).alias("o"), F.count("*").alias("size")).select("cluster_id", F.col("o.article_id").alias("primary_id"), "size")
