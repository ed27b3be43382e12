"""Landed feed files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An item as it is landed; media elements may repeat.
ITEM = "title string, link string, pubDate string, description string, `media:content` array<struct<_url: string>>, `media:thumbnail` array<struct<_url: string>>"
#: A feed in a registry file.
REGISTRY = "slug string, name string, url string, type string, category string, country string, enabled boolean, priority int"
#: Ways in which feeds write a time, tried in order once the weekday is off.
TIMES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def publication_time(text: Column, fallback: Column) -> Column:
    """A feed's time as UTC, or the fallback where it can't be read."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""))
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in TIMES), fallback)


def split_publisher(df: DataFrame, below: int | None = 50) -> DataFrame:
    """Take a publisher of under ``below`` characters off the end of a title, behind its last dash; without a bound, whatever
    stands there, which is how found entries are read."""
    head, tail = F.trim(F.regexp_extract("title", r"(?s)^(.*) - (.*)$", 1)), F.trim(F.regexp_extract("title", r"(?s)^(.*) - (.*)$", 2))
    fits = (head != "") & (tail != "") & (F.length(tail) < below) if below else F.contains("title", F.lit(" - "))
    return df.withColumns({"title": F.when(fits, head).otherwise(F.col("title")), "source_name": F.when(fits, tail).otherwise(F.col("source_name"))})


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Items with a title and a link."""
    return df.where("coalesce(title, '') <> '' and coalesce(article_url, '') <> ''")


def _element(tag: str, value: Column) -> Column:
    """An element as text; nothing for null. The writer of XML takes no names with a prefix."""
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(code))
    made = F.concat(F.lit(f'<{tag} url="'), value, F.lit('"/>')) if ":" in tag else F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    return F.coalesce(made, F.lit(""))


def _in_channel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's items within one element, so that its file is one document."""
    for lines in ((pa.array(["<channel>"]),), (batch.column(0) for batch in batches), (pa.array(["</channel>"]),)):
        for part in lines:
            yield pa.RecordBatch.from_arrays([part], ["value"])


def write_feed(df: DataFrame, path: str) -> None:
    """Land articles as feed files, an item each; by folders of ``feed`` where there is such a column, or with the media
    elements ``content_url`` and ``thumbnail_url`` where there are these."""
    items = {"title": F.col("title"), "link": F.col("article_url"), "pubDate": F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss '+0000'"), "description": F.col("summary")}
    by = ["feed"] if "feed" in df.columns else []
    media = {tag: F.col(c) for c, tag in (("content_url", "media:content"), ("thumbnail_url", "media:thumbnail")) if c in df.columns}
    if media:
        lines = F.concat(F.lit("<item>"), *(_element(tag, value) for tag, value in (items | media).items()), F.lit("</item>"))
        df.select(lines.alias("value")).mapInArrow(_in_channel, "value string").write.text(path)
    else:
        df.select(*(value.alias(tag) for tag, value in items.items()), *by).write.format("xml").option("rootTag", "channel").option("rowTag", "item").partitionBy(*by).save(path)


def image_of(content: str = "media:content", thumbnail: str = "media:thumbnail") -> Column:
    """The address of the first media content, else of the first thumbnail; null where neither has one."""
    first = (F.nullif(F.try_element_at(F.col(f"`{c}`"), F.lit(1)).getField("_url"), F.lit("")) for c in (content, thumbnail))
    return F.coalesce(*first)


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The feeds of a registry that are switched on: a JSON array in one file or more, or a feed in each of their ``lines``."""
    return enabled_feeds(spark.read.schema(REGISTRY).option("multiLine", not lines).json(path))


def collected(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """Articles read from the folders of their feeds (``feed``), with their feed's name, category and country; those of feeds
    that aren't in the registry, or are switched off, are left out."""
    feeds = registry.select(F.col("slug").alias("feed"), F.col("name").alias("source_name"), "category", F.coalesce("country", F.lit("Global")).alias("country"))
    return articles.withColumn("feed", F.col("feed").cast("string")).join(feeds, "feed")


def read_feed(spark: SparkSession, path: str, as_of: str, stream: bool = False) -> DataFrame:
    """Articles of feed files, as a batch or as a stream."""
    reader = (spark.readStream if stream else spark.read).format("xml").schema(ITEM).option("rowTag", "item")
    rows = reader.load(path)
    by = [c for c in rows.columns if c == "feed"]
    rows = rows.select(
        F.col("title"), F.col("link").alias("article_url"), publication_time(F.col("pubDate"), F.lit(as_of).cast("timestamp")).alias("published_at"),
        F.coalesce("description", F.lit("")).alias("summary"), image_of().alias("image_url"), *by,
    )
    return drop_incomplete(rows)


def enabled_feeds(registry: DataFrame) -> DataFrame:
    """A registry's feeds that aren't switched off; RSS where no type is given."""
    return registry.where("coalesce(enabled, true)").withColumn("type", F.coalesce("type", F.lit("rss")))
