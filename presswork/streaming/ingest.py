"""Incremental jobs over landed files: each batch is deduplicated against all that came before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from presswork.functions.dialect import SPARK
from presswork.functions.rules import CLUSTERABLE
from presswork.operators.dedup import similar_links
from presswork.operators.similar import DAY, LOOKBACK_DAYS
from presswork.plans.stories import layers, process, processed_texts
from presswork.shared import written


def keyed(df: DataFrame) -> DataFrame:
    """Articles with their canonical address and title hash."""
    base, url, joined, words = layers(SPARK)[:4]
    df = df.select("*", F.expr(base["plain_title"]).alias("plain_title"))
    for layer in (url, joined, words):
        df = df.select("*", *(F.expr(e).alias(n) for n, e in layer.items()))
    return df.withColumn("content_hash", F.md5("no_stopwords")).drop("url_host", "url_path", "url_query", "plain_title", "no_stopwords")


def _marked(left: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """Undecided rows with the first and second of each of their keys."""
    out = left.select("__id", "__at", *keys)
    for n, key in enumerate(keys):
        first = left.groupBy(key).agg(F.min(F.struct("__at", "__id")).alias(f"first{n}"))
        out = out.join(first, key)
        second = out.where(f"__id <> first{n}.__id").groupBy(key).agg(F.min(F.struct("__at", "__id")).alias(f"second{n}"))
        out = out.join(second, key, "left")
    return out


def first_seen(rows: DataFrame, order: list[str], keys: tuple[str, str] = ("clean_url", "content_hash")) -> DataFrame:
    """Of rows in ``order``, those that share neither key with an earlier one that stays.

    A row that is first by both keys stays; those that share a key with it go; so on with the rest. A row that is first by one key
    and second by the other stays if and only if the first of that other key goes; chains of such rows are followed to their ends
    by doubling, so a chain of a thousand rows takes ten steps and not a thousand rounds. A round is grouped minima and joins;
    what it decides is written, so what is left shrinks. Rows that equal in both keys meet first, and the first of them goes on.
    """
    at = F.struct(*order, *keys)
    firsts = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), at).alias("row")).select("row.*")
    firsts = written(firsts.withColumn("__at", at).withColumn("__id", F.monotonically_increasing_id()), "first-rows")
    left, stay = firsts, None
    while not left.isEmpty():
        marked = _marked(left, keys)
        lead = "__id = first0.__id and __id = first1.__id"
        before = "case when __id = first0.__id and __id = second1.__id then first1.__id when __id = first1.__id and __id = second0.__id then first0.__id end"
        marked = written(marked.selectExpr("__id", f"{lead} as lead", f"case when not ({lead}) then {before} end as before"), "first-marks")
        chain = written(marked.where("before is not null").selectExpr("__id", "before as end", "1 as steps"), "first-chains")
        while True:
            on = chain.selectExpr("__id as end", "end as further", "steps as more")
            longer = written(chain.join(on, "end", "left").selectExpr("__id", "coalesce(further, end) as end", "steps + coalesce(more, 0) as steps", "more is not null as moved"), "first-chains")
            chain = longer.drop("moved")
            if longer.where("moved").isEmpty():
                break
        leads = marked.where("lead").select("__id")
        even = chain.where("steps % 2 = 0").join(leads.withColumnRenamed("__id", "end"), "end", "left_semi").select("__id")
        kept = written(left.join(leads.union(even), "__id", "left_semi"), "first-kept")
        stay = kept if stay is None else stay.unionByName(kept)
        for key in keys:
            left = left.join(kept.select(key), key, "left_anti")
        left = written(left, "first-left")
    return (firsts if stay is None else stay).select(*rows.columns)


#: Buckets that stored keys are dealt into.
KEY_BUCKETS = 64


def _bucketed(keyed_rows: DataFrame) -> DataFrame:
    """``(kind, key, bucket)`` of rows with both keys."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("clean_url", "content_hash")))
    return keyed_rows.select(F.explode(kinds).alias("k")).select("k.*").withColumn("bucket", F.expr(f"cast(pmod(xxhash64(kind, key), {KEY_BUCKETS}) as int)"))


def exact_dedup_stream(articles: DataFrame, table: str, checkpoint: str) -> None:
    """Append each article that shares neither address nor title hash with one that was kept before, to a Parquet table; run
    to the end of the input.

    Within a batch the order is by time, address and title; if batches come in that order too, the result doesn't depend
    on how they are cut. A batch is written to its own folder by overwriting, so a batch that is run again changes nothing.
    The keys of kept articles are stored apart, by buckets; a batch reads those buckets only that its own keys fall in.
    """
    spark, keys = articles.sparkSession, f"{table}-keys"

    def add(batch: DataFrame, number: int) -> None:
        rows = written(keyed(batch), "stream-batch")
        if number and not rows.isEmpty():
            hit = [r.bucket for r in _bucketed(rows).select("bucket").distinct().collect()]  # KEY_BUCKETS at most
            seen = spark.read.option("basePath", keys).parquet(f"{keys}/batch=*").where(F.col("bucket").isin(hit) & (F.col("batch") < number))
            for kind in ("clean_url", "content_hash"):
                rows = rows.join(seen.where(F.col("kind") == kind).select(F.col("key").alias(kind)), kind, "left_anti")
        kept = first_seen(rows, ["published_at", "article_url", "title"])
        kept.write.mode("overwrite").parquet(f"{table}/batch={number}")
        kept = spark.read.schema(kept.schema).parquet(f"{table}/batch={number}")
        _bucketed(kept).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{keys}/batch={number}")

    articles.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _in_order(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (t, article_id) in their order, and which of them are new."""
    every, fresh = np.concatenate([old, new]), np.arange(len(old) + len(new)) >= len(old)
    order = np.lexsort((~fresh, every[:, 1], every[:, 0]))
    every, fresh = every[order], fresh[order]
    first = np.append(True, (every[1:] != every[:-1]).any(1))[: len(every)]
    return every[first], fresh[first]


class LastOfEvent(StatefulProcessor):
    """Of one event type and company: each article's latest earlier one within the window. Articles of the window before the
    watermark are held, by days as bytes, and a timer clears what no article can reach any more."""

    def __init__(self, days: int):
        self.window = days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "articles binary")

    def _stored(self) -> np.ndarray:
        days = [np.frombuffer(bytes(day[0]), np.int64) for day in self.held.get()] if self.held.exists() else []
        return np.concatenate([*days, np.zeros(0, np.int64)]).reshape(-1, 2)

    def _store(self, rows: np.ndarray) -> None:
        self.held.clear()
        if len(rows):
            cuts = np.flatnonzero(np.diff(rows[:, 0] // DAY)) + 1
            self.held.put([(day.tobytes(),) for day in np.split(np.ascontiguousarray(rows), cuts)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = np.concatenate([np.stack([part[c].to_numpy(np.int64) for c in ("t", "article_id")], 1) for part in rows])
        every, fresh = _in_order(self._stored(), new)
        t = every[:, 0]
        at = np.flatnonzero(fresh[1:] & (np.diff(t) <= self.window)) + 1
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        # Later articles are after the watermark: of those before it the last is enough, and what is a window older is out of reach.
        kept = every[((t >= mark) | np.append(t[1:] > mark, True)) & (t >= mark - self.window)]
        self._store(kept)
        if len(kept):
            self.handle.registerTimer(max((int(kept[-1, 0]) + self.window) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"article_id": every[at, 1], "earlier_t": every[at - 1, 0], "earlier_id": every[at - 1, 1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, rows = timerValues.getCurrentWatermarkInMs() // 1000, self._stored()
        self._store(rows[rows[:, 0] >= mark - self.window])
        return iter([])

    def close(self) -> None:
        pass


def _made(articles: DataFrame) -> DataFrame:
    """Articles with ids, hashes of address and title."""
    return articles.withColumns({"source_name": F.lit(""), "country": F.lit("Global"), "source_count": F.lit(1), "article_id": F.xxhash64("article_url", "title")})


#: What events and titles are matched by.
_MATCHED = ("article_id", "published_at", "event_type", "real_companies", "plain_title")


def _classified(articles: DataFrame) -> DataFrame:
    """What articles are matched by, row by row, as a stream can."""
    return process(_made(articles)).select(*_MATCHED)


def _classified_texts(articles: DataFrame) -> DataFrame:
    """As ``_classified``, of a table: distinct texts are classified once."""
    rows = written(_made(articles.select("title", "summary", "article_url", "published_at")), "stream-batch")
    return processed_texts(rows).select(*_MATCHED)


def classified_of(table: str) -> str:
    """Where title_match_stream lands all articles of its batches, those that came more than once too."""
    return f"{table}-classified"


def event_match_stream(articles: DataFrame, links: str, checkpoint: str, days: int = LOOKBACK_DAYS, late: str = "7 days") -> None:
    """To ``links``, each article's latest earlier article of the same event type and a shared company within the window
    (``article_id, earlier_id``), among all that have come; run to the end of the input.

    The state is keyed by event type and company and holds the window's articles; watermark and timers bound it. Articles
    that come more than ``late`` after later ones are left to the exact levels. If articles come in order of time, the links
    are those of dedup.event_links, however the input is cut into batches. ``articles`` may be classified already, as title_match_stream lands them.
    """
    spark = articles.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    classified = articles if "event_type" in articles.columns else _classified(articles)
    rows = classified.where(F.col("event_type").isin(*CLUSTERABLE)).withWatermark("published_at", late)
    each = rows.select("article_id", "published_at", F.unix_timestamp("published_at").alias("t"), "event_type", F.explode("real_companies").alias("company"))
    found = each.groupBy("event_type", "company").transformWithStateInPandas(LastOfEvent(days), "article_id long, earlier_t long, earlier_id long", "Append", "EventTime")

    def add(batch: DataFrame, number: int) -> None:
        # All companies of an article come in one batch.
        best = batch.groupBy("article_id").agg(F.max(F.struct("earlier_t", "earlier_id")).alias("b"))
        best.select("article_id", F.col("b.earlier_id").alias("earlier_id")).write.mode("overwrite").parquet(f"{links}/batch={number}")

    found.writeStream.foreachBatch(add).outputMode("Append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def title_match_stream(articles: DataFrame, table: str, links: str, checkpoint: str, days: int = LOOKBACK_DAYS) -> None:
    """Append classified articles to ``table``, by days (as they came, they land in ``classified_of(table)``), and to ``links`` each one's latest earlier article of a similar title,
    without conflict, within the window, among all that have come (``article_id, earlier_id``). Batches are written by
    overwriting; of the table a batch reads the days from a window before its earliest article to its latest."""
    spark = articles.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        _classified_texts(batch).write.mode("overwrite").parquet(f"{classified_of(table)}/batch={number}")
        every = spark.read.parquet(f"{classified_of(table)}/batch={number}")
        # Of an article that came more than once, the first.
        first = every.groupBy("article_id").agg(F.min(F.struct(*_MATCHED[1:])).alias("first"))
        rows = first.select("article_id", "first.*").withColumn("day", F.to_date("published_at"))
        rows.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{table}/batch={number}")
        new = spark.read.schema(rows.schema).parquet(f"{table}/batch={number}")
        begin, end = new.agg(F.min("day"), F.max("day")).first()
        every = new
        if number and begin is not None:
            seen = spark.read.option("basePath", table).parquet(f"{table}/batch=*").where(F.col("batch") < number)
            near = seen.where((F.col("day") >= F.date_sub(F.lit(begin), days)) & (F.col("day") <= F.lit(end)))
            every = new.unionByName(near.select(*new.columns).dropDuplicates(["article_id"]).join(new, "article_id", "left_anti"))
        similar_links(every, days, new).write.mode("overwrite").parquet(f"{links}/batch={number}")

    articles.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored_stream(spark: SparkSession, table: str) -> DataFrame:
    """Rows of a table of batches, as a stream."""
    return spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)


def stored(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The table's rows, of batches before a number if it is given."""
    if before == 0:
        return None
    rows = spark.read.parquet(table)
    return rows if before is None else rows.where(F.col("batch") < before)
