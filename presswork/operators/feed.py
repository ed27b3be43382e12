"""Feed queries, counters and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 100
BANDS = {"high": "final_score >= 75", "medium": "final_score >= 40 and final_score < 75", "low": "final_score < 40"}
HIDDEN = ("REJECTED", "FILTERED", "MERGED")


def feed(df: DataFrame, status: str = "all", category: str | None = None, priority: str | None = None, sort: str = "score", offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of stories; ``status`` all: none of HIDDEN, any: every one, else equal. Ties go by id."""
    if status == "all":
        df = df.where(~F.col("status").isin(*HIDDEN))
    elif status != "any":
        df = df.where(F.col("status") == status)
    if category:
        df = df.where(F.col("category") == category)
    if priority:
        df = df.where(BANDS[priority])
    orders = {
        "score": [F.desc("final_score"), F.desc("published_at")],
        "newest": [F.desc("published_at")],
        "sources": [F.desc(F.coalesce("source_count", F.lit(1))), F.desc("published_at")],
    }
    return df.orderBy(*orders[sort], "article_id").offset(offset).limit(limit)


def feed_stats(stories: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of counters."""
    seen, shown = ~F.col("status").isin("REJECTED", "MERGED"), ~F.col("status").isin(*HIDDEN)
    counts = stories.agg(
        F.count_if(seen).alias("unique_events"),
        F.count_if(shown & (F.col("final_score") >= 75)).alias("high_priority"),
        F.count_if(shown & (F.col("final_score") >= 40) & (F.col("final_score") < 75)).alias("medium_priority"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"),
    )
    one = F.lit(1).alias("one")
    return counts.select("*", one).join(sources.agg(F.count("*").alias("total_articles")).select("*", one), "one").drop("one")


def research_queue(stories: DataFrame, reports: DataFrame, limit: int) -> DataFrame:
    """Stories worth research that have no running or finished report."""
    done = reports.where(F.col("status").isin("COMPLETED", "RESEARCHING", "NEEDS_REVIEW")).select("article_id")
    wanted = stories.where(F.col("status").isin("NEW", "READY_FOR_REVIEW", "APPROVED") & ((F.col("importance_score") >= 70) | (F.col("postability_score") >= 75)))
    return wanted.join(done, "article_id", "left_anti").orderBy(F.desc("final_score"), F.desc("published_at"), "article_id").limit(limit)


def apply_actions(stories: DataFrame, actions: DataFrame) -> DataFrame:
    """Status after the last action (by time, then id) on each story; others stay."""
    last = actions.groupBy("article_id").agg(F.max(F.struct("ts", "event_id", "new_status")).alias("last"))
    return stories.join(last, "article_id", "left").withColumn("status", F.coalesce("last.new_status", "status")).drop("last")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A new snapshot: rows of ``new`` replace those of ``old`` with the key, value by value where they aren't null."""
    a, b = old.alias("a"), new.alias("b")
    columns = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}").alias(c) for c in old.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*columns)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent in ``new`` are replaced by its rows."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def scan_new(stories: DataFrame) -> DataFrame:
    """Stories that no stage has taken up."""
    return stories.where("status = 'NEW'")


def cache_reuse(wanted: DataFrame, held: DataFrame, force: bool = False) -> DataFrame:
    """``wanted(report_id, url, content)`` with ``action`` and ``status``: a source that is held complete for the same report and
    address is reused, unless forced; others are extracted, complete with the content's digest or, without content, failed.
    """
    done = held.where("extraction_status = 'COMPLETED'").groupBy("report_id", "url").agg(F.min("content_hash").alias("held_hash"), F.lit(True).alias("known"))
    rows = wanted.join(done, ["report_id", "url"], "left").withColumn("reuse", F.coalesce("known", F.lit(False)) & F.lit(not force))
    text = F.coalesce("content", F.lit(""))
    return rows.select(
        "report_id", "url", F.when(F.col("reuse"), "REUSE").otherwise("EXTRACT").alias("action"),
        F.when(F.col("reuse") | (text != ""), "COMPLETED").otherwise("FAILED").alias("status"),
        F.when(F.col("reuse"), F.col("held_hash")).when(text != "", F.md5(text)).alias("content_hash"),
    )


def regenerate_guard(stories: DataFrame, drafts: DataFrame, force: bool = False) -> DataFrame:
    """``(story_id, draft_id, action)``: drafts that a person has edited or posted are kept unless forced, others replaced under
    their id; stories without one get a new draft."""
    kept = F.col("status").isin("EDITED", "POSTED") & F.lit(not force)
    action = F.when(F.col("draft_id").isNull(), "CREATE").when(kept, "KEEP").otherwise("REPLACE")
    return stories.join(drafts, "story_id", "left").select("story_id", "draft_id", action.alias("action"))
