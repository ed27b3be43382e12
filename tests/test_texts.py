"""What is found once for each text, and the sizes that plans go by."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from presswork import registry
from presswork.operators import posts
from presswork.plans import stories as plan


def _written(spark, tmp_path, n):
    """Orders in a folder of their own: their texts repeat."""
    path = str(tmp_path / "data")
    rows = spark.range(n).selectExpr("id as o_orderkey", "id % 4 as o_custkey", "cast(id % 50 * 1000.0 as double) as o_totalprice", "'O' as o_orderstatus", "id % 3 as other")
    rows.write.parquet(f"{path}/orders.parquet")
    return path


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_processed_once(spark, tmp_path):
    path = _written(spark, tmp_path, 600)
    whole = plan.stories(spark, path)
    rows = plan.process(plan.articles(spark, path).withColumn("source_count", F.lit(1)))
    assert set(rows.columns) | {"text_id"} == set(whole.columns)
    assert whole.select(rows.columns).exceptAll(rows).isEmpty() and rows.exceptAll(whole.select(rows.columns)).isEmpty()
    firsts = whole.groupBy("title", "summary").agg(F.min("article_id").alias("low"), F.max("text_id").alias("t"), F.min("text_id").alias("s"))
    assert firsts.where("low <> t or low <> s").isEmpty()
    # The patterns of titles stand behind the grouping by text, so they meet each text once.
    text = whole.select("event_type")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"AS event_type#", text).start() < text.index("Aggregate [title")


@pytest.mark.parametrize("query", ["company_conflict", "append_sources", "choose_primary", "collection_summary", "dedup_hash", "source_counts", "exact_apply_plan"])
def test_pruned_columns_of_large_tables_are_not_broadcast(spark, tmp_path, query):
    """A table's few columns count as its whole files, not as their share of the row's width, so none is sent through the driver."""
    path = _written(spark, tmp_path, 4000)
    registry._slim(spark, path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(20_000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "BroadcastHashJoin" not in _executed(registry.QUERIES[query](spark, path))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_candidates_are_compared_once_for_each_text(spark, tmp_path):
    path = _written(spark, tmp_path, 600)
    texts = registry.post_candidates(spark, path)
    every = registry.QUERIES["compose_post"](spark, path)
    members = registry._slim(spark, path, "title", "summary")
    assert texts.select("article_id").distinct().count() < every.select("article_id").distinct().count()
    both = every.join(members, "article_id").groupBy("title", "summary", "strategy").agg(F.count_distinct("post").alias("posts"), F.count("*").alias("n"))
    all_of = members.groupBy("title", "summary").agg(F.count("*").alias("all"))
    assert both.join(all_of, ["title", "summary"]).where('posts <> 1 or n <> "all"'.replace('"', "`")).isEmpty()


def test_alternates_need_no_frame_for_each_story(spark):
    """Alternates as before, from one list for each story and not one pandas frame."""
    texts = ["A deal was signed today", "A deal was signed todaY", "Markets fell on rate fears", "Why investors look at growth", "Five cities get new stores", "No more than four are kept"]
    rows = spark.createDataFrame(pd.DataFrame([(i, t, 90 - n, n, True, True) for i in (1, 2) for n, t in enumerate(texts)], columns=["article_id", "post", "quality", "position", "adds_info", "acceptable"]))
    found = posts.diverse_alternates(rows)
    assert sorted(map(tuple, found.where("article_id = 2").collect())) == [(2, 0, texts[0]), (2, 1, texts[2]), (2, 2, texts[3]), (2, 3, texts[4])]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
