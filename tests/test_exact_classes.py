"""Clusters of the sweep's exact legs, against all pairs; equal stories go by one row."""

from __future__ import annotations

import datetime

import pytest
from presswork.operators import reconcile
from pyspark.sql import functions as F

from test_reconcile import DAY, STORY, all_pairs, components, made


def exact_pairs(rows):
    """All pairs but those of titles: each title is made another."""
    return all_pairs([type(r)(**(r.asDict() | {"plain_title": chr(33 + r.article_id) * 30})) for r in rows])


@pytest.mark.parametrize("seed", [11, 12])
def test_clusters_are_those_of_all_pairs(spark, seed):
    frame = spark.createDataFrame(made(seed, 150, 120), STORY)
    # Few days, addresses and hashes, some of them missing: cells of many stories, and gaps of seven to eight days.
    frame = frame.withColumns({"content_hash": F.expr("if(article_id % 11 = 0, '', concat('h', article_id % 40))"), "published_at": F.expr("date_trunc('day', published_at) + make_interval(0, 0, 0, 0, 12 * (article_id % 2))")})
    frame = frame.union(frame.where("article_id % 3 = 0").withColumn("article_id", F.col("article_id") + 1000).withColumn("clean_url", F.lit(""))).repartition(3)
    want = components(exact_pairs(frame.collect()))
    assert {r.article_id: r.cluster_id for r in reconcile.exact_classes(frame).collect()} == want and want


def test_equal_stories_go_by_one_row(spark, monkeypatch):
    edges, connected = [], reconcile.connected_components

    def counted(links):
        edges.append(links.count())
        return connected(links)

    monkeypatch.setattr(reconcile, "connected_components", counted)
    rows = [(i, DAY + datetime.timedelta(days=i % 3), "NEW", "t", ["x"], f"u{i % 50}", "h", "FUNDING", i % 7) for i in range(2000)]
    got = {r.article_id: r.cluster_id for r in reconcile.exact_classes(spark.createDataFrame(rows, STORY)).collect()}
    assert got == dict.fromkeys(range(2000), 0) and sum(edges) < 100
