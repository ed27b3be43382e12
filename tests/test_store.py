"""Merges into stored tables, names of a lexicon, and ageing."""

from __future__ import annotations

import re

from presswork.operators import lexicon, store
from presswork.plans import stories as plan
from presswork.shared import shared_path, written
from pyspark.sql import functions as F


def files(spark, path):
    return {(r.path, r.modificationTime) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "modificationTime").collect()}


def test_a_merge_rewrites_what_changes(spark):
    path = shared_path(spark, "merge-test")
    old = spark.range(500).selectExpr("id", "concat('s', id) as s", "id * 2 as n")
    assert store.merge_into(path, old, "id", "2001-01-01", "load").agg(F.sum("inserted")).first()[0] == 500
    before = files(spark, path)
    new = spark.createDataFrame([(3, "new"), (4, None), (5, "s5"), (900, "added"), (900, "added")], "id long, s string")
    done = store.merge_into(path, new, "id", "2001-01-02", "second", old.schema)
    assert done.agg(F.sum("inserted"), F.sum("updated"), F.count("*")).first()[:] == (1, 1, 2)
    after = files(spark, path)
    assert len(before - after) == 2 and len(before & after) == len(before) - 2
    rows = {r.id: (r.s, r.n, str(r.created_at)[:10], str(r.updated_at)[:10]) for r in store.stored(spark, path, old.schema).collect()}
    assert len(rows) == 501 and rows[3] == ("new", 6, "2001-01-01", "2001-01-02") and rows[900] == ("added", None, "2001-01-02", "2001-01-02")
    assert rows[4] == ("s4", 8, "2001-01-01", "2001-01-01") and rows[5][3] == "2001-01-01"
    assert store.merge_into(path, new, "id", "2001-01-03", "again", old.schema).count() == 0 and files(spark, path) == after
    assert store.merge_into(path, new.limit(0), "id", "2001-01-03", "none", old.schema).count() == 0 and files(spark, path) == after
    log = store.commits(spark, path).groupBy("run").agg(F.sum("inserted").alias("i"), F.sum("updated").alias("u")).collect()
    assert {tuple(r) for r in log} == {("load", 500, 0), ("second", 1, 1)}


def test_sources_are_added_once(spark):
    path = shared_path(spark, "sources-test")
    first = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x")], "article_id long, url string, source_name string")
    store.merge_sources(path, first, "2001-01-01", "one")
    more = spark.createDataFrame([(1, "a", "other"), (1, "c", "y"), (3, "a", "y"), (3, "a", "y")], "article_id long, url string, source_name string")
    for run in ("two", "three"):
        store.merge_sources(path, more, "2001-01-02", run)
    rows = store.stored(spark, path, first.withColumn("source_id", F.lit("")).schema).select("article_id", "url", "source_name").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "x"), (3, "a", "y")]


def test_names_of_a_large_lexicon(spark):
    names = [(f"name{i} co", f"Name{i}") for i in range(100_000)] + [("acme", "Acme"), ("acme labs", "Acme Labs"), ("a&b", "A&B"), ("", "none")]
    book = spark.createDataFrame(names, "name string, shown string")
    texts = ["acme labs buys name77 co and name99999 co", "acmes and name7 company", "a&b, xa&b", "", None, "éacme acme_ acme"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("names", F.lit("x"))
    got = lexicon.tagged(frame, book, "t")
    want = [sorted({s for n, s in names[-4:] + [names[77], names[99_999], names[7]] if n and re.search(rf"\b{re.escape(n)}\b", t or "")}) for t in texts]
    assert [r.names for r in got.orderBy("i").collect()] == want and want[0] == ["Acme", "Acme Labs", "Name77", "Name99999"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("\n") < 12
    assert [r.names for r in lexicon.tagged(frame, book.limit(0), "t").collect()] == [[]] * len(texts)


def test_rescoring_reads_what_crosses_an_edge(spark, data):
    columns = ("freshness_bonus", "staleness_multiplier", "importance_score", "final_score", "status")
    stored = written(plan.stories(spark, data), "stories")
    for later in ("2001-08-01 00:00:00", "2001-08-01 00:59:59", "2001-08-02 00:00:00", "2001-09-30 12:00:00"):
        want = {tuple(r) for r in plan.stories(spark, data, later).select("article_id", *columns).collect()}
        assert {tuple(r) for r in plan.rescored(stored, plan.AS_OF, later).select("article_id", *columns).collect()} == want
    read, whole = stored.where(plan.crossing(plan.AS_OF, "2001-08-02 00:00:00")).count(), stored.count()
    print(f"{read} of {whole} stories are read again after a day")
    assert read < whole / 10
