"""Deduplication, clusters, feeds, pages and the streaming job."""

from __future__ import annotations

import datetime
import difflib
import json
import random

import numpy as np
import pytest
from presswork import registry
from presswork.operators import dedup, events, feed, reconcile, similar
from presswork.operators.components import connected_components
from presswork.plans import stories as plan
from presswork.shared import shared_path, written
from presswork.sources import feeds, pages
from presswork.streaming import ingest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture(scope="module")
def stories(spark, data):
    return plan.stories(spark, data).select("article_id", "published_at", "clean_url", "content_hash", "plain_title", "event_type", "real_companies", "tier", "source_count").cache()


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(240)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_event_links(stories):
    rows = sorted(stories.collect(), key=lambda r: (r.published_at, r.article_id))
    want = {}
    for i, r in enumerate(rows):
        for e in reversed(rows[:i]):
            if r.published_at - e.published_at > datetime.timedelta(days=7):
                break
            if r.event_type == e.event_type and r.event_type in dedup.CLUSTERABLE and set(r.real_companies) & set(e.real_companies):
                want[r.article_id] = e.article_id
                break
    assert {r.article_id: r.earlier_id for r in dedup.event_links(stories).collect()} == want


def test_common_letters_are_the_longest_common_subsequence():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            before = 0
            for j, other in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if c == other else max(row[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc "), size)) for size in rng.integers(1, 150, 120)]
    pairs = list(zip(texts, reversed(texts)))
    new, old = (np.array(side) for side in zip(*pairs))
    assert similar.common_letters(new, old).tolist() == [longest(a, b) for a, b in pairs]


def test_similar_titles(stories):
    few = stories.where("article_id % 5 = 0")
    titles = sorted({(r.plain_title, int(r.published_at.replace(tzinfo=datetime.timezone.utc).timestamp() // (7 * 86400))) for r in few.collect()})
    want = {(a, b) for a, i in titles for b, j in titles if a != b and 0 <= i - j <= 1 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert {(r.title, r.earlier_title) for r in similar.similar_titles(few).collect()} == want


def test_duplicates_keep_their_level(stories):
    rows = dedup.find_duplicates(stories).collect()
    assert {r.level for r in rows} <= {2, 3, 4, 5} and len({r.article_id for r in rows}) == len(rows)
    hashes = {r.article_id for r in dedup.first_of(stories, "content_hash").collect()}
    assert hashes <= {r.article_id for r in rows if r.level <= 3}


def test_clusters(stories):
    clusters = dedup.exact_clusters(stories)
    sizes = dedup.choose_primary(clusters.join(stories, "article_id"))
    assert sizes.where("size < 2").count() == 0 and sizes.agg(F.sum("size")).first()[0] == clusters.count()
    again = dedup.exact_clusters(stories.repartition(7, F.rand(3)))
    assert {tuple(r) for r in clusters.collect()} == {tuple(r) for r in again.collect()}


def test_plan_joins_address_and_hash(spark):
    at = datetime.datetime(2001, 1, 1)
    rows = [(i, at + datetime.timedelta(hours=i), u, h, t, 1, "NEW") for i, (u, h, t) in enumerate([("a", "x", 2), ("a", "y", 1), ("b", "y", 3), ("c", "z", 1)])]
    frame = spark.createDataFrame(rows, "article_id long, published_at timestamp, clean_url string, content_hash string, tier int, source_count int, status string")
    assert sorted((r.article_id, r.primary_id, r.size) for r in registry.merge_plan(frame).where("size > 1").collect()) == [(0, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert registry.merge_plan(frame).count() == 4


def test_feed(spark):
    at = datetime.datetime(2001, 1, 1)
    rows = [(i, s, c, f, at + datetime.timedelta(hours=i), n) for i, (s, c, f, n) in enumerate([("NEW", "IPO", 80, 1), ("REJECTED", "IPO", 99, 1), ("FILTERED", "TECH", 20, 2), ("APPROVED", "TECH", 60, 3), ("MERGED", "IPO", 70, None)])]
    frame = spark.createDataFrame(rows, "article_id long, status string, category string, final_score int, published_at timestamp, source_count int")
    ids = lambda **k: [r.article_id for r in feed.feed(frame, **k).collect()]
    assert ids() == [0, 3] and ids(status="any") == [1, 0, 4, 3, 2] and ids(status="REJECTED") == [1]
    assert ids(category="TECH") == [3] and ids(priority="high") == [0] and ids(sort="newest", status="any", limit=2) == [4, 3] and ids(sort="sources") == [3, 0] and ids(offset=1) == [3]
    stats = feed.feed_stats(frame, frame).first()
    assert (stats.total_articles, stats.unique_events, stats.high_priority, stats.medium_priority, stats.rejected) == (5, 3, 1, 1, 1)


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int"), spark.createDataFrame([(2, None), (3, "c")], "id int, s string")
    once = feed.upsert(old, new, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    assert sorted(map(tuple, feed.upsert(once, new, "id").collect())) == sorted(map(tuple, once.collect()))


def test_page_text():
    page = "<html><body><nav>menu</nav><div class='x'>side</div><article><h1>T</h1><p>One &amp; <b>two</b></p><script>x</script><p> </p><p>three</p></article><footer>f</footer></body></html>"
    assert pages.page_text(page) == "One & two\nthree"
    assert pages.page_text("<body><div class='my-content'>a<br>b</div>c</body>") == "a\nb"
    assert pages.page_text("<body>just <i>text</i></body>") == "just\ntext"
    assert pages.page_text("no tags") is None and pages.page_text("") is None


def test_feeds_of_a_registry_file(spark, tmp_path):
    (tmp_path / "sources.json").write_text(json.dumps([{"slug": "a", "name": "A", "url": "u", "category": "IPO"}, {"slug": "b", "name": "B", "url": "v", "enabled": False}, {"slug": "c", "name": "C", "type": "google_news", "enabled": True, "country": "India", "priority": 1}], indent=2))
    registry = feeds.read_registry(spark, f"file://{tmp_path}/sources.json")
    assert [(r.name, r.type) for r in registry.orderBy("name").collect()] == [("A", "rss"), ("C", "google_news")]
    articles = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", "t3"), ("d", "t4")], "feed string, title string").withColumns({"article_url": F.col("title"), "published_at": F.lit(DAY), "summary": F.lit("s")})
    path = shared_path(spark, "by-feed")
    feeds.write_feed(articles, path)
    got = feeds.collected(feeds.read_feed(spark, path, plan.AS_OF), registry).collect()
    assert sorted((r.title, r.source_name, r.category, r.country) for r in got) == [("t1", "A", "IPO", "Global"), ("t3", "C", None, "India")]


def test_images_of_items(spark):
    rows = [("both", "c", "t"), ("thumb", None, "t&\"<"), ("empty", "", "t"), ("none", None, None)]
    frame = spark.createDataFrame(rows, "title string, content_url string, thumbnail_url string").withColumns({"article_url": F.col("title"), "published_at": F.lit(DAY), "summary": F.lit("a < b & c")})
    path = shared_path(spark, "media")
    feeds.write_feed(frame.coalesce(2), path)
    got = feeds.read_feed(spark, path, plan.AS_OF).collect()
    assert {r.title: r.image_url for r in got} == {"both": "c", "thumb": "t&\"<", "empty": "t", "none": None} and {r.summary for r in got} == {"a < b & c"}


def test_feed_times(spark):
    texts = ["Tue, 31 Jul 2001 23:00:00 +0530", "31 Jul 2001 10:00:00 GMT", "2001-07-31T10:00:00+00:00", "nonsense", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", feeds.publication_time(F.col("t"), F.lit(plan.AS_OF).cast("timestamp")).cast("string").alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == ["2001-07-31 17:30:00", "2001-07-31 10:00:00", "2001-07-31 10:00:00", plan.AS_OF, plan.AS_OF]


def test_streaming_equals_batch_and_survives_replay(spark, data):
    path, table, log = (shared_path(spark, n) for n in ("feed", "table", "log"))
    articles = plan.articles(spark, data)
    feeds.write_feed(articles.where("article_id % 2 = 0"), f"{path}/1")
    ingest.exact_dedup_stream(feeds.read_feed(spark, f"{path}/*", plan.AS_OF, stream=True), table, log)
    feeds.write_feed(articles.where("article_id % 2 = 1"), f"{path}/2")
    ingest.exact_dedup_stream(feeds.read_feed(spark, f"{path}/*", plan.AS_OF, stream=True), table, log)
    rows = ingest.stored(spark, table).select("clean_url", "content_hash").collect()
    assert len({r.clean_url for r in rows}) == len({r.content_hash for r in rows}) == len(rows)
    ingest.exact_dedup_stream(feeds.read_feed(spark, f"{path}/*", plan.AS_OF, stream=True), table, log)
    assert ingest.stored(spark, table).count() == len(rows)


DAY = datetime.datetime(2001, 1, 1)


def _greedy(rows):
    """Rows that share neither key with an earlier one that stays."""
    kept, urls, hashes = [], set(), set()
    for row in rows:
        if row[1] not in urls and row[2] not in hashes:
            kept.append(row)
            urls.add(row[1])
            hashes.add(row[2])
    return kept


def test_first_seen(spark):
    random.seed(8)
    rows = [(i, f"u{random.randrange(60)}", f"h{random.randrange(60)}") for i in range(400)]
    for table in (rows, [(0, "u1", "x"), (1, "u2", "x"), (2, "u2", "y")], []):
        frame = spark.createDataFrame(table, "at int, clean_url string, content_hash string").repartition(3)
        assert sorted(map(tuple, ingest.first_seen(frame, ["at"]).collect())) == _greedy(table)


def test_stream_does_not_depend_on_batches(spark):
    rows = [("A", "https://a.b/1", "one title"), ("B", "https://a.b/2", "one title"), ("C", "https://a.b/2", "another title"), ("D", "https://a.b/1", "third title")]
    frame = spark.createDataFrame([(i, t, u, DAY + datetime.timedelta(hours=i), "") for i, (_, u, t) in enumerate(rows)], "i int, title string, article_url string, published_at timestamp, summary string")
    found = []
    for cuts in ([4], [1, 2, 3, 4], [2, 4]):
        path, table, log = (shared_path(spark, n) for n in ("feed", "table", "log"))
        for k, (low, high) in enumerate(zip([0, *cuts], cuts)):
            feeds.write_feed(frame.where(f"i >= {low} and i < {high}").coalesce(1), f"{path}/{k}")
            ingest.exact_dedup_stream(feeds.read_feed(spark, f"{path}/*", plan.AS_OF, stream=True), table, log)
        found.append(sorted((r.article_url, r.title) for r in ingest.stored(spark, table).collect()))
    assert found == [[("https://a.b/1", "one title"), ("https://a.b/2", "another title")]] * 3


def test_a_chain_settles_by_doubling(spark, monkeypatch):
    """A thousand rows, each of which shares its address with the row before and its hash with the row after, or the other way round."""
    rows = [(i, f"u{(i + 1) // 2}", f"h{i // 2}") for i in range(1000)]
    made = []
    monkeypatch.setattr(ingest, "written", lambda df, name: made.append(name) or written(df, name))
    frame = spark.createDataFrame(rows, "at int, clean_url string, content_hash string").repartition(3)
    assert sorted(map(tuple, ingest.first_seen(frame, ["at"]).collect())) == _greedy(rows)
    assert made.count("first-left") == 1 and made.count("first-chains") <= 13


def test_streams_of_events_and_titles_equal_batches(spark, data):
    articles = plan.articles(spark, data).where("article_id % 3 = 0")
    edges = ["timestamp '1999-01-01'", "timestamp '2001-05-10 00:00:00'", "timestamp '2001-05-30 00:00:00'", "timestamp '2003-01-01'"]
    path, table, titles, links, *logs = (shared_path(spark, n) for n in ("feed", "table", "titles", "links", "log", "log"))
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        feeds.write_feed(articles.where(f"published_at >= {low} and published_at < {high}"), f"{path}/{k}")
        ingest.title_match_stream(feeds.read_feed(spark, f"{path}/*", plan.AS_OF, stream=True), table, titles, logs[0])
        ingest.event_match_stream(feeds.read_feed(spark, f"{path}/*", plan.AS_OF, stream=True), links, logs[1])
    whole = ingest.stored(spark, table)
    for want, found in ((dedup.event_links(whole), links), (dedup.similar_links(whole), titles)):
        want = {tuple(r) for r in want.collect()}
        assert want and {(r.article_id, r.earlier_id) for r in ingest.stored(spark, found).collect()} == want


STORY = "article_id long, published_at timestamp, status string, plain_title string, real_companies array<string>, clean_url string, content_hash string, event_type string"


def test_events_and_pairs(spark):
    def row(i, hours, title, company, event="OTHER", url=None, status="NEW"):
        return (i, DAY + datetime.timedelta(hours=hours), status, title, [company] if company else [], url or f"u{i}", title, event)

    rows = [
        row(1, 0, "zepto raises ten million in a funding round", "zepto", "FUNDING"),
        row(2, 1, "zepto raises ten million in the funding round", "zepto", "FUNDING"),
        row(3, 2, "investors back zepto", "zepto", "FUNDING"),
        row(4, 3, "infosys raises ten million in a funding round", "infosys", "FUNDING"),
        row(5, 300, "zepto gets more money", "zepto", "FUNDING"),
        row(6, 4, "something else", None, url="u1"),
        row(7, 5, "rejected words", "zepto", "FUNDING", status="REJECTED"),
        row(8, 6, "conflicting words", "paytm", url="u1"),
    ]
    frame = spark.createDataFrame(rows, STORY)
    pairs = {(r.article_id, r.earlier_id): r.reason for r in reconcile.reconcile_pairs(frame).collect()}
    assert pairs == {(2, 1): "similar", (3, 2): "event", (6, 1): "url", (8, 6): "url"}
    placed = {r.article_id: (r.event_id, r.level) for r in events.assign_events(frame).collect()}
    assert placed == {1: (1, None), 2: (1, 4), 3: (1, 5), 4: (4, None), 5: (5, None), 6: (1, 2), 7: (1, 5), 8: (1, 2)}


def test_cache_and_drafts(spark):
    wanted = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", ""), (2, "c", None)], "report_id int, url string, content string")
    held = spark.createDataFrame([(1, "a", "COMPLETED", "h"), (1, "b", "FAILED", None)], "report_id int, url string, extraction_status string, content_hash string")
    got = {(r.report_id, r.url): (r.action, r.status) for r in feed.cache_reuse(wanted, held).collect()}
    assert got == {(1, "a"): ("REUSE", "COMPLETED"), (1, "b"): ("EXTRACT", "COMPLETED"), (2, "a"): ("EXTRACT", "FAILED"), (2, "c"): ("EXTRACT", "FAILED")}
    assert {r.action for r in feed.cache_reuse(wanted, held, force=True).collect()} == {"EXTRACT"}
    stories, drafts = spark.createDataFrame([(1,), (2,), (3,)], "story_id int"), spark.createDataFrame([(1, 10, "POSTED"), (2, 20, "NEW")], "story_id int, draft_id int, status string")
    assert {r.story_id: r.action for r in feed.regenerate_guard(stories, drafts).collect()} == {1: "KEEP", 2: "REPLACE", 3: "CREATE"}
    assert {r.story_id: r.action for r in feed.regenerate_guard(stories, drafts, True).collect()} == {1: "REPLACE", 2: "REPLACE", 3: "CREATE"}


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0].final_score >= rows[-1].final_score
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
