"""The sweep over stored stories and the founders of events, against sequential versions and all pairs."""

from __future__ import annotations

import datetime
import difflib
import random

import pytest
from presswork.functions.rules import CLUSTERABLE
from presswork.operators import dedup, events, reconcile
from presswork.plans import stories as plan
from pyspark.sql import functions as F

DAY = datetime.datetime(2001, 1, 1)
STORY = "article_id long, published_at timestamp, status string, plain_title string, real_companies array<string>, clean_url string, content_hash string, event_type string, final_score int"


def similar(a, b):
    return bool(a and b) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8


def conflict(a, b):
    return bool(a.real_companies and b.real_companies and not set(a.real_companies) & set(b.real_companies))


def same_event(a, b):
    return a.event_type == b.event_type and a.event_type in CLUSTERABLE and bool(set(a.real_companies) & set(b.real_companies)) and abs(a.published_at - b.published_at) <= datetime.timedelta(days=7)


def all_pairs(rows):
    """Every match, by the rules as they stand, with its reason."""
    ordered = sorted((r for r in rows if r.status not in ("REJECTED", "MERGED")), key=lambda r: (-r.final_score, -r.published_at.timestamp(), r.article_id))
    found = {}
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if abs((a.published_at - b.published_at).days) > 7 or conflict(a, b):
                continue
            for reason, holds in (("url", a.clean_url and a.clean_url == b.clean_url), ("hash", a.content_hash and a.content_hash == b.content_hash), ("similar", similar(a.plain_title, b.plain_title)), ("event", same_event(a, b))):
                if holds:
                    later, earlier = sorted((a, b), key=lambda r: (r.published_at, r.article_id), reverse=True)
                    found[later.article_id, earlier.article_id] = reason
                    break
    return found


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


WORDS = ["funding round", "second round", "price band", "profit rises", "profit falls"]


def made(seed, n=160, days=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        companies = rng.choice([[], ["x"], ["y"], ["x", "y"], ["z"]])
        title = f"{rng.choice(['acme', 'zepto', 'omega'])} {rng.choice(WORDS)} {rng.randrange(40)}"
        at = DAY + datetime.timedelta(seconds=rng.choice([rng.randrange(days * 86400), 86400 * rng.randrange(days)]))
        rows.append((i, at, rng.choice(["NEW"] * 9 + ["REJECTED"]), title, companies, f"u{rng.randrange(n // 2)}", f"h{rng.randrange(n // 2)}", rng.choice(["OTHER", "OTHER", "FUNDING", "EARNINGS"]), rng.randrange(4)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, seed):
    frame = spark.createDataFrame(made(seed), STORY).repartition(3)
    want = all_pairs(frame.collect())
    got = {(r.article_id, r.earlier_id): r.reason for r in reconcile.reconcile_pairs(frame).collect()}
    assert got.items() <= want.items()
    assert components(got) == components(want)


def test_windows_and_conflicts_do_not_break_chains(spark):
    def row(i, days, companies, url=None, digest=None, title=None, score=0):
        return (i, DAY + datetime.timedelta(days=days), "NEW", title or f"{'abcdefghij'[i] * 9}", companies, url or f"u{i}", digest or f"h{i}", "OTHER", score)

    cases = {
        "one address on days 1, 21, 23": ([row(1, 1, [], "u"), row(2, 21, [], "u"), row(3, 23, [], "u")], {(3, 2): "url"}),
        "companies x, y, y with one hash": ([row(1, 0, ["x"], digest="h"), row(2, 1, ["y"], digest="h"), row(3, 2, ["y"], digest="h")], {(3, 2): "hash"}),
        "a day beyond, the later one first": ([row(1, 0, [], "u"), row(2, 7.5, [], "u", score=9)], {(2, 1): "url"}),
        "a day beyond, the earlier one first": ([row(1, 0, [], "u", score=9), row(2, 7.5, [], "u")], {}),
        "none": ([], {}),
    }
    for rows, want in cases.values():
        got = {(r.article_id, r.earlier_id): r.reason for r in reconcile.reconcile_pairs(spark.createDataFrame(rows, STORY)).collect()}
        assert got == want == all_pairs(spark.createDataFrame(rows, STORY).collect())


def test_a_hot_key_gives_few_links(spark):
    rows = [(i, DAY + datetime.timedelta(minutes=i), "NEW", "same title", [["x"], ["y"], []][i % 3], "u", "h", "FUNDING", 0) for i in range(3000)]
    got = reconcile.reconcile_pairs(spark.createDataFrame(rows, STORY)).collect()
    assert len(got) < 5 * len(rows) and set(components([(r.article_id, r.earlier_id) for r in got]).values()) == {0}


def test_merge_unites_sources(spark):
    at = DAY
    stories = spark.createDataFrame([(1, at, "NEW", "a", 2, 1), (2, at, "NEW", "b", 1, 2), (3, at, "APPROVED", "c", 3, 1), (4, at, "NEW", "d", 1, 1)], "article_id long, published_at timestamp, status string, article_url string, tier int, source_count int").withColumns({"source_name": F.col("article_url"), "title": F.col("article_url")})
    pairs = spark.createDataFrame([(2, 1, "url"), (3, 2, "event")], "article_id long, earlier_id long, reason string")
    merges = reconcile.plan_merges(stories, pairs)
    assert sorted(map(tuple, merges.collect())) == [(1, 2, 3, "url"), (2, 2, 3, None), (3, 2, 3, "event")]
    after = {r.article_id: (r.status, r.merged_into_id) for r in reconcile.merged_stories(stories, merges).collect()}
    assert after == {1: ("MERGED", 2), 2: ("NEW", None), 3: ("MERGED", 2), 4: ("NEW", None)}
    sources = spark.createDataFrame([(1, "s", "p"), (1, "s", "q"), (2, "t", "q"), (2, "t", "r"), (3, "v", "p")], "article_id long, source_name string, url string").withColumns({"published_at": F.lit(at), "title": F.lit("x")})
    got = sorted((r.article_id, r.url, r.source_name) for r in reconcile.united_sources(sources, stories, merges).collect())
    assert got == [(1, "p", "s"), (1, "q", "s"), (2, "a", "a"), (2, "c", "c"), (2, "p", "s"), (2, "q", "t"), (2, "r", "t"), (3, "p", "v")]


# --- founders ---


def one_by_one(rows):
    """Articles in their order, each to the founder it matches."""
    out, founders, urls, hashes = {}, [], {}, {}
    for r in sorted(rows, key=lambda r: (r.published_at, r.article_id)):
        found = (urls[r.clean_url], 2) if r.clean_url in urls else (hashes[r.content_hash], 3) if r.content_hash in hashes else None
        near = [f for f in reversed(founders) if r.published_at - f.published_at <= datetime.timedelta(days=7) and not conflict(r, f)] if not found else []
        found = found or next(((f.article_id, 4) for f in near if similar(r.plain_title, f.plain_title)), None) or next(((f.article_id, 5) for f in near if same_event(r, f)), None)
        out[r.article_id] = found or (r.article_id, None)
        if not found:
            founders.append(r)
            urls[r.clean_url] = hashes[r.content_hash] = r.article_id
    return out


def test_events_do_not_drift(spark):
    rows = [(i, DAY + datetime.timedelta(days=6 * i), "NEW", f"{'abcde'[i] * 12} zepto", ["zepto"], f"u{i}", f"h{i}", "FUNDING", 0) for i in range(5)]
    got = {r.article_id: (r.event_id, r.level) for r in events.assign_events(spark.createDataFrame(rows, STORY)).collect()}
    assert got == {0: (0, None), 1: (0, 5), 2: (2, None), 3: (2, 5), 4: (4, None)}


@pytest.mark.parametrize("seed,last", [(5, 0), (6, 20), (7, 2048)])
def test_founders_are_those_of_a_sequence(spark, monkeypatch, seed, last):
    monkeypatch.setattr(events, "LAST", last)  # none, few or all are taken one by one
    frame = spark.createDataFrame(made(seed, 120, 30), STORY).repartition(3)
    got, rounds = events.founders_of(frame)
    assert {r.article_id: (r.event_id, r.level) for r in got.collect()} == one_by_one(frame.collect()) and rounds < 40
    assert events.founders_of(frame.limit(0))[0].count() == 0


def test_founders_of_stories(spark, data):
    frame = plan.stories(spark, data).select("article_id", "published_at", "clean_url", "content_hash", "plain_title", "event_type", "real_companies")
    got, rounds = events.founders_of(frame)
    found = {r.article_id: (r.event_id, r.level) for r in got.collect()}
    assert found == one_by_one(frame.collect())
    print(f"{rounds} rounds for {len(found)} articles, {sum(e == i for i, (e, _) in found.items())} founders")
