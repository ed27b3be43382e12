"""The stream job classifies texts once, and holds articles of an event by days."""

from __future__ import annotations

import random

import pandas as pd
from presswork import registry
from presswork.operators import dedup
from presswork.plans import stories as plan
from presswork.streaming import ingest
from pyspark.sql import functions as F


class _List:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def put(self, rows):
        assert rows and all(type(day) is bytes for (day,) in rows)
        self.rows = list(rows)


class _Handle:
    def __init__(self):
        self.held, self.timers = _List(), []

    def getListState(self, name, schema):  # noqa: N802
        return self.held

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class _Times:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark * 1000


def test_last_of_event_over_batches():
    rng, day = random.Random(1), 86400
    processor, handle = ingest.LastOfEvent(7), _Handle()
    processor.init(handle)
    came, mark = set(), 0
    for n in range(12):
        # Batches go on in time and overlap by less than the watermark's delay.
        new = {(n * 3 * day + rng.randrange(8 * day) // 3600 * 3600, rng.randrange(10**6)) for _ in range(60)}
        new = {row for row in new if row[0] > mark} | ({min(came)} & {row for row in came if row[0] > mark} if came else set())
        parts = [pd.DataFrame(sorted(new, key=lambda _: rng.random()), columns=["t", "article_id"])]
        out = pd.concat(list(processor.handleInputRows(None, iter(parts), _Times(mark))))
        came |= new
        ordered, want = sorted(came), set()
        for i, row in enumerate(ordered):
            if i and row in new and row[0] - ordered[i - 1][0] <= 7 * day:
                want.add((row[1], *ordered[i - 1]))
        assert set(map(tuple, out[["article_id", "earlier_t", "earlier_id"]].itertuples(index=False))) == want
        mark = max(mark, max(t for t, _ in came) - 7 * day)
    held = processor._stored()
    list(processor.handleExpiredTimer(None, _Times(10**9), None))
    assert len(held) < len(came) and not handle.held.rows and handle.timers


def test_stream_event_match_classifies_texts_once(spark, data, monkeypatch):
    def by_row(*args):
        raise AssertionError("articles are classified one by one")

    monkeypatch.setattr(ingest, "process", by_row)
    got = {r.article_id: (r.earlier_id, r.level) for r in registry.QUERIES["stream_event_match"](spark, data).collect()}
    rows = plan.stories(spark, data).withColumn("article_id", F.xxhash64("article_url", "title"))
    first = rows.groupBy("article_id").agg(F.min(F.struct("published_at", "event_type", "real_companies", "plain_title")).alias("f")).select("article_id", "f.*")
    want = {r.article_id: (r.earlier_id, 4) for r in dedup.similar_links(first).collect()}
    assert {i: found for i, found in got.items() if found[1] == 4} == want
    assert {i for i, found in got.items() if found[1] == 5} >= {r.article_id for r in dedup.event_links(first).collect()} - want.keys()
