"""Latest similar titles by growing look-back, against all pairs."""

from __future__ import annotations

import datetime
import difflib
import random

import pytest
from presswork.operators import dedup

DAY = datetime.datetime(2001, 1, 1)
SCHEMA = "article_id long, published_at timestamp, plain_title string, real_companies array<string>"


def brute(rows):
    out, ordered = {}, sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[0]))
    for i, (a, at, title, companies) in enumerate(ordered):
        for b, before, other, others in reversed(ordered[:i]):
            if (at - before).total_seconds() <= 7 * 86400 and not (companies and others and not set(companies) & set(others)) and difflib.SequenceMatcher(None, title, other).ratio() >= 0.8:
                out[a] = b
                break
    return out


@pytest.mark.parametrize("near", [2, 16, 512])
def test_latest_similar_title(spark, monkeypatch, near):
    monkeypatch.setattr(dedup, "NEAR_ROWS", near)
    rng, rows = random.Random(near), []
    for i in range(250):
        title = rng.choice(["", None, *(f"{n} {w} {k}" for n in ("acme", "zepto") for w in ("raises a round of", "falls by", "rises") for k in range(30))])
        at = rng.choice([None, *(DAY + datetime.timedelta(hours=rng.randrange(24 * 40)) for _ in range(30))])
        rows.append((i, at, title, rng.choice([[], ["x"], ["y"], ["y", "x"]])))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.article_id: r.earlier_id for r in dedup.similar_links(frame).collect()} == brute(rows)
    few = frame.where("article_id % 5 = 0")
    assert {r.article_id: r.earlier_id for r in dedup.similar_links(frame, new=few).collect()} == {a: b for a, b in brute(rows).items() if a % 5 == 0}
    assert dedup.similar_links(frame.limit(0)).count() == 0


def test_compared_titles_grow_with_articles(spark, monkeypatch):
    monkeypatch.setattr(dedup, "NEAR_ROWS", 16, raising=False)
    compared, verified = [], dedup.verified

    def counted(pairs, *args, **kwargs):
        compared.append(pairs.count())
        return verified(pairs, *args, **kwargs)

    monkeypatch.setattr(dedup, "verified", counted)
    rows = [(i, DAY + datetime.timedelta(minutes=i), f"zepto raises a round of {1000 + i} million", ["zepto"]) for i in range(600)]
    got = {r.article_id: r.earlier_id for r in dedup.similar_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i - 1 for i in range(1, 600)}
    assert sum(compared) < 50 * len(rows)  # all pairs are 300 times as many as the rows
