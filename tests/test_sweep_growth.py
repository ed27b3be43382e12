"""A sweep compares titles of stories that aren't linked yet, not those of all."""

from __future__ import annotations

import datetime

from presswork.operators import reconcile

from test_reconcile import STORY, all_pairs, components

DAY = datetime.datetime(2001, 1, 1)


def test_compared_titles_grow_with_stories(spark, monkeypatch):
    compared, verified = [], reconcile.verified

    def counted(pairs, *args, **kwargs):
        compared.append(pairs.count())
        return verified(pairs, *args, **kwargs)

    monkeypatch.setattr(reconcile, "verified", counted)
    rows = [(i, DAY + datetime.timedelta(minutes=10 * i), "NEW", f"zepto raises a round of {1000 + i} million", [], f"u{i}", f"h{i}", "OTHER", i % 3) for i in range(200)]
    frame = spark.createDataFrame(rows, STORY)
    got = {(r.article_id, r.earlier_id): r.reason for r in reconcile.reconcile_pairs(frame).collect()}
    want = all_pairs(frame.collect())
    assert got.items() <= want.items() and components(got) == components(want)
    assert sum(compared) < 10 * len(rows)  # all pairs are some 200 times as many as the rows
