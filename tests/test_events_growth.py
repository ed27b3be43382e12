"""Events take no pairs of similar titles, but shapes of titles and founders."""

from __future__ import annotations

import datetime

from presswork.operators import events

from test_reconcile import STORY, one_by_one

DAY = datetime.datetime(2001, 1, 1)


def test_tables_grow_with_articles(spark, monkeypatch):
    sizes, written = [], events.written

    def counted(df, name):
        out = written(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(events, "written", counted)
    monkeypatch.setattr(events, "LAST", 20)
    rows = [(i, DAY + datetime.timedelta(hours=i), "NEW", f"{'zepto' if i % 2 else 'nse'} raises a round of {1000 + i} million", [], f"u{i}", f"h{i}", "OTHER", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, STORY)
    got = {r.article_id: (r.event_id, r.level) for r in events.assign_events(frame).collect()}
    assert got == one_by_one(frame.collect())
    assert max(sizes) < 10 * len(rows)  # all pairs are some 200 times as many as the rows
