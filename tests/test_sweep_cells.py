"""The sweep's components go by cells of equal stories, not by stories."""

from __future__ import annotations

import datetime

from presswork.operators import reconcile

from test_reconcile import DAY, STORY, components


def test_components_go_by_cells(spark, monkeypatch):
    edges, connected = [], reconcile.connected_components
    monkeypatch.setattr(reconcile, "connected_components", lambda links: edges.append(links.count()) or connected(links))
    titles = ["acme opens a plant", "omega closes its doors"]
    rows = [(i, DAY + datetime.timedelta(minutes=i), "NEW", titles[i % 2], [["x"], ["y"]][i % 2], f"u{i // 2 % 50}", f"h{i % 2}", "OTHER", 0) for i in range(1000)]
    pairs = reconcile.reconcile_pairs(spark.createDataFrame(rows, STORY)).collect()
    assert set(components([(r.article_id, r.earlier_id) for r in pairs]).values()) == {0, 1}
    assert {r.reason for r in pairs} <= {"url", "hash"}
    assert sum(edges) < 50  # before, a link of each story and more
