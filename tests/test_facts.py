"""Conflicts of facts: counts by a sweep against all pairs."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from presswork.operators import facts

SCHEMA = "report_id long, fact_type string, pos int, source_id long, num_value double, text_value string, confidence double"


def mismatch(a, b):
    if a[4] is not None and b[4] is not None:
        top = max(a[4], b[4])
        return top > 0 and abs(a[4] - b[4]) / top > 0.05
    x, y = (r[5] if r[5] is not None else None if r[4] is None else repr(r[4]) for r in (a, b))
    return x is not None and y is not None and x != y


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        number = rng.choice([None, 95.0, 100.0, 100.0, 105.0, 105.3, 0.0, -3.0, -100.0, 7.5, rng.uniform(90, 110)])
        text = rng.choice([None, "a", "b", "100.0", "7.5"]) if number is None or rng.random() < 0.2 else None
        rows.append((rng.randrange(6), rng.choice(["profit", "stock_movement"]), i, i, number, text, 0.5))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter((a[0], a[1]) for a, b in itertools.combinations(rows, 2) if a[:2] == b[:2] and mismatch(a, b))
    got = {(r.report_id, r.fact_type): (r.n, r.severity) for r in facts.conflict_counts(frame).collect()}
    assert got == {k: (n, "HIGH" if k[1] == "profit" else "MEDIUM") for k, n in want.items()}
    assert Counter((r.report_id, r.fact_type) for r in facts.fact_conflicts(frame).collect()) == want


def test_a_large_group_ends(spark):
    frame = spark.range(100_000).selectExpr("1L as report_id", "'profit' as fact_type", "cast(id as int) as pos", "id as source_id", "cast(id % 20000 + 1 as double) as num_value", "cast(null as string) as text_value", "0.5D as confidence")
    got = facts.conflict_counts(frame).collect()
    near = sum(25 * (j - 1 - next_low(j)) for j in range(1, 20_001))
    assert [(r.report_id, r.n) for r in got] == [(1, 25 * (20_000 * 19_999 // 2) - near)]
    kept = facts.consensus(frame, facts.conflict_counts(frame))
    assert kept.count() == 100_000 and facts.confirmed(frame, facts.conflict_counts(frame)).count() == 0
    assert facts.conflict_counts(frame.limit(0)).count() == 0


def next_low(j):
    """How many whole numbers from one are apart from j by more than five hundredths of it."""
    low = int(j * 0.95)
    while low and not (j - low) / j > 0.05:
        low -= 1
    while (j - (low + 1)) / j > 0.05:
        low += 1
    return low
