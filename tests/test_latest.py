"""Looking back for similar titles in one order of time, by shapes."""

from __future__ import annotations

import datetime
import difflib
import random

import pyarrow as pa
import pytest
from presswork.operators import dedup, latest, shapes

SPAN = 1000
FORMS = ["zepto raises {} million", "paytm raises {} million", "{} to {}", "{}", "nse to {} up {}", "no digits here", "none digits here", "5678901{} 98765432{}"]


def batches(rows, near, size):
    """What a task gets: one group, whose near kinds come first."""
    told = [(0, 0, None, other, None, k, None, False) for k, others in near.items() for other in others if k != other]
    every = told + [(0, 0, t, i, t, k, title, asks) for t, i, k, title, asks in sorted(rows)]
    names = ["part", "stretch", "at", "article_id", "s", "kind", "title", "asks"]
    types = [pa.int64()] * 6 + [pa.string(), pa.bool_()]
    for start in range(0, len(every), size):
        part = every[start : start + size]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)


def found(rows, near, size):
    return {a: b for out in latest._latest(0.8, SPAN)(batches(rows, near, size)) for a, b in zip(*(c.to_pylist() for c in out.columns))}


@pytest.mark.parametrize("at_once,steps,cells", [(1 << 16, 8, 1 << 22), (30, 1, 16), (100, 0, 200)])
def test_looks_back_as_far_as_needed(monkeypatch, at_once, steps, cells):
    for name, value in (("AT_ONCE", at_once), ("STEPS", steps), ("CELLS", cells)):
        monkeypatch.setattr(latest, name, value)
    rng = random.Random(at_once)
    rows = []
    for i in range(500):
        form = rng.choice(FORMS)
        title = form.format(*(rng.choice([rng.randrange(10), rng.randrange(1000), rng.randrange(10**5)]) for _ in range(form.count("{}"))))
        rows.append((rng.randrange(4000), i, title, rng.random() < 0.8))
    number = {s: n for n, s in enumerate(sorted({"".join("0" if c.isdigit() else c for c in r[2]) for r in rows}))}
    rows = [(t, i, number["".join("0" if c.isdigit() else c for c in title)], title, asks) for t, i, title, asks in rows]
    # Kinds whose numbers add up to a multiple of seven are in conflict.
    near = {a: [b for b in number.values() if a == b or (a + b) % 7] for a in number.values()}
    want, ordered = {}, sorted(rows)
    for n, (t, i, k, title, asks) in enumerate(ordered):
        for s, j, other, earlier, _ in reversed(ordered[:n]):
            if asks and t - s <= SPAN and other in near[k] and difflib.SequenceMatcher(None, title, earlier).ratio() >= 0.8:
                want[i] = j
                break
    assert found(rows, near, 70) == want and len(want) > 200


def test_few_are_compared_at_one_time(monkeypatch):
    compared, similar = [], shapes._is_similar
    monkeypatch.setattr(shapes, "_is_similar", lambda *a: compared.append(a) or similar(*a))
    rows = [(7, i, 0, f"zepto raises a round of {1000 + i} million", True) for i in range(5000)]
    assert found(rows, {}, 10_000) == {i: i - 1 for i in range(1, 5000)} and len(compared) < 2000


def test_titles_of_one_time_meet_no_square(spark, monkeypatch):
    made, verified = [], dedup.verified
    monkeypatch.setattr(dedup, "verified", lambda pairs, *a, **k: made.append(pairs.count()) or verified(pairs, *a, **k))
    at = datetime.datetime(2001, 1, 1)
    rows = [(i, at, f"zepto raises a round of {1000 + i} million", ["zepto"]) for i in range(1200)]
    frame = spark.createDataFrame(rows, "article_id long, published_at timestamp, plain_title string, real_companies array<string>")
    assert {r.article_id: r.earlier_id for r in dedup.similar_links(frame).collect()} == {i: i - 1 for i in range(1, 1200)}
    assert sum(made) < 20 * len(rows)  # before, all pairs of them
