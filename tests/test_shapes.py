"""Similar titles by shapes, against all pairs."""

from __future__ import annotations

import datetime
import difflib
import random

import pytest
from presswork.operators import shapes

from test_reconcile import components

DAY = datetime.datetime(2001, 1, 1)
SCHEMA = "article_id long, published_at timestamp, plain_title string"


def brute(rows):
    placed = {(t, int((at - datetime.datetime(1970, 1, 1)).total_seconds() // (7 * 86400))) for _, at, t in rows if at and t}
    return {(a, b) for a, i in placed for b, j in placed if a != b and 0 <= i - j <= 1 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8}


@pytest.mark.parametrize("seed,part", [(1, 2048), (2, 4)])
def test_classes_and_links(spark, monkeypatch, seed, part):
    monkeypatch.setattr(shapes, "PART", part)
    rng, rows = random.Random(seed), []
    forms = ["zepto buys a rival for rs {} crore", "reuters buys rival for rs {} crore", "nse buys {} of {}", "{} to {} up {}", "sensex falls {}", "12 {} 34", "{}", "long " * 40 + "story {} of {}"]
    for i in range(300):
        form = rng.choice(forms)
        title = form.format(*(rng.choice([rng.randrange(10), rng.randrange(100), rng.randrange(10**4), rng.randrange(10**9)]) for _ in range(form.count("{}"))))
        rows.append((i, DAY + datetime.timedelta(days=rng.randrange(400)) if rng.random() < 0.95 else None, rng.choice([title] * 20 + ["", None])))
        rows.append((1000 + i, DAY + datetime.timedelta(days=rng.randrange(400)), title))
    pairs = brute(rows)
    got = {r.title: (r.class_id, r.links) for r in shapes.similar_classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    of = components(pairs)
    assert set(got) == {t for _, _, t in rows if t}
    assert got == {t: (of.get(t, t), sum(a == t for a, _ in pairs)) for t in got} and len(pairs) > 500


def test_compared_patterns_grow_less_than_pairs(monkeypatch):
    compared, similar = [], shapes._is_similar
    monkeypatch.setattr(shapes, "_is_similar", lambda *a: compared.append(a) or similar(*a))
    titles = [f"zepto acquires rival for rs {n} crore" for n in range(1000, 2000)]
    assert shapes.similar_block(titles, titles, ("a", "b"), 0.8).all() and len(compared) < 2000  # of a million pairs


def test_no_titles(spark):
    assert shapes.similar_classes(spark.createDataFrame([(1, DAY, None)], SCHEMA)).count() == 0
