"""The corpus pipeline, stage by stage, against plain versions; and on tables of odd rows and of none."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import pytest
from presswork.llm import mixing, pii, quality
from presswork.shared import written


def stages(spark, docs, data):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], data), name.replace(" ", "-")))
    return out


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_stages(spark, data, request, table):
    docs = request.getfixturevalue(table)
    start, judged, single, clean, mixed, packed = stages(spark, docs, data)
    for stage in (judged, single, clean, mixed):
        assert stage.columns == docs.columns
    ledger = {(r.doc_id, r.text): r.rule_bits for r in quality.ledger(start).collect()}
    kept = Counter((r.doc_id, r.text) for r in start.collect() if ledger[r.doc_id, r.text] & quality.mask("strict-1") == 0)
    assert Counter((r.doc_id, r.text) for r in judged.collect()) == kept
    assert all(not brute.quality(t)[5] for _, t in kept)
    groups = brute.near_groups({i: t for i, t in kept if i is not None}.items())
    want = {i for i, (_, low) in groups.items() if i == low}
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(want)
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.text for r in clean.collect()}
    assert before.keys() == after.keys() and clean.count() == single.count()
    for i, text in before.items():
        assert brute.private(after[i])[:4] == (0, 0, 0, 0)
        if not pii.proposals(text or ""):
            assert after[i] == text
    again = Counter((r.doc_id, r.text) for r in mixing.replicate(clean).collect())
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == again
    want = Counter()
    for (i, text), n in again.items():
        ids = brute.tokens(text, "byte_bpe_50k.json")
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, brute.crc(ids[a:b])] += n
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(len(r.ids) == 4 * r.length and r.offset + r.length <= 1024 for r in rows)


def test_no_rows(spark, data, none):
    assert [stage.count() for stage in stages(spark, none, data)] == [0] * 6
