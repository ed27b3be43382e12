"""Counts by status need no stored stories."""

from __future__ import annotations

from presswork import registry
from presswork.plans import stories as plan


def test_process_new_stores_nothing(spark, data):
    held = dict(registry._STORED)
    got = {r.status: (r.n, r.n_noise, r.n_penalized) for r in registry.QUERIES["process_new"](spark, data).collect()}
    assert registry._STORED == held
    want = {}
    for r in plan.stories(spark, data).select("status", "is_noise", "noise_penalty").collect():
        n, noise, penalized = want.get(r.status, (0, 0, 0))
        want[r.status] = (n + 1, noise + r.is_noise, penalized + (r.noise_penalty > 0))
    assert got == want
