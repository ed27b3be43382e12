"""Hooks, checks and the choice of a post."""

from __future__ import annotations

import pytest
from presswork.functions.dialect import SPARK
from presswork.operators import posts
from pyspark.sql import functions as F

STORY = "article_id long, title string, event_type string, main_company string, impact string, angles array<string>"
FACT = "article_id long, moved double, kind_1 string, value_1 double, currency_1 string, kind_2 string"


@pytest.fixture(scope="module")
def scored(spark):
    stories = spark.createDataFrame(
        [
            (1, "Zepto raises $12 million", "FUNDING", "Zepto", "positive", ["number_led", "consequence", "investor_angle", "explainer"]),
            (2, "Infosys shares jump 5%", "STOCK_MOVEMENT", "Infosys", "positive", ["contrast", "data_led", "second_order"]),
            (3, "Something happened", "OTHER", None, "neutral", ["explainer", "question"]),
            (4, "Is Acme turning a corner, or is this a one-off", "OTHER", "Acme", "neutral", ["explainer", "question"]),
        ],
        STORY,
    )
    facts = spark.createDataFrame([(1, None, "funding_amount", 12e6, "USD", None), (2, 5.0, "stock_movement", 5.0, None, None)], FACT)
    return posts.scored(posts.candidates(stories, facts)).cache()


def test_hooks(scored):
    found = {(r.article_id, r.strategy): r.post for r in scored.collect()}
    assert found[1, "number_led"] == "$12.0M. That's the funding figure Zepto just put on the board."
    assert found[1, "consequence"] == "This could reshape Zepto's next growth phase. (funding amount: $12.0M)"
    assert found[2, "contrast"].startswith("Infosys stock jumped 5.0% today.")
    assert (2, "data_led") not in found and not any(i == 3 for i, _ in found)


def test_choice(scored):
    best = {r.article_id: r for r in posts.select_post(scored).collect()}
    assert best[1].strategy in ("number_led", "investor_angle", "consequence") and best[1].quality >= 80
    assert best[4].post.startswith("Here's what just happened: ")
    kept = posts.diverse_alternates(scored).where("article_id = 1").collect()
    assert [r.place for r in kept] == list(range(len(kept))) and kept[0].post == best[1].post


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("", "empty"), ("short", "suspiciously"), ('{"a": 1} and more', "malformed"), ("You won't believe this one", "clickbait"),
        ("Buy it now!!!! please", "excessive punctuation"), ("THIS LOUD HEADLINE here", "excessive capitalization"), ("SEBI fines Acme for Rs 5 crore", None),
    ],
)
def test_rejects(spark, text, reason):
    got = spark.createDataFrame([(text,)], "t string").select(F.expr(posts.reject_reason(SPARK, "t")).alias("r")).first().r
    assert (got is None) if reason is None else got.startswith(reason)


def test_amounts(spark):
    cases = [(144e6, "USD", "$144.0M"), (2.5e9, "USD", "$2.50B"), (12e9, "INR", "₹1200.0Cr"), (5000.0, "USD", "$5,000")]
    rows = spark.createDataFrame([(v, c) for v, c, _ in cases], "v double, c string").selectExpr(f"{posts.amount(SPARK, 'v', 'c')} as a").collect()
    assert [r.a for r in rows] == [a for *_, a in cases]


def test_baseline(spark):
    fact = "struct<p: bigint, v: double, c: string>"
    schema = ", ".join(["article_id long, title string, event_type string, main_company string, category string, article_url string, source_name string", *(f"{k} {fact}" for k in posts.NAMED), "numbers array<struct<p: bigint, k: string, v: double, c: string>>"])
    funding, stock = (0, 12e6, "USD"), (3, -4.21, None)
    rows = [
        (1, "t", "FUNDING", "Zepto", "FUNDING", "https://x.y/a", "X", funding, None, None, None, None, None, [(0, "funding_amount", 12e6, "USD"), (5, "revenue", 2e9, "USD")]),
        (2, "t", "STOCK_MOVEMENT", "SEBI", "STOCK", "https://news.google.com/r", "Reuters", None, None, None, stock, None, None, []),
        (3, "Long " * 100, "OTHER", None, None, "", None, *[None] * 6, None),
        (4, "t", "EARNINGS", "C" * 260, "OTHER", None, None, *[None] * 6, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    for layer in posts.baseline(SPARK):
        frame = frame.selectExpr("*", *(f"{e} as {n}" for n, e in layer.items()))
    got = {r.article_id: r for r in frame.collect()}
    assert got[1].post_text == "\U0001f4b0 Zepto just landed $12.0M in funding! That's fresh cash to grow faster, hire more people, and expand."
    assert got[1].thread == "Revenue: $2.00B\nSource: https://x.y/a" and got[1].image_headline == "Zepto"
    assert got[2].post_text == "\U0001f4c9 This company stock just dropped 4.2%. Investors are worried about This company right now." and got[2].thread == "Source: Reuters"
    assert len(got[3].post_text) == 280 and got[3].post_text.endswith("…") and got[3].thread == "" and len(got[3].image_headline) <= 60
    assert len(got[4].post_text) == 280 and got[4].thread.startswith("This shows how CCC")


def test_candidates_of_a_search(spark):
    stories = spark.createDataFrame([(1, "acme buys rival for ten crore", 4)], "article_id long, plain_title string, held int")
    entries = [
        (1, 0, "Acme buys rival for ten crore - Reuters", "l0"), (1, 1, "Weather today - Other", "l1"), (1, 2, "Acme buys a rival for ten crore", "l0 "),
        (1, 3, "Acme buys rival - Mint", "l3"), (1, 4, "Acme buys rival for crores", "l4"), (1, 5, None, "l5"), (1, 6, "Acme buys rival", ""), (2, 0, "Acme buys rival", "l6"),
    ]
    got = posts.match_candidates(stories, spark.createDataFrame(entries, "article_id long, position int, title string, link string")).orderBy("position").collect()
    assert [(r.position, r.title, r.source_name, r.link, r.priority) for r in got] == [(0, "Acme buys rival for ten crore", "Reuters", "l0", 85), (3, "Acme buys rival", "Mint", "l3", 85)]
    long = "A publisher " * 6
    entries = spark.createDataFrame([(1, 0, f"Acme buys rival for ten crore - {long}", "l0"), (1, 1, f"Acme buys rival for ten crore - {long}", "l1"), (1, 2, "Acme buys rival for ten crore", "l2")], "article_id long, position int, title string, link string")
    known = spark.createDataFrame([(1, "l0")], "article_id long, link string")
    for held, want in ((6, ["l1"]), (9, ["l1"]), (5, ["l1"]), (4, ["l1", "l2"])):
        got = posts.match_candidates(stories.selectExpr("article_id", "plain_title", f"{held} as held"), entries, known).orderBy("position").collect()
        assert [r.link for r in got] == want and got[0].source_name == long.strip()
