"""Golden cases of the rules, written by hand, and the story columns they give."""

from __future__ import annotations

import datetime

import pytest
from presswork.functions.dialect import SPARK
from presswork.operators import facts
from presswork.plans import stories as plan
from pyspark.sql import functions as F

AT = datetime.datetime(2001, 7, 31, 23, 0)


@pytest.fixture(scope="module")
def story(spark):
    def run(title, summary="", source="Reuters", url="https://x.com/a", country="Global", at=AT, sources=1):
        row = [(1, title, source, url, country, at, summary, sources)]
        frame = spark.createDataFrame(row, "article_id long, title string, source_name string, article_url string, country string, published_at timestamp, summary string, source_count int")
        return plan.process(frame).first()

    return run


def test_addresses(spark):
    cases = {
        "https://Example.COM/News/?utm_source=x&id=2&ref=y#top": "https://example.com/News?id=2",
        "HTTP://A.b/": "http://a.b/",
        "https://a.b/c///": "https://a.b/c",
        "https://a.b/c?x=&y=1&GCLID=3": "https://a.b/c?y=1",
        "https://a.b/c?q=a%20b&c==d": "https://a.b/c?q=a+b&c=%3Dd",
        "https://a.b/c?q=a+b&%75tm_x=1&c=%3Dd": "https://a.b/c?q=a+b&c=%3Dd",
        "https://a.b/c?q=%zz&r=100%&s=~*&t=%C3%A9": "https://a.b/c?q=%25zz&r=100%25&s=~%2A&t=%C3%A9",
        "https://a.b?novalue&=v": "https://a.b?=v",
        "a.b/c/?ref=1#x": "a.b/c",
        "": "",
        "not an address": "not an address",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "article_url string").select("*")
    for layer in (plan._url(SPARK), plan._url_joined(SPARK)):
        rows = rows.select("*", *(F.expr(e).alias(n) for n, e in layer.items()))
    assert {r.article_url: r.clean_url for r in rows.collect()} == cases


def test_titles(story):
    row = story("The CEO's  Plan: is\tit on?")
    assert (row.plain_title, row.no_stopwords) == ("the ceos plan is it on", "ceos plan")


@pytest.mark.parametrize(
    ("title", "category", "event"),
    [
        ("Zepto raises $100 million", "FUNDING", "FUNDING"),
        ("NSE IPO listing date: when the issue is expected to hit exchanges", "IPO", "IPO_ANNOUNCEMENT"),
        ("Acme shares listed, debuts on NSE", "MARKET", "IPO_LISTING"),
        ("Acme Q1 profit surges", "OTHER", "PROFIT_UPDATE"),
        ("IndiGo jumps 4.5%, HPCL surges 6.6%", "MARKET", "OTHER"),
        ("Acme gains 5%", "STOCK", "OTHER"),
        ("Police investigation widens", "OTHER", "INVESTMENT"),
        ("Acme appoints chairman", "OTHER", "LEADERSHIP_CHANGE"),
    ],
)
def test_classes(story, title, category, event):
    row = story(title)
    assert (row.category, row.event_type) == (category, event)


@pytest.mark.parametrize(
    ("title", "kind"),
    [
        ("20 companies to post earnings today", "CALENDAR"),
        ("Weekly roundup of deals", "ROUNDUP"),
        ("Should you buy Acme?", "ADVICE"),
        ("Why the market is moving", "OPINION"),
        ("Why did Acme shares fall 10% after results?", "SINGLE_EVENT"),
        ("What to expect from the budget", "FORECAST"),
        ("Sensex today: live", "MARKET_WRAP"),
        ("Sensex rises 700 points", "MARKET_EVENT"),
        ("Acme opens an office", "SINGLE_EVENT"),
    ],
)
def test_content_types(story, title, kind):
    assert story(title).content_type == kind


def test_entities(story):
    row = story("Quest Global Said to Pick Banks as SEBI watches Tata Motors", "CEO Karan Shah of India spoke")
    assert row.companies == ["Quest Global", "Tata", "Tata Motors"] and row.regulators == ["SEBI"]
    assert row.people == ["Karan Shah"] and row.countries == ["India"] and row.main_country == "India"
    assert row.main_company == "Quest Global"
    assert story("Reuters reports nothing").companies == []


def test_amounts(story):
    for title, amount in (("a $1.5 billion deal", 1500.0), ("$100M raised", 100.0), ("Rs 830 crore", 100.0), ("83cr deal", 10.0), ("500 crore", 0.0)):
        assert story(title).amount == pytest.approx(amount)


def test_scores(story):
    row = story("Zepto raises $100 million in Series B funding round", country="India")
    assert (row.tier, row.source_score, row.freshness_bonus, row.staleness_multiplier) == (2, 85, 10, 1.0)
    assert row.india_relevance == 55 and row.relevance_multiplier == 1.0
    assert row.importance_score == 5 + 17 + 5 + 14 + 5 + 8 + 10 and row.postability_score == 85 and row.confidence_score == 85
    assert row.final_score == 74 and row.status == "READY_FOR_REVIEW"
    assert story("x", sources=3, source="Nobody").confidence_score == 67
    old = story("Zepto raises $100 million", at=datetime.datetime(2001, 1, 1))
    assert old.staleness_multiplier == 0.05 and old.freshness_bonus == 0


def test_nulls(story):
    row = story(None, None, None, None, None, None)
    assert (row.clean_url, row.plain_title, row.tier, row.freshness_bonus, row.staleness_multiplier, row.category) == ("", "", 4, 0, 1.0, "OTHER")
    assert row.is_noise and row.noise_penalty == 30 and row.status == "FILTERED"


def test_money_and_facts(spark):
    rows = spark.createDataFrame([("Rs 5,000 crore",), ("$2.5 billion",), ("$100M",), ("none",)], "title string")
    values = [tuple(r) for r in rows.selectExpr(*(f"{e} as {n}" for n, e in facts.money(SPARK, "title").items())).collect()]
    assert values == [(5e10, "INR"), (2.5e9, "USD"), (100.0, "USD"), (None, None)]
    text = "Acme raised $10 million. Its shares fall 6.5% today! IPO price band is Rs 500 to Rs 520. It raised $10 million again. Subscribed 3.5 times? Profit was Rs 20 crore."
    got = facts.extract_facts(facts.sentences(spark.createDataFrame([(1, text)], "id int, text string"), "text", "id"), "id")
    found = {(r.fact_type, r.num_value, r.text_value, r.currency) for r in got.collect()}
    assert found == {
        ("funding_amount", 1e7, None, "USD"), ("stock_movement", -6.5, None, None), ("ipo_price_band", None, "500.0-520.0", None),
        ("subscription_number", 3.5, None, None), ("profit", 2e8, None, "INR"),
    }


def test_conflicts(spark):
    rows = [(1, i, i, "valuation", v, None, 0.9) for i, v in enumerate((100.0, 104.0, 120.0))] + [(2, 1, 1, "profit", 5.0, None, 0.9), (2, 2, 2, "profit", 5.1, None, 0.8)]
    frame = spark.createDataFrame(rows, "report_id long, pos int, source_id int, fact_type string, num_value double, text_value string, confidence double")
    found = facts.fact_conflicts(frame)
    assert sorted((r.pos_a, r.pos_b, r.severity) for r in found.collect()) == [(0, 2, "HIGH"), (1, 2, "HIGH")]
    agreed = {(r.report_id, r.pos, r.confidence) for r in facts.consensus(frame, facts.conflict_counts(frame)).collect()}
    assert agreed == {(1, 0, 0.9), (1, 1, 0.9), (1, 2, 0.9), (2, 1, 1.0)}
